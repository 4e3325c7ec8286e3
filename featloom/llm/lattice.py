"""Sampled SentencePiece segmentations: forward filtering, backward sampling, lossless decoding.

The lattice of a text has a node between any two characters and an edge for every piece of the
vocabulary found there; a character without a piece has one edge of byte pieces. A piece's weight is
``(rank + 2) ** (-1 / temperature)``. Forward sums give each node its mass, and a segmentation is drawn
from the end backwards, each edge with its share of the mass, so segmentations come with exactly the
lattice's probabilities. The draw at a node is a hash of seed, row key and place: the same in every
run, task and partitioning.

Blanks become U+2581 and one more stands in front; decoding takes them back. A U+2581 of the text
itself goes to byte pieces, so every text comes back byte for byte.

No piece reaches over the start of a blank run or over a character that no piece has, so the lattice
falls apart there into units. Equal units of a block share their forward sums, and all units of a block
are filtered and drawn together, in numpy.

A null text counts as empty and an empty text has no pieces. A null key draws like the empty string.
An empty table gives an empty result; repeated rows with equal keys get equal segmentations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, flat, held, map_arrow
from .shingles import _powers, mix

BLANK = 0x2581
#: Stands for a U+2581 of the text itself; no character has this number.
OWN_BLANK = 0x110000
SEED = 1
TEMPERATURE = 1.0
_BLOCK = 1 << 19
#: Units compared with their like at a time.
_SLICE = 1 << 13
_FILTER_BITS = 20


class Vocabulary:
    """Pieces of a SentencePiece model with an index by hash."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces, ids, self.byte_ids = [], [], np.full(256, -1, np.int32)
        texts: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                code = int(piece[3:5], 16)
                self.byte_ids[code] = i
                texts.append(bytes([code]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or not piece:
                texts.append(b"")
            else:
                texts.append(piece.replace("▁", " ").encode())
                pieces.append(piece)
                ids.append(i)
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces: some texts could not be encoded")
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        rank = np.array([max(-model.get_score(i), 0.0) for i in ids])
        self.log_weight = np.zeros(len(texts))
        self.log_weight[ids] = -np.log(rank + 2.0)
        self.longest = max(map(len, pieces), default=1)
        self.known = np.zeros(OWN_BLANK + 1, bool)
        self.single = np.zeros(OWN_BLANK + 1, bool)
        codes = [np.array([ord(c) for c in p], np.int64) for p in pieces]
        for c in codes:
            self.known[c] = True
            if len(c) == 1:
                self.single[c] = True
        # Units may start at blank runs only if no piece has a blank after another character.
        self.splits = all("▁" not in p.lstrip("▁") for p in pieces)
        flat_codes = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        size = np.array([len(c) for c in codes], np.int64)
        start = np.cumsum(size) - size
        total = _prefix(flat_codes)
        hashes = _part(total, start, size)
        order = np.argsort(hashes)
        self.hash, self.piece = hashes[order], np.array(ids, np.int64)[order]
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.hash >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes are pieces, their ids)."""
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hash, hashes[at]), len(self.hash) - 1)
        same = self.hash[k] == hashes[at]
        return at[same], self.piece[k[same]]


def vocabulary(path: str) -> Vocabulary:
    return held(("vocabulary", path), lambda: Vocabulary(path))


def _prefix(codes: np.ndarray) -> np.ndarray:
    n = len(codes)
    up, _ = _powers(1 << max(10, n.bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return total


def _part(total: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    """Hashes of stretches of characters; equal stretches have equal ones.

    Polynomials modulo 2**64, so long stretches made for it can share one though they differ.
    """
    _, down = _powers(1 << max(10, (len(total) - 1).bit_length()))
    whole = (total[start + size] - total[start]) * down[start]
    return mix(whole + np.asarray(size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters with blanks marked and one in front of each non-empty text, offsets in them)."""
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    codes[codes == BLANK] = OWN_BLANK
    codes[codes == 0x20] = BLANK
    filled = np.diff(upto) > 0
    codes = np.insert(codes, upto[:-1][filled], BLANK)
    return codes, upto + np.concatenate([[0], np.cumsum(filled)])


def _unit_starts(v: Vocabulary, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    first = np.zeros(len(codes) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    alone = ~v.known[codes]
    first |= alone
    first[1:] |= alone[:-1]
    if v.splits:
        blank = codes == BLANK
        first[1:] |= blank[1:] & ~blank[:-1]
    return np.flatnonzero(first)


class Filter:
    """Edges of a set of units with the share of mass that each edge brings to its end node.

    Node ``i + k`` is the place before character i of unit k; all units stand one after another.
    """

    def __init__(self, v: Vocabulary, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, temperature: float):
        n = len(codes)
        unit = np.repeat(np.arange(len(starts)), sizes)
        left = np.repeat(starts + sizes, sizes) - np.arange(n)
        total = _prefix(codes)
        begins, lengths, pieces = [], [], []
        place = np.arange(n)
        for size in range(1, v.longest + 1):
            place = place[left[place] >= size]
            if not len(place):
                break
            at, piece = v.find(_part(total, place, size))
            begins.append(place[at])
            lengths.append(np.full(len(at), size))
            pieces.append(piece)
        bare = np.flatnonzero(~v.single[codes])
        begins.append(bare)
        lengths.append(np.ones(len(bare), np.int64))
        pieces.append(-1 - codes[bare])  # byte pieces of a character
        begin, length = np.concatenate(begins), np.concatenate(lengths)
        piece = np.concatenate(pieces)
        log_w = np.where(piece >= 0, v.log_weight[np.maximum(piece, 0)] / temperature, -30.0)
        start_node = begin + unit[begin]
        end_node = start_node + length
        step = end_node - (starts + np.arange(len(starts)))[unit[begin]]
        order = np.lexsort((end_node, step))
        s, e, w, t = start_node[order], end_node[order], log_w[order], step[order]
        mass = np.full(n + len(starts), -np.inf)
        mass[starts + np.arange(len(starts))] = 0.0
        cuts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]])) if len(t) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            x = mass[s[a:b]] + w[a:b]
            head = np.flatnonzero(np.concatenate([[True], e[a + 1 : b] != e[a : b - 1]]))
            top = np.maximum.reduceat(x, head)
            spread = np.exp(x - np.repeat(top, np.diff(np.append(head, b - a))))
            mass[e[a:b][head]] = top + np.log(np.add.reduceat(spread, head))
        order = np.argsort(end_node, kind="stable")
        self.start, self.piece = start_node[order], piece[order]
        end = end_node[order]
        share = np.exp(mass[self.start] + log_w[order] - mass[end])
        head = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else np.zeros(0, int)
        sums = np.cumsum(share)
        base = np.repeat(np.concatenate([[0], sums])[head], np.diff(np.append(head, len(end))))
        self.upto = np.minimum(sums - base, 1.0)
        self.upto[np.append(head[1:], len(end)) - 1] = 2.0  # the last edge takes what is left
        self.first = np.zeros(len(mass), np.int64)
        self.first[end[head]] = head
        self.mass = mass

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge into each node, by a uniform number."""
        edge = self.first[node]
        later = np.flatnonzero(u >= self.upto[edge])
        while len(later):
            edge[later] += 1
            later = later[u[later] >= self.upto[edge[later]]]
        return edge


def _kinds(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a unit of each kind, the kind of each unit): equal units are of one kind, compared by character."""
    _, first, kind = np.unique(_part(_prefix(codes), starts, sizes), return_index=True, return_inverse=True)
    alike = sizes == sizes[first[kind]]
    to = np.where(alike, starts[first[kind]], starts)
    unlike = ~alike
    for a in range(0, len(starts), _SLICE):  # a bounded number of units at a time
        s = slice(a, a + _SLICE)
        low, high = int(starts[a]), int(starts[s][-1] + sizes[s][-1])
        differ = codes[np.repeat(to[s] - starts[s], sizes[s]) + np.arange(low, high)] != codes[low:high]
        unlike[s] |= np.add.reduceat(differ, starts[s] - low, dtype=np.int64) > 0
    odd = np.flatnonzero(unlike)
    kind[odd] = len(first) + np.arange(len(odd))  # each a kind of its own
    return np.append(first, odd), kind


def sample(
    v: Vocabulary, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, temperature: float = TEMPERATURE
) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids, offsets in them) of texts as flat bytes, one drawn segmentation each."""
    codes, upto = _characters(data, offsets)
    rows = len(offsets) - 1
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
    starts = _unit_starts(v, codes, upto)
    sizes = np.diff(np.append(starts, len(codes)))
    first, kind = _kinds(codes, starts, sizes)
    own_sizes = sizes[first]
    own_starts = np.cumsum(own_sizes) - own_sizes
    take = np.repeat(starts[first] - own_starts, own_sizes) + np.arange(own_sizes.sum())
    lattice = Filter(v, codes[take], own_starts, own_sizes, temperature)
    low = own_starts[kind] + kind  # first node of each unit's kind
    node = low + sizes
    row = np.searchsorted(upto, starts, side="right") - 1
    seed, shift = seeds[row], starts - upto[row]
    active = np.arange(len(starts))
    drawn: list[tuple[np.ndarray, np.ndarray]] = []
    count = np.zeros(len(starts), np.int64)
    while len(active):
        here = node[active]
        place = (shift[active] + here - low[active]).astype(np.uint64)
        u = (mix(seed[active] + place * np.uint64(0xD1342543DE82EF95)) >> np.uint64(11)) * 2.0**-53
        edge = lattice.draw(here, u)
        drawn.append((active, edge))
        count[active] += 1
        node[active] = lattice.start[edge]
        active = active[node[active] > low[active]]
    ends = np.cumsum(count)
    edges = np.empty(ends[-1], np.int64)
    for k, (units, edge) in enumerate(drawn):
        edges[ends[units] - 1 - k] = edge
    pieces = lattice.piece[edges]
    row_ends = np.concatenate([[0], ends])[np.searchsorted(starts, upto)]
    return _with_bytes(v, pieces, row_ends)


def _with_bytes(v: Vocabulary, pieces: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters without a piece replaced by their byte pieces."""
    bare = np.flatnonzero(pieces < 0)
    if not len(bare):
        return pieces.astype(np.int32), offsets
    code, kind = np.unique(-1 - pieces[bare], return_inverse=True)
    spelled = [v.byte_ids[list(chr(BLANK if c == OWN_BLANK else c).encode())] for c in code.tolist()]
    size = np.ones(len(pieces), np.int64)
    size[bare] = np.array([len(s) for s in spelled])[kind]
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.repeat(pieces, size).astype(np.int32)
    for width in range(1, 5):
        some = np.flatnonzero(size[bare] == width)
        if len(some):
            table = np.array([s if len(s) == width else [0] * width for s in spelled], np.int32)
            out[at[bare[some]][:, None] + np.arange(width)] = table[kind[some]]
    return out, at[offsets]


def decode(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of piece ids; the blank in front of each text goes."""
    size = (v.ends[1:] - v.ends[:-1])[ids]
    at = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(v.ends[ids] - at[:-1], size) + np.arange(at[-1])
    ends = at[offsets]
    first = ends[:-1][np.diff(ends) > 0]
    if len(first) and (v.bytes[take[first]] != 0x20).any():
        raise ValueError("not an encoding: a text does not start with a blank")
    keep = np.ones(at[-1], bool)
    keep[first] = False
    return v.bytes[take[keep]], ends - np.concatenate([[0], np.cumsum(np.diff(ends) > 0)])


def row_seeds(keys: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit seed of each row from the run's seed and the xxhash64 of the row's key."""
    raw = keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return mix(raw + mix(np.array([seed], np.uint64)))


def _prepared(df: DataFrame, keep: list[str], text_col: str, key_col: str) -> DataFrame:
    key = F.xxhash64(F.coalesce(F.col(key_col).cast("string"), F.lit("")))
    return df.select(*keep, F.col(text_col).alias("__text"), key.alias("__key"))


def _types(df: DataFrame, keep: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return "".join(f"`{c}` {types[c]}, " for c in keep)


def encode(
    df: DataFrame, path: str, keep: list[str], text_col: str = "text", key_col: str = "doc_id",
    seed: int = SEED, temperature: float = TEMPERATURE,
) -> DataFrame:
    """Columns ``keep`` and token_ids, one drawn segmentation of each text.

    A kept column may not be called token_ids. ``path`` is a model file on every machine.
    """
    if "token_ids" in keep:
        raise ValueError("a kept column is named like the result: token_ids")
    n = len(keep)

    def run(batch: pa.RecordBatch):
        data, offsets = flat(batch.column(n))
        seeds = row_seeds(batch.column(n + 1), seed)
        for a, b in blocks(offsets, _BLOCK):
            part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            ids, ends = sample(vocabulary(path), part, own, seeds[a:b], temperature)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            kept = [c.slice(a, b - a) for c in batch.columns[:n]]
            yield pa.RecordBatch.from_arrays([*kept, lists], names=[*batch.schema.names[:n], "token_ids"])

    made = _prepared(df, keep, text_col, key_col)
    return map_arrow(made, run, _types(made, keep) + "token_ids array<int>")


def decoded(df: DataFrame, path: str, keep: list[str], ids_col: str = "token_ids") -> DataFrame:
    """Columns ``keep`` and decoded, the text of the ids (null ids: empty)."""
    if "decoded" in keep:
        raise ValueError("a kept column is named like the result: decoded")
    n = len(keep)
    made = df.select(*keep, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("__ids"))

    def run(batch: pa.RecordBatch):
        lists = batch.column(n)
        ends = lists.offsets.to_numpy().astype(np.int64)
        ids = lists.values.to_numpy()[ends[0] : ends[-1]]
        data, offsets = decode(vocabulary(path), ids, ends - ends[0])
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:n], pa.array(texts, pa.string())], names=[*batch.schema.names[:n], "decoded"]
        )

    return map_arrow(made, run, _types(made, keep) + "decoded string")


def round_trip(
    df: DataFrame, path: str, keep: list[str], text_col: str = "text", key_col: str = "doc_id",
    seed: int = SEED, temperature: float = TEMPERATURE,
) -> DataFrame:
    """Columns ``keep`` and n_bytes, n_pieces, ids_hash, lossless: encoding and decoding in one pass.

    ids_hash: hash of the ids in their order. lossless: decoding gave the text's very bytes.
    """
    if clash := {"n_bytes", "n_pieces", "ids_hash", "lossless"} & set(keep):
        raise ValueError(f"kept columns named like results: {sorted(clash)}")
    n = len(keep)

    def run(batch: pa.RecordBatch):
        data, offsets = flat(batch.column(n))
        seeds = row_seeds(batch.column(n + 1), seed)
        v = vocabulary(path)
        pieces, hashes, same = [], [], []
        for a, b in blocks(offsets, _BLOCK):
            part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            ids, ends = sample(v, part, own, seeds[a:b], temperature)
            back, back_ends = decode(v, ids, ends)
            pieces.append(np.diff(ends))
            total = _prefix(ids.astype(np.int64))
            hashes.append(_part(total, ends[:-1], np.diff(ends)).view(np.int64))
            if np.array_equal(back, part) and np.array_equal(back_ends, own):
                same.append(np.ones(b - a, bool))
            else:
                same.append(
                    np.array(
                        [
                            np.array_equal(back[back_ends[i] : back_ends[i + 1]], part[own[i] : own[i + 1]])
                            for i in range(b - a)
                        ]
                    )
                )
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:n],
                pa.array(np.diff(offsets), pa.int64()),
                *(pa.array(np.concatenate(x)) for x in (pieces, hashes, same)),
            ],
            names=[*batch.schema.names[:n], "n_bytes", "n_pieces", "ids_hash", "lossless"],
        )

    made = _prepared(df, keep, text_col, key_col)
    return map_arrow(
        made, run, _types(made, keep) + "n_bytes long, n_pieces long, ids_hash long, lossless boolean"
    )
