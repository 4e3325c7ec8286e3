"""Benchmark decontamination by the q-gram lemma.

A document is contaminated by a benchmark item if some region of it is within the item's edit budget,
``floor(RATE * length)``, of the whole item. Case is folded first, by Unicode (``É`` as ``é``, ``ß``
and ``SS`` as ``ss``), and every ASCII white-space byte is a blank; characters, lengths and edits are
then bytes of UTF-8. A reported region is the range of bytes, before folding, of the characters it touches.

A region within ``e`` edits of an item of ``m`` characters shares at least ``m - Q + 1 - Q * e``
q-grams with it, on at most ``e + 1`` neighbouring diagonals. So shared q-grams are counted in
overlapping bands of ``2 (e + 1)`` diagonals, a band that reaches the bound gives a region, and the
region is verified by banded alignment. The budget of a short item is lowered until its bound is
at least 1; an item shorter than ``Q`` is looked for as it is.

The benchmark's size is checked: blocks of about ``BLOCK_BYTES`` of items, one after the other, each
meet all documents where they are, without a shuffle.

Null and empty texts hold nothing; null and blank items match nothing; a null item id is reported as
such. Empty tables give empty results; repeated rows each get a row; kept columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, checkpoint, flat, held, map_arrow

Q = 8
RATE = 0.1
BLOCK_BYTES = 4 << 20
_TABLE_BITS = 22
_STEP = 1 << 19

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_CASED = 0x20000  # no code point from here on has a case


def _cases() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return held("cases", _new_cases)


def _new_cases() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how many, first place, code points) of the folded form of each code point below ``_CASED``."""
    folded = [chr(c).casefold() for c in range(_CASED)]
    many = np.array([len(f) for f in folded])
    return many, np.cumsum(many) - many, np.array([ord(x) for f in folded for x in f], np.uint32)


def _widths(codes: np.ndarray) -> np.ndarray:
    """Bytes of each code point; a byte outside UTF-8 is one of U+DC80 to U+DCFF."""
    wide = 1 + (codes >= 0x80) + (codes >= 0x800).astype(np.int64) + (codes >= 0x10000)
    return np.where((codes >= 0xDC80) & (codes <= 0xDCFF), 1, wide)


def _fold_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, bytes of each character before, bytes after)."""
    text = data.tobytes().decode("utf-8", "surrogateescape")
    if text.isascii():
        one = np.ones(len(data), np.int64)
        return _FOLD[data], one, one
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    many, first, flat_codes = _cases()
    known = np.minimum(codes, _CASED - 1)
    count = many[known]
    begin = np.cumsum(count) - count
    place = np.arange(count.sum()) + np.repeat(first[known] - begin, count)
    new = np.where(np.repeat(codes, count) < _CASED, flat_codes[place], np.repeat(codes, count))
    made = new.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")
    return _FOLD[np.frombuffer(made, np.uint8)], _widths(codes), np.add.reduceat(_widths(new), begin)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``_STEP`` bytes that cut no character; a row that starts inside one starts a range."""
    starts = offsets[offsets < len(data)]
    cuts = {0, len(data), *starts[data[starts] & 0xC0 == 0x80].tolist()}
    for at in range(_STEP, len(data), _STEP):
        cuts.add(next((at - k for k in range(4) if data[at - k] & 0xC0 != 0x80), at))
    bounds = sorted(cuts)
    yield from zip(bounds[:-1], bounds[1:], strict=True)


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts without case and with blanks as white space, as (bytes, offsets)."""
    parts, own, done = [np.zeros(0, np.uint8)], np.zeros_like(offsets), 0
    for a, b in _pieces(data, offsets):
        made, before, after = _fold_piece(data[a:b])
        i, j = np.searchsorted(offsets, [a, b], side="right")
        upto = np.concatenate([[0], np.cumsum(after)])
        own[i:j] = done + upto[np.searchsorted(np.cumsum(before), offsets[i:j] - a, side="right")]
        parts.append(made)
        done += len(made)
    return np.concatenate(parts), own


def _whole(data: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """The ranges of bytes of the characters of one text that the folded ranges touch."""
    out, done = np.zeros_like(spans), 0
    for a, b in _pieces(data, np.zeros(1, np.int64)):
        _, before, after = _fold_piece(data[a:b])
        upto, end = done + np.cumsum(after), a + np.cumsum(before)
        here = (spans[:, 0] >= done) & (spans[:, 0] < upto[-1])
        k = np.searchsorted(upto, spans[here, 0], side="right")
        out[here, 0] = end[k] - before[k]
        here = (spans[:, 1] > done) & (spans[:, 1] <= upto[-1])
        out[here, 1] = end[np.searchsorted(upto, spans[here, 1])]
        done = upto[-1]
    return out


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``Q`` bytes from each place on."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(data).tobytes()
    a = np.ndarray((n,), "<u8", raw, 0, (1,)) * np.uint64(0x9E3779B97F4A7C15)
    a ^= a >> np.uint64(32)
    a += np.ndarray((n,), "<u8", raw, Q - 8, (1,))
    a *= np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(29)
    return a


@dataclass
class Items:
    """A block of benchmark items with an index of their q-grams."""

    ids: list[int | None]  # the first id of each text
    every_id: list[list[int | None]]
    texts: list[bytes]
    budget: np.ndarray
    bound: np.ndarray
    gram: np.ndarray  # distinct hashes, ascending
    first: np.ndarray  # first place of each hash in item, at
    item: np.ndarray
    at: np.ndarray
    seen: np.ndarray  # a bit table of the hashes
    short: list[int]


def index(rows: list[tuple[int | None, str | None]]) -> Items:
    """The q-gram index of items (id, text); items that are equal when folded are looked for once."""
    raw = [(i, np.frombuffer(t.encode(), np.uint8)) for i, t in rows if t]
    folded = [(i, fold(t, np.array([0, len(t)]))[0].tobytes().strip()) for i, t in raw]
    by_text: dict[bytes, list[int | None]] = {}
    for i, t in sorted(((i, t) for i, t in folded if t), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        by_text.setdefault(t, []).append(i)
    kept = [(ids[0], t) for t, ids in by_text.items()]
    length = np.array([len(t) for _, t in kept], np.int64)
    budget = np.minimum((RATE * length).astype(np.int64), np.maximum((length - Q) // Q, 0))
    bound = length - Q + 1 - Q * budget
    grams = [_grams(np.frombuffer(t, np.uint8)) for _, t in kept]
    item = np.repeat(np.arange(len(kept)), [len(g) for g in grams])
    at = np.concatenate([np.arange(len(g)) for g in grams] or [np.zeros(0, np.int64)])
    every = np.concatenate(grams or [np.zeros(0, np.uint64)])
    order = np.argsort(every, kind="stable")
    gram, first = np.unique(every[order], return_index=True)
    seen = np.zeros(1 << _TABLE_BITS, bool)
    seen[(gram >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
    return Items(
        [i for i, _ in kept], list(by_text.values()), [t for _, t in kept], budget, bound, gram,
        np.append(first, len(every)), item[order], at[order], seen,
        [k for k in range(len(kept)) if length[k] < Q],
    )


def _hits(items: Items, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, index of its gram) of every place whose q-gram some item has."""
    places, found = [], []
    for at in range(0, max(len(data) - Q + 1, 0), _STEP):
        g = _grams(data[at : at + _STEP + Q - 1])
        p = np.flatnonzero(items.seen[(g >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(items.gram, g[p]), max(len(items.gram) - 1, 0))
        same = items.gram[k] == g[p] if len(items.gram) else np.zeros(0, bool)
        places.append(p[same] + at)
        found.append(k[same])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(found)


def _candidates(items: Items, data, offsets) -> list[tuple[int, int, int]]:
    """(row, item, band) whose shared q-grams reach the item's bound."""
    place, gram = _hits(items, data)
    row = np.searchsorted(offsets, place, side="right") - 1
    inside = place + Q <= offsets[row + 1]
    place, gram, row = place[inside], gram[inside], row[inside]
    n, out = len(items.ids), []
    many = items.first[gram + 1] - items.first[gram]
    cut = np.concatenate([[0], np.cumsum(many)])
    row_cut = np.searchsorted(row, np.arange(len(offsets)))
    n, out = len(items.ids), []
    # Rows that together have a bounded number of pairs of places.
    for first, last in blocks(cut[row_cut], 1 << 21):
        begin, end = int(row_cut[first]), int(row_cut[last])
        if begin == end:
            continue
        some = slice(begin, end)
        k = np.repeat(np.arange(begin, end), many[some])
        entry = items.first[gram[k]] + np.arange(len(k)) - (cut[k] - cut[begin])
        r, item = row[k], items.item[entry]
        pair = (r - row[begin]) * n + item
        if pair.max() < 8 * len(pair):
            together = np.bincount(pair)[pair]
        else:  # few of all pairs occur
            _, which, times = np.unique(pair, return_inverse=True, return_counts=True)
            together = times[which]
        enough = together >= items.bound[item]
        if enough.any():
            k, entry, r, item = k[enough], entry[enough], r[enough], item[enough]
            diagonal = place[k] - offsets[r] - items.at[entry]
            band = diagonal // (items.budget[item] + 1)
            # One number for row, item and band, with a gap after each pair's last band.
            least, high = int(band.min()), int(band.max() - band.min()) + 2
            key, times = np.unique(pair[enough] * high + band - least, return_counts=True)
            times[:-1] += np.where(np.diff(key) == 1, times[1:], 0)
            some_row, some_item = np.divmod(key // high, n)
            good = times >= items.bound[some_item]
            found = some_row[good] + row[begin], some_item[good], key[good] % high + least
            out += zip(*(x.tolist() for x in found), strict=True)
    return out


def _masks(item: bytes) -> dict[int, int]:
    """For each byte of the item, the bits of its places; those of the last items are kept."""
    kept = held("masks", dict)
    if item not in kept:
        if len(kept) >= 4096:
            kept.clear()
        out: dict[int, int] = {}
        for i, c in enumerate(item):
            out[c] = out.get(c, 0) | 1 << i
        kept[item] = out
    return kept[item]


def _nearest(item: bytes, region: bytes) -> tuple[int, int]:
    """(edits, end) of the substring of ``region`` nearest to ``item``, the first such end: a column of the programme as bits."""
    masks, every, top = _masks(item), (1 << len(item)) - 1, 1 << len(item) - 1
    up, down, cost = every, 0, len(item)
    best = cost, 0
    for end, c in enumerate(region, 1):
        same = masks.get(c, 0)
        level = same | down
        across = ((same & up) + up ^ up) | same
        more = (down | ~(across | up)) & every
        less = up & across
        cost += bool(more & top) - bool(less & top)
        if cost < best[0]:
            best = cost, end
        more = more << 1 & every
        up = (less << 1 | ~(level | more)) & every
        down = more & level
    return best


def _slide(item8: np.ndarray, text8: np.ndarray, m: int, n: int, row: np.ndarray, diagonal: np.ndarray) -> None:
    """Each row moved on along its diagonal while item and text agree, eight bytes at a time."""
    live = np.flatnonzero(row >= 0)
    while len(live):
        i = row[live]
        differ = item8[i] ^ text8[i + diagonal[live]]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, (np.log2(np.maximum(low, 1).astype(np.float64)) // 8).astype(np.int64))
        room = np.minimum(m - i, n - diagonal[live] - i)
        row[live] = i + np.minimum(same, room)
        live = live[(same == 8) & (room > 8)]


def _length(item: bytes, text: bytes, edits: int) -> int:
    """Bytes of the prefix of ``text`` that ``edits`` edits, the least that will do, make the item.

    The band has ``2 * edits + 1`` diagonals, a cell on each: the furthest row of the item reached on it
    so far. An edit goes one row on or to a neighbouring diagonal, equal bytes cost nothing.
    """
    m, n = len(item), len(text)
    pad = np.zeros(16, np.uint8)
    item8, text8 = (
        np.ndarray((len(x) + 9,), "<u8", np.concatenate([np.frombuffer(x, np.uint8), pad]), 0, (1,)) for x in (item, text)
    )
    row = np.zeros(1, np.int64)
    for k in range(edits + 1):
        diagonal = np.arange(-k, k + 1)
        if k:
            far = -2 * (m + n + k)  # not reached
            step = np.concatenate([[far], row + 1, [far]])
            across = np.concatenate([[far, far], row])  # a byte of the text left out
            down = np.concatenate([row + 1, [far, far]])  # a byte of the item left out
            row = np.minimum(np.maximum(np.maximum(step, across), down), np.minimum(m, n - diagonal))
        row[(row < 0) | (row + diagonal < 0)] = -2 * (m + n + k)
        _slide(item8, text8, m, n, row, diagonal)
        whole = np.flatnonzero(row == m)
        if len(whole):
            return int(m + diagonal[whole[0]])
    raise AssertionError("the edits are not the least")


def align(item: bytes, region: bytes, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the substring of ``region`` nearest to ``item``, within the budget.

    The first end with the least edits, then, backwards from it in a band, a start.
    """
    found = region.find(item)
    if found >= 0:
        return 0, found, found + len(item)
    if budget <= 0:
        return None
    edits, end = _nearest(item, region)
    if edits > budget:
        return None
    return edits, end - _length(item[::-1], region[:end][::-1], edits), end


def leaks(items: Items, data: np.ndarray, offsets: np.ndarray) -> list[dict[int, tuple[int, int, int]]]:
    """For each row, item index -> (edits, start, end) of its nearest region."""
    found: list[dict[int, tuple[int, int, int]]] = [{} for _ in range(len(offsets) - 1)]
    if not items.ids:
        return found
    for a, b in blocks(offsets):
        part, own = fold(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for row, item, band in _candidates(items, part, own):
            e, m = int(items.budget[item]), len(items.texts[item])
            low = band * (e + 1)
            begin = max(0, low - e)
            end = min(int(own[row + 1] - own[row]), low + 2 * (e + 1) + m + e)
            if begin >= end:
                continue
            region = part[own[row] + begin : own[row] + end].tobytes()
            match = align(items.texts[item], region, e)
            if match:
                match = (match[0], match[1] + begin, match[2] + begin)
                found[a + row][item] = min(found[a + row].get(item, match), match)
        for item in items.short:
            for row in range(b - a):
                at = part[own[row] : own[row + 1]].tobytes().find(items.texts[item])
                if at >= 0:
                    found[a + row][item] = (0, at, at + len(items.texts[item]))
        for row in range(a, b):
            text = data[offsets[row] : offsets[row + 1]]
            if found[row] and text.max() >= 0x80:
                spans = _whole(text, np.array([m[1:] for m in found[row].values()])).tolist()
                found[row] = {k: (m[0], *s) for (k, m), s in zip(found[row].items(), spans, strict=True)}
    return found


_MATCHES = "array<struct<item_id:long,edits:int,start:long,end:long>>"


def n_blocks(benchmark: DataFrame) -> int:
    """Blocks of about ``BLOCK_BYTES`` of different item texts."""
    size = F.sum(F.octet_length("text"))
    different = benchmark.select("text").distinct().agg(size.alias("n")).first().n or 0
    return -(-int(different) // BLOCK_BYTES)


def item_block(benchmark: DataFrame, number: int, count: int) -> Items:
    """One block: each different text with its ids, the one part of the benchmark that the driver holds."""
    mine = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(count)) == number
    rows = benchmark.where(mine).groupBy("text").agg(
        F.collect_list("item_id").alias("ids"), F.count_if(F.col("item_id").isNull()).alias("nulls")
    )
    return index([(i, r["text"]) for r in rows.collect() for i in [*r["ids"], *[None] * r["nulls"]]])


def _with_leaks(df: DataFrame, items: Items, kept: int, out: str) -> DataFrame:
    """The first ``kept`` columns and leaks by one block of items; column ``kept`` is the text."""
    names = df.columns[:kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:kept])

    def run(batch: pa.RecordBatch):
        rows = [
            [
                {"item_id": i, "edits": v[0], "start": v[1], "end": v[2]}
                for i, v in sorted(
                    ((i, v) for k, v in found.items() for i in items.every_id[k]), key=lambda x: (x[0] is None, x[0] or 0)
                )
            ]
            for found in leaks(items, *flat(batch.column(kept)))
        ]
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(rows, kind)], names=[*names, out])

    return map_arrow(df, run, f"{schema}, {out} {_MATCHES}" if schema else f"{out} {_MATCHES}")


def find_leaks(df: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and leaks: item, edits and byte range of the nearest region, by item.

    ``benchmark`` has item_id and text. One block of items is found in one pass over the documents. Of
    several, each is read on its own and its finds, the only rows it has, are written before the next.
    """
    if "leaks" in keep:
        raise ValueError("a kept column is named like the result: leaks")
    count = n_blocks(benchmark)
    rows = df.select(*keep, F.col(text_col).alias("__text"))
    if count == 0:
        return rows.select(*keep, F.array().cast(_MATCHES).alias("leaks"))
    if count == 1:
        return _with_leaks(rows, item_block(benchmark, 0, 1), len(keep), "leaks")
    rows = checkpoint(rows.withColumn("__row", F.monotonically_increasing_id()))
    finds = [
        checkpoint(_with_leaks(rows.select("__row", "__text"), item_block(benchmark, i, count), 1, "__leaks").where("size(__leaks) > 0"))
        for i in range(count)
    ]
    # Each document with a find, and its finds of all blocks by item, a null id last.
    merged = reduce(DataFrame.unionByName, finds).groupBy("__row").agg(F.flatten(F.collect_list("__leaks")).alias("__leaks"))
    ordered = F.sort_array(F.transform("__leaks", lambda x: F.struct(x["item_id"].isNull().alias("none"), x.alias("leak"))))
    found = merged.select("__row", F.transform(ordered, lambda x: x["leak"]).alias("leaks"))
    return rows.join(found, "__row", "left").select(*keep, F.coalesce("leaks", F.array().cast(_MATCHES)).alias("leaks"))
