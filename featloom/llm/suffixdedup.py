"""Removal of repeated passages, exact to the byte, with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes around it also starts in a document with a smaller id;
matches never cross documents and are judged on the input.

1. Documents are dealt to shards. Every window of ``LENGTH`` bytes has a minimiser, the least hash of
   the ``GRAM``-byte strings in it; windows of equal bytes have equal ones. A run of windows with one
   minimiser is a piece of text. Each shard reports its minimisers once, however often it holds them.
2. A minimiser seen in two documents or two shards is shared; each shard hears which of its are.
3. Shards send the distinct pieces of shared minimisers, with the least document id of each, to the
   bucket of the minimiser: only text that may repeat travels, and copies inside a shard travel once.
4. In a bucket pieces form slices of whole minimisers. The pieces of a slice, by the shards they come
   from, make suffix arrays of bounded size: Larsson and Sadakane's refinement in numpy, only of
   groups still unsorted, then common prefixes by Kasai's rule. Neighbours with ``LENGTH`` common
   bytes are the same string; the sorted strings of one array are looked up in the others by binary
   search. That gives the least document id of every string.
5. Shards compare these ids with their documents' own and cut the bytes.

The text is shuffled once and that exchange is reused by steps 1, 3 and 5. A frequent passage costs
each shard one copy. Nothing but blocks of numbers and shared text leaves a shard. A bucket holds all
different surroundings of its minimisers: arrays stay at ``ARRAY_BYTES``, but one 16-byte string with
very many different surroundings makes its bucket large.

Null text counts as empty. A null id is larger than all others and repeated ids are equal, so neither
removes anything from its like. Each row of the input gives a row; an empty table an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, flat, frugal, partitions
from .shingles import mix, stretch_hashes

LENGTH = 50
GRAM = 16
#: Bytes of pieces in one suffix array, and in the arrays that are merged with one another.
ARRAY_BYTES = 1 << 20
SLICE_BYTES = 2 << 20
#: Bytes of text in a shard on average, at most.
SHARD_BYTES = 16 << 20
_LAST_ID = (1 << 63) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all stretches, one after another."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(size.sum())


def _words_at(data: np.ndarray, n: int, at: int, kind: str = "<u8") -> np.ndarray:
    """The 8 bytes from each of the first ``n`` places plus ``at``, as numbers."""
    return np.ndarray((n,), kind, data, at, (1,))


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, number of windows) of the maximal runs of windows with one minimiser."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.ascontiguousarray(data)
    grams = n - GRAM + 1
    h = _words_at(raw, grams, 0) * _ODD
    h ^= h >> np.uint64(29)
    h += _words_at(raw, grams, GRAM - 8)
    h *= np.uint64(0xD1342543DE82EF95)
    h ^= h >> np.uint64(32)
    least, width, want = h, 1, LENGTH - GRAM + 1
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    out = np.zeros(n + 1, np.int32)
    ends = offsets[1:]
    np.add.at(out, np.maximum(offsets[:-1], ends - LENGTH + 1), 1)
    np.add.at(out, ends, -1)
    valid = np.cumsum(out)[: len(least)] == 0
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= new[1:] | ~valid[1:]
    start, end = np.flatnonzero(new), np.flatnonzero(last)
    return mix(least[start]) & ~np.uint64(1), start, end - start + 1


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes; groups that are still tied are refined by doubling."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = _words_at(padded, n, 0, ">u8").astype(np.uint64)
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tied = np.flatnonzero(~(head & np.append(head[1:], True)))
    h = 8
    while len(tied):
        p = sa[tied]
        ahead = p + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + h + 1, n - p)
        key = rank[p] * (n + h + 2) + second
        order = np.argsort(key, kind="stable")
        p, key = p[order], key[order]
        sa[tied] = p
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[p] = np.maximum.accumulate(np.where(head, tied, 0))
        tied = tied[~(head & np.append(head[1:], True))]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common bytes of each suffix and the one before it in order.

    By Kasai's rule the value at a place is one less than at the place before, unless the bytes in
    front of the two suffixes differ; only those places are compared, eight bytes at a time.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    fresh = (place == 0) | (before <= 0)
    fresh[1:] |= text[:-1] != text[np.maximum(before[1:] - 1, 0)]
    i = np.flatnonzero(fresh & (before >= 0))
    j = before[i]
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    eight = _words_at(padded, n + 8, 0)
    most = n - np.maximum(i, j)
    length = np.zeros(len(i), np.int64)
    active = np.arange(len(i))
    while len(active):
        at = length[active]
        differ = eight[np.minimum(i[active] + at, n)] ^ eight[np.minimum(j[active] + at, n)]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, (np.log2(np.maximum(low, 1).astype(np.float64)) // 8).astype(np.int64))
        length[active] = np.minimum(at + same, most[active])
        active = active[(differ == 0) & (at + 8 < most[active])]
    total = np.zeros(n, np.int64)
    total[i] = length + i
    return (np.maximum.accumulate(total) - place).clip(0)[sa]


def _strings(text, ends, docs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one suffix array: (window places, group of each, a place of each group, its least id).

    Groups are numbered in the order of their strings.
    """
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa)
    starts = np.concatenate([[0], ends[:-1]])
    piece = np.repeat(np.arange(len(ends)), ends - starts)
    whole = np.arange(len(text)) + LENGTH <= ends[piece]
    group = np.cumsum(lcp < LENGTH)
    inside = whole[sa]
    place, group = sa[inside], group[inside]
    head = np.concatenate([[True], group[1:] != group[:-1]])
    first = np.flatnonzero(head)
    least = np.minimum.reduceat(docs[piece[place]], first) if len(first) else np.zeros(0, np.int64)
    return place, np.cumsum(head) - 1, place[first], least


def least_ids(text: np.ndarray, sizes: np.ndarray, docs: np.ndarray, source: np.ndarray) -> np.ndarray:
    """For every window of every piece, in order, the least id of a piece that has its string."""
    order = np.argsort(source, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    windows = sizes - LENGTH + 1
    out_at = np.concatenate([[0], np.cumsum(windows)])
    out = np.empty(out_at[-1], np.int64)
    arrays = []
    bytes_so_far = np.concatenate([[0], np.cumsum(sizes[order])])
    for a, b in blocks(bytes_so_far, ARRAY_BYTES):
        own = order[a:b]
        part, ends = text[_ragged(offsets[own], sizes[own])], np.cumsum(sizes[own])
        arrays.append((own, part, ends, *_strings(part, ends, docs[own])))
    keys = [None] * len(arrays)
    if len(arrays) > 1:
        for k, (_, part, _, _, _, rep, _) in enumerate(arrays):
            rows = np.lib.stride_tricks.sliding_window_view(part, LENGTH)[rep]
            keys[k] = np.ascontiguousarray(rows).view(f"S{LENGTH}").ravel()
    for k, (own, _, ends, place, group, _, least) in enumerate(arrays):
        merged = least.copy()
        for m, other in enumerate(arrays):
            if m != k and len(keys[m]) and len(keys[k]):
                at = np.minimum(np.searchsorted(keys[m], keys[k]), len(keys[m]) - 1)
                same = keys[m][at] == keys[k]
                merged[same] = np.minimum(merged[same], other[6][at[same]])
        starts = ends - sizes[own]
        piece = np.searchsorted(ends, place, side="right")
        out[out_at[own[piece]] + place - starts[piece]] = merged[group]
    return out


def _ids(table: pa.Table) -> np.ndarray:
    column = table.column("__id").combine_chunks()
    return column.fill_null(_LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _shared_runs(table: pa.Table, shared: np.ndarray):
    """(key, hash, windows, row, place in the shard's bytes) of the runs with a shared key."""
    data, offsets = flat(table.column("__text"))
    found = []
    for a, b in blocks(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        key, start, count = runs(part, own)
        hit = _among(key, shared)
        key, start, count = key[hit], start[hit], count[hit]
        code = stretch_hashes(part, start, count + LENGTH - 1)
        row = np.searchsorted(own, start, side="right") - 1 + a
        found.append((key, code, count, row, start + offsets[a]))
    if not found:
        return data, offsets, [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 3
    return data, offsets, [np.concatenate(x) for x in zip(*found, strict=True)]


def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(len(keys), bool)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


def _bucket(key: np.ndarray, count: int) -> np.ndarray:
    return ((key >> np.uint64(20)) % np.uint64(count)).astype(np.int64)


def _unlike(data, place, like, size) -> np.ndarray:
    """Which stretches differ in a byte from the stretches ``like`` them; eight bytes at a time."""
    out = np.zeros(len(place), bool)
    others = np.flatnonzero(place != like)
    if not len(others):
        return out
    eight = _words_at(np.ascontiguousarray(data), len(data) - 7, 0)
    words = -(-size[others] // 8)
    bounds = np.concatenate([[0], np.cumsum(words)])
    for a, b in blocks(bounds, SLICE_BYTES // 8):
        k, n = others[a:b], words[a:b]
        # The last word ends where the stretch does.
        step = np.minimum(8 * _ragged(np.zeros(len(n), np.int64), n), np.repeat(size[k] - 8, n))
        differ = eight[np.repeat(place[k], n) + step] != eight[np.repeat(like[k], n) + step]
        out[k] = np.add.reduceat(differ, bounds[a:b] - bounds[a], dtype=np.int64) > 0
    return out


def _pieces(key, code, count, buckets: int, data, place, size):
    """(order of the distinct pieces by bucket, key and hash; index of each run's piece in it).

    Pieces of one hash are compared by their bytes at ``place``; where some differ, all get another hash.
    """
    while True:
        pick, index = _by_hash(key, code, count, buckets)
        differ = _unlike(data, place, place[pick[index]], size) if len(index) else np.zeros(0, bool)
        if not differ.any():
            return pick, index
        code = code.copy()
        for i in np.flatnonzero(np.isin(index, index[differ])).tolist():
            raw = data[place[i] : place[i] + size[i]].tobytes()
            digest = hashlib.blake2b(raw, digest_size=8, key=code[i].tobytes()).digest()
            code[i] = int.from_bytes(digest, "little")


def _by_hash(key, code, count, buckets: int):
    order = np.lexsort((count, code, key, _bucket(key, buckets)))
    k, c, s = key[order], code[order], count[order]
    head = np.ones(len(order), bool)
    head[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1])
    index = np.empty(len(order), np.int64)
    index[order] = np.cumsum(head) - 1
    return order[head], index


def _report(table: pa.Table, shard: int, buckets: int) -> pa.Table:
    """Step 1: a shard's minimisers by bucket; the lowest bit marks those of two documents."""
    ids = _ids(table)
    data, offsets = flat(table.column("__text"))
    keys, docs = [], []
    for a, b in blocks(offsets):
        own = offsets[a : b + 1] - offsets[a]
        key, start, _ = runs(data[offsets[a] : offsets[b]], own)
        keys.append(key)
        docs.append(ids[np.searchsorted(own, start, side="right") - 1 + a])
    key = np.concatenate(keys or [np.zeros(0, np.uint64)])
    doc = np.concatenate(docs or [np.zeros(0, np.int64)])
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    if len(first):
        two = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        key = key[first] | two.astype(np.uint64)
    at = _bucket(key, buckets)
    order = np.argsort(at, kind="stable")
    key, at = key[order], at[order]
    cut = np.searchsorted(at, np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(cut))
    return pa.table(
        {
            "bucket": pa.array(some, pa.int32()),
            "shard": pa.array(np.full(len(some), shard), pa.int32()),
            "keys": pa.array([key[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary()),
        }
    )


def _answer(table: pa.Table) -> pa.Table:
    """Step 2: of one bucket, each shard's minimisers that are shared."""
    parts = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    key = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    order = np.argsort(key >> np.uint64(1), kind="stable")
    name = key[order] >> np.uint64(1)
    new = np.concatenate([[True], name[1:] != name[:-1]])
    group = np.cumsum(new) - 1
    seen = np.bincount(group)
    two = np.bincount(group, (key[order] & np.uint64(1)).astype(float)) > 0
    shared = order[((seen > 1) | two)[group]]
    shared.sort()
    cut = np.searchsorted(owner[shared], np.arange(len(parts) + 1))
    kept = key[shared] & ~np.uint64(1)
    some = np.flatnonzero(np.diff(cut))
    shard = table.column("shard").to_numpy()
    return pa.table(
        {
            "shard": pa.array(shard[some], pa.int32()),
            "keys": pa.array([kept[cut[s] : cut[s + 1]].tobytes() for s in some], pa.binary()),
        }
    )


def _joined(table: pa.Table) -> np.ndarray:
    parts = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _pack(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, size, codec="zstd", asbytes=True), np.uint8)


_PIECES = "bucket int, shard int, keys binary, sizes binary, docs binary, text binary"
_LEAST = "shard int, bucket int, keys binary, counts binary, docs binary"


def _send(table: pa.Table, shared: np.ndarray, shard: int, buckets: int) -> pa.Table:
    """Step 3: a shard's distinct pieces with shared minimisers, by bucket."""
    ids = _ids(table)
    data, _, (key, code, count, row, place) = _shared_runs(table, shared)
    pick, index = _pieces(key, code, count, buckets, data, place, count + LENGTH - 1)
    least = np.full(len(pick), _LAST_ID)
    np.minimum.at(least, index, ids[row])
    key, size, place = key[pick], count[pick] + LENGTH - 1, place[pick]
    at = _bucket(key, buckets)
    cut = np.searchsorted(at, np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(cut))
    columns = {c: [] for c in ("keys", "sizes", "docs", "text")}
    for b in some:
        s = slice(cut[b], cut[b + 1])
        columns["keys"].append(key[s].tobytes())
        columns["sizes"].append(size[s].astype(np.int32).tobytes())
        columns["docs"].append(least[s].tobytes())
        ranges = zip(place[s].tolist(), (place[s] + size[s]).tolist(), strict=True)
        columns["text"].append(_pack(b"".join([data[x:y].tobytes() for x, y in ranges])))
    return pa.table(
        {
            "bucket": pa.array(some, pa.int32()),
            "shard": pa.array(np.full(len(some), shard), pa.int32()),
            **{c: pa.array(v, pa.binary()) for c, v in columns.items()},
        }
    )


def _solve(table: pa.Table, bucket: int) -> pa.Table:
    """Step 4: the least id of every string of one bucket, returned shard by shard in runs."""

    def column(name, kind):
        parts = [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
        return np.concatenate(parts), [len(x) for x in parts]

    key, per_row = column("keys", np.uint64)
    size = column("sizes", np.int32)[0].astype(np.int64)
    doc = column("docs", np.int64)[0]
    packed = zip(table.column("text").to_pylist(), table.column("sizes").to_pylist(), strict=True)
    text = np.concatenate([_unpack(x, int(np.frombuffer(n, np.int32).sum())) for x, n in packed])
    offsets = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(np.arange(len(per_row)), per_row)
    windows = size - LENGTH + 1
    out_at = np.concatenate([[0], np.cumsum(windows)])
    least = np.empty(out_at[-1], np.int64)
    order = np.argsort(key, kind="stable")
    group = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    bytes_to = np.concatenate([[0], np.cumsum(size[order])])
    group_end = np.append(group, len(order))
    for a, b in blocks(bytes_to[group_end], SLICE_BYTES):
        own = order[group_end[a] : group_end[b]]
        part = text[_ragged(offsets[own], size[own])]
        # Equal pieces of several shards are one, with the least id.
        at = np.concatenate([[0], np.cumsum(size[own])])
        code = stretch_hashes(part, at[:-1], size[own])
        pick, index = _pieces(key[own], code, size[own], 1, part, at[:-1], size[own])
        first = np.full(len(pick), _LAST_ID)
        np.minimum.at(first, index, doc[own])
        part = part[_ragged(at[pick], size[own][pick])]
        found = least_ids(part, size[own][pick], first, source[own][pick])
        many = windows[own][pick]
        begin = (np.cumsum(many) - many)[index]
        least[_ragged(out_at[own], windows[own])] = found[_ragged(begin, windows[own])]
    rows = np.concatenate([[0], np.cumsum(per_row)])
    columns = {"counts": [], "docs": []}
    for a, b in zip(out_at[rows[:-1]], out_at[rows[1:]], strict=True):
        part = least[a:b]
        head = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        columns["counts"].append(np.diff(np.append(head, len(part))).astype(np.int32).tobytes())
        columns["docs"].append(part[head].tobytes())
    return pa.table(
        {
            "shard": table.column("shard"),
            "bucket": pa.array(np.full(len(per_row), bucket), pa.int32()),
            "keys": table.column("keys"),
            **{c: pa.array(v, pa.binary()) for c, v in columns.items()},
        }
    )


def _covered(table: pa.Table, least: pa.Table, buckets: int):
    """(bytes, offsets, whether each byte goes, ids) of a shard."""
    ids = _ids(table)
    shared = np.unique(_joined(least))
    data, offsets, (key, code, count, row, place) = _shared_runs(table, shared)
    gone = np.zeros(len(data), bool)
    if len(key):
        pick, index = _pieces(key, code, count, buckets, data, place, count + LENGTH - 1)
        answers = sorted(
            zip(*(least.column(c).to_pylist() for c in ("bucket", "counts", "docs")), strict=True)
        )
        found = np.concatenate(
            [np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.int32)) for _, c, d in answers]
        )
        windows = count[pick]
        at = np.concatenate([[0], np.cumsum(windows)])
        change = np.zeros(len(data) + LENGTH + 1, np.int32)
        for some in range(0, len(key), 1 << 18):
            s = slice(some, some + (1 << 18))
            step = np.arange(count[s].sum()) - np.repeat(np.cumsum(count[s]) - count[s], count[s])
            hit = found[np.repeat(at[index[s]], count[s]) + step] < np.repeat(ids[row[s]], count[s])
            start = (np.repeat(place[s], count[s]) + step)[hit]
            change[start] += 1
            change[start + LENGTH] -= 1
        gone = np.cumsum(change, out=change)[: len(data)] > 0
    return data, offsets, gone


def _plan(df: DataFrame, columns: list[str], id_col: str, text_col: str):
    """The rows dealt to shards, and each shard's answers from the buckets."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # By the bytes there are, whatever the session's number of partitions.
    n_bytes = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(partitions(df), -(-n_bytes // (2 * SHARD_BYTES)))
    rows = df.select(
        *columns,
        F.col(id_col).cast("long").alias("__id"),
        text.alias("__text"),
        F.pmod(F.xxhash64(id_col, text), F.lit(2 * parts)).cast("int").alias("__shard"),
    )
    dealt = rows.groupBy("__shard")

    def report(key, table):
        frugal()
        return _report(table, key[0].as_py(), parts)

    def answer(table):
        return _answer(table)

    def send(key, table, shared):
        frugal()
        return _send(table, np.unique(_joined(shared)), key[0].as_py(), parts)

    def solve(key, table):
        frugal()
        return _solve(table, key[0].as_py())

    keys = dealt.applyInArrow(report, "bucket int, shard int, keys binary")
    shared = keys.groupBy("bucket").applyInArrow(answer, "shard int, keys binary")
    pieces = dealt.cogroup(shared.groupBy("shard")).applyInArrow(send, _PIECES)
    least = pieces.groupBy("bucket").applyInArrow(solve, _LEAST)
    return dealt.cogroup(least.groupBy("shard")), parts


def repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte ranges."""
    both, parts = _plan(df, [], id_col, text_col)

    def cut(table, least):
        frugal()
        data, offsets, gone = _covered(table, least, parts)
        n, rows = len(offsets) - 1, table.column("__id")
        removed = np.concatenate([[0], np.cumsum(gone, dtype=np.int32)])
        out = {"n_bytes": np.diff(offsets), "n_removed": removed[offsets[1:]] - removed[offsets[:-1]]}
        spans, digests = [[] for _ in range(n)], []
        for i in range(n):
            part = data[offsets[i] : offsets[i + 1]]
            if out["n_removed"][i]:
                edge = np.diff(gone[offsets[i] : offsets[i + 1]].astype(np.int8), prepend=0, append=0)
                begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                spans[i] = [{"start": a, "end": b} for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                part = part[~gone[offsets[i] : offsets[i + 1]]]
            digests.append(hashlib.sha256(part.tobytes()).hexdigest())
        pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.table(
            {
                "id": rows,
                "n_bytes": pa.array(out["n_bytes"], pa.int64()),
                "n_removed": pa.array(out["n_removed"], pa.int64()),
                "n_spans": pa.array([len(s) for s in spans], pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()),
                "spans": pa.array(spans, pa.list_(pair)),
            }
        )

    made = both.applyInArrow(
        cut,
        "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<start:long,end:long>>",
    )
    return made.withColumnRenamed("id", id_col)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, their other columns unchanged, with the kept bytes as text.

    A byte range may end inside a character; the bytes left over of it are dropped, so that the
    text stays valid UTF-8. A null text stays null.
    """
    columns = df.columns
    both, parts = _plan(df, columns, id_col, text_col)

    def cut(table, least):
        frugal()
        data, offsets, gone = _covered(table, least, parts)
        kept = table.column(text_col).to_pylist()
        removed = np.concatenate([[0], np.cumsum(gone, dtype=np.int32)])
        for i in np.flatnonzero(removed[offsets[1:]] - removed[offsets[:-1]]).tolist():
            s = slice(offsets[i], offsets[i + 1])
            kept[i] = data[s][~gone[s]].tobytes().decode("utf-8", "ignore")
        out = table.select(columns)
        at = out.schema.get_field_index(text_col)
        return out.set_column(at, out.schema.field(at), pa.array(kept, out.schema.field(at).type))

    return both.applyInArrow(cut, df.schema)
