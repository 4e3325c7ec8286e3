"""Secrets in whole texts: three fixed patterns, and a conditional random field that adds spans.

A token is a run of letters, digits, low lines and characters above U+007F, or one other character that
is no white space. The field tags tokens as begin of a secret, inside or outside, from the token's shape
(length, kinds of characters, hexadecimal, changes of kind), its own and its neighbours' names, whether it
touches them, and features of the whole file (shares of digits, signs and capitals, length of lines).
A chain is a line; a line longer than CHAIN bytes is cut at a blank, or anywhere if it has none.

It is trained on windows around the values that the patterns find (assigned values, access keys,
hexadecimal runs with letters and digits) and on windows of other documents, at most WINDOWS of each from
about TRAIN_DOCS documents. Each value is seen again as random characters of other alphabets and lengths,
so that the shape of the given ones is not all that counts. Without any such value nothing is added.

Spans are in characters, end exclusive. Null and empty texts have none. Repeated rows get a row each; an
empty table gives an empty result. Columns other than text are only passed through, whatever they hold.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import BLOCK_BYTES, blocks, checkpoint, flat, map_arrow

KINDS = ("assign", "access", "hex", "tagged")
#: Documents looked at for training, about; windows of either kind in the training sample.
TRAIN_DOCS = 200_000
WINDOWS = 3000
#: Bytes of context on each side of a value in a window.
CONTEXT = 120
#: Bytes of a chain.
CHAIN = 1 << 16

# The patterns of the contract, with the least length of what they must catch.
ASSIGN = re.compile(
    rb"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    rb"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
#: One of these, in small letters, is in every text that ASSIGN matches.
_HINTS = (b"passw", b"secret", b"token", b"api")

_BLANK, _LOWER, _UPPER, _DIGIT, _LOW_LINE, _OTHER, _SIGN = 0, 1, 2, 4, 8, 16, 32


def _classes() -> np.ndarray:
    out = np.full(256, _SIGN, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = _BLANK
    out[48:58], out[65:91], out[97:123], out[95], out[128:] = _DIGIT, _UPPER, _LOWER, _LOW_LINE, _OTHER
    return out


_CLASS = _classes()
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
_ANY_HEX = _HEX.copy()
_ANY_HEX[65:71] = True
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32

#: Names are hashed into so many codes.
NAMES = 1 << 12
_LENGTHS = np.array([1, 2, 3, 4, 6, 8, 11, 15, 19, 31, 39, 63])  # upper ends of the classes of length
_N_LENGTHS = len(_LENGTHS) + 1
_CHANGES = np.array([0, 1, 2, 4, 8, 16])
_N_CHANGES = len(_CHANGES) + 1
_SHARES = np.array([0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4])
_N_SHARES = len(_SHARES) + 1
#: Number of codes of each feature, in the order of ``features``.
SIZES = [
    _N_LENGTHS * 64, _N_LENGTHS * 4, _N_LENGTHS * _N_CHANGES, NAMES, NAMES, NAMES, NAMES, NAMES, 16,
    _N_SHARES * _N_LENGTHS, _N_SHARES * _N_LENGTHS, _N_SHARES * _N_LENGTHS,
]


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, start of the value) of all pattern matches, as places in the flat bytes."""
    found = []
    for i in range(len(offsets) - 1):
        at = int(offsets[i])
        text = data[at : int(offsets[i + 1])].tobytes()
        small = text.lower()
        if any(h in small for h in _HINTS):
            for m in ASSIGN.finditer(text):
                if m.end(1) - m.start(1) >= LEAST_ASSIGN:
                    found.append((0, at + m.start(), at + m.end(), at + m.start(1)))
        if b"AKIA" in text:
            for m in ACCESS.finditer(text):
                if m.end() - m.start() >= LEAST_ACCESS:
                    found.append((1, at + m.start(), at + m.end(), at + m.start()))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = _HEX[data]
    begin, end = inside.copy(), inside
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    long = b - a >= LEAST_HEX
    found += [(2, x, y, x) for x, y in zip(a[long].tolist(), b[long].tolist(), strict=True)]
    return found


def values(data: np.ndarray, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """What training calls a secret: the matched values, joined where they meet; numbers alone are none."""
    ranges = []
    for kind, _, end, start in found:
        if kind == 2:
            shape = np.bitwise_or.reduce(_CLASS[data[start:end]])
            if shape & (_DIGIT | _LOWER) != _DIGIT | _LOWER:
                continue
        ranges.append((start, end))
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def chains(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chains begin, and the end: at texts and lines, and inside lines that are too long."""
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    size = np.diff(cuts)
    if not (size > CHAIN).any():
        return cuts
    more = []
    for start, end in zip(cuts[:-1][size > CHAIN].tolist(), cuts[1:][size > CHAIN].tolist(), strict=True):
        while end - start > CHAIN:
            blank = np.flatnonzero(_CLASS[data[start + CHAIN // 2 : start + CHAIN]] == _BLANK)
            start += CHAIN // 2 + int(blank[-1]) + 1 if len(blank) else CHAIN
            more.append(start)
    return np.union1d(cuts, more).astype(np.int64)


def file_codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Classes of the shares of digits, signs and line ends of each whole text: 3 numbers a text."""
    size = np.diff(offsets)
    out = np.zeros((len(size), 3), np.int64)
    some = size > 0
    if some.any():
        shape = _CLASS[data]
        for k, hit in enumerate((shape == _DIGIT, shape == _SIGN, (data == 10) | (shape == _UPPER))):
            counts = np.add.reduceat(hit, offsets[:-1][some], dtype=np.int64)
            out[some, k] = np.searchsorted(_SHARES, counts / size[some])
    return out


def tokens(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, chain) of every token of the chains that begin at ``cuts``."""
    shape = _CLASS[data]
    sign = shape == _SIGN
    word = (shape != _BLANK) & ~sign
    edge = np.zeros(len(data) + 1, bool)
    edge[cuts] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:-1]
    end = word
    end[:-1] &= ~word[1:] | edge[1:-1]
    a = np.flatnonzero(begin | sign)
    b = np.flatnonzero(end | sign) + 1
    return a, b, np.searchsorted(cuts, a, side="right") - 1


def _names(data: np.ndarray, a: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A code of each token's length and first eight bytes, capitals as small letters."""
    padded = np.concatenate([_SMALL[data], np.zeros(8, np.uint8)])
    key = np.minimum(size, 63).astype(np.uint64)
    for k in range(8):
        byte = np.where(size > k, padded[a + k], 0).astype(np.uint64)
        key = (key << np.uint64(7)) ^ (key >> np.uint64(57)) ^ byte
    key *= np.uint64(0x9E3779B97F4A7C15)
    return (key >> np.uint64(52)).astype(np.int64)


def features(data: np.ndarray, a: np.ndarray, b: np.ndarray, chain: np.ndarray, files: np.ndarray) -> list[np.ndarray]:
    """The codes of each token; ``files`` has the file codes of each chain."""
    size = b - a
    length = np.searchsorted(_LENGTHS, size)
    shape = _CLASS[data]
    kinds = np.bitwise_or.reduceat(shape, a).astype(np.int64)
    not_hex = np.add.reduceat((shape != _BLANK) & ~_ANY_HEX[data], a, dtype=np.int64)
    is_digit = shape == _DIGIT
    turn = np.zeros(len(data), bool)
    turn[1:] = (is_digit[1:] != is_digit[:-1]) & (shape[1:] != _BLANK) & (shape[:-1] != _BLANK)
    turn[a] = False
    changes = np.searchsorted(_CHANGES, np.add.reduceat(turn, a, dtype=np.int64))
    mixed = (kinds & _DIGIT > 0) & (kinds & (_LOWER | _UPPER) > 0)
    name = _names(data, a, size)
    n = len(a)

    def shifted(k: int) -> np.ndarray:
        """Names ``k`` tokens back (ahead if negative) in the same chain; 0 beyond it."""
        out = np.zeros(n, np.int64)
        if abs(k) < n:
            here, there = (slice(k, None), slice(None, -k)) if k > 0 else (slice(None, k), slice(-k, None))
            same = chain[here] == chain[there]
            out[here][same] = name[there][same]
        return out

    touch = np.zeros(n + 1, np.int64)
    touch[1:-1] = (a[1:] == b[:-1]) & (chain[1:] == chain[:-1])
    sign = np.zeros(n + 1, np.int64)
    sign[:-1] = kinds == _SIGN
    around = touch[:-1] + 2 * touch[1:] + 4 * (sign[:-1] > 0) + 8 * (np.append(0, sign[:-2]) > 0)
    of_file = files[chain]
    return [
        length * 64 + kinds,
        length * 4 + (not_hex == 0) + 2 * mixed,
        length * _N_CHANGES + changes,
        name, shifted(1), shifted(2), shifted(3), shifted(-1),
        around,
        *(of_file[:, k] * _N_LENGTHS + length for k in range(3)),
    ]


def tagged_spans(data: np.ndarray, offsets: np.ndarray, field: crf.Field) -> list[tuple[int, int]]:
    """(start, end) of what the field tags as secrets, as places in the flat bytes."""
    cuts, files = chains(data, offsets), file_codes(data, offsets)
    # Texts of no byte begin where the next one does: the last of them has the chains.
    text = np.searchsorted(offsets, cuts[:-1], side="right") - 1
    out = []
    for first, last in blocks(cuts, BLOCK_BYTES):
        at, piece = int(cuts[first]), data[cuts[first] : cuts[last]]
        a, b, chain = tokens(piece, cuts[first : last + 1] - at)
        if not len(a):
            continue
        codes = features(piece, a, b, chain, files[text[first:last]])
        starts = np.flatnonzero(np.append(True, chain[1:] != chain[:-1]))
        tags = crf.viterbi(field, field.emissions(codes), starts)
        inside = tags != crf.OUTSIDE
        if not inside.any():
            continue
        new_chain = np.append(True, chain[1:] != chain[:-1])
        before = np.append(False, inside[:-1])
        begin = inside & ((tags == crf.BEGIN) | ~before | new_chain)
        after = np.append(~inside[1:] | begin[1:], True)
        end = inside & after
        out += zip((a[begin] + at).tolist(), (b[end] + at).tolist(), strict=True)
    return out


def all_spans(data: np.ndarray, offsets: np.ndarray, field: crf.Field | None):
    """(kind, start, end) of each text, in bytes of the flat data: matches, and tagged spans apart from them."""
    n = len(offsets) - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    base = sorted((s, k, e) for k, s, e, _ in base_spans(data, offsets))
    taken = []
    for s, k, e in base:
        out[int(np.searchsorted(offsets, s, side="right")) - 1].append((k, s, e))
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(e, taken[-1][1])
        else:
            taken.append([s, e])
    if field is not None and len(data):
        starts = np.array([t[0] for t in taken], np.int64)
        for s, e in tagged_spans(data, offsets, field):
            i = int(np.searchsorted(starts, e, side="left")) - 1  # the last match that begins before its end
            if i < 0 or taken[i][1] <= s:
                out[int(np.searchsorted(offsets, s, side="right")) - 1].append((3, s, e))
    return [sorted(x, key=lambda y: (y[1], y[0], y[2])) for x in out]


def _windows(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray):
    """Training windows: (has a value, file codes, bytes, value ranges) around values and at one other place a text."""
    found = values(data, base_spans(data, offsets))
    owner = [int(np.searchsorted(offsets, s, side="right")) - 1 for s, _ in found]
    files = file_codes(data, offsets)
    by_text: dict[int, list[tuple[int, int]]] = {}
    for i, r in zip(owner, found, strict=True):
        by_text.setdefault(i, []).append(r)
    for i in np.flatnonzero(np.diff(offsets)).tolist():
        low, high = int(offsets[i]), int(offsets[i + 1])
        own = by_text.get(i, [])
        wanted = [(s, e, True) for s, e in own if e - s <= 4 * CONTEXT]
        s = low + int(hashes[i]) % (high - low)
        wanted.append((s, s, False))
        for s, e, has in wanted:
            a, b = max(low, s - CONTEXT), min(high, e + CONTEXT)
            before = np.flatnonzero(data[a:s] == 10)
            after = np.flatnonzero(data[e:b] == 10)
            a = a + int(before[-1]) + 1 if len(before) else a
            b = e + int(after[0]) if len(after) else b
            # Whole words only: a cut word at either end goes.
            a += next(iter(np.flatnonzero(_CLASS[data[a:s]] == _BLANK)), -1) + 1 if a > low else 0
            tail = np.flatnonzero(_CLASS[data[e:b]] == _BLANK)
            b = e + int(tail[-1]) if len(tail) and b < high else b
            inside = [(x - a, y - a) for x, y in own if x < b and y > a]
            if any(x < 0 or y > b - a for x, y in inside) or b <= a or bool(inside) != has:
                continue
            yield has, files[i], data[a:b].tobytes(), inside


def examples(df: DataFrame, text: str, train_docs: int = TRAIN_DOCS, windows: int = WINDOWS) -> list[tuple]:
    """At most ``windows`` different windows with a value and as many without, those of the least hash."""
    total = df.count()
    near = df.select(F.col(text).cast("binary").alias("t"))
    if total > train_docs:
        near = near.where(F.xxhash64("t") < -(1 << 63) + int(train_docs / total * (1 << 64)))

    def task(batch):
        data, offsets = flat(batch[0])
        for start, end in blocks(offsets):
            part = data[offsets[start] : offsets[end]]
            own = offsets[start : end + 1] - offsets[start]
            hashes = np.array([crc32(part[a:b]) for a, b in zip(own[:-1], own[1:], strict=True)])
            rows = list(_windows(part, own, hashes))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows]),
                        pa.array([r[1].astype(np.int32).tobytes() for r in rows]),
                        pa.array([r[2] for r in rows], pa.binary()),
                        pa.array([np.array(r[3], np.int32).tobytes() for r in rows]),
                    ],
                    names=["has", "file", "window", "ranges"],
                )

    found = checkpoint(map_arrow(near, task, "has boolean, file binary, window binary, ranges binary").distinct())
    mixed = F.xxhash64("window", "file", "ranges")
    out = []
    for has in (True, False):
        some = found.where(F.col("has") == has).orderBy(mixed, "window", "file").limit(windows)
        for r in some.collect():  # at most ``windows`` rows of some hundred bytes
            ranges = np.frombuffer(bytes(r.ranges), np.int32).reshape(-1, 2).tolist()
            out.append((np.frombuffer(bytes(r.file), np.int32), bytes(r.window), [tuple(x) for x in ranges]))
    return out


_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
_ALPHABETS = (
    b"0123456789abcdef",
    b"0123456789ABCDEF",
    _LETTERS.upper() + b"0123456789",
    _LETTERS + _LETTERS.upper() + b"0123456789",
    _LETTERS + _LETTERS.upper() + b"0123456789+/-_",
)


def varied(window: bytes, ranges: list[tuple[int, int]], rng: np.random.Generator):
    """The window with every value replaced by random characters of one alphabet."""
    out, made, at = b"", [], 0
    for start, end in ranges:
        out += window[at:start]
        letters = np.frombuffer(_ALPHABETS[rng.integers(len(_ALPHABETS))], np.uint8)
        value = rng.choice(letters, int(rng.integers(16, 49))).tobytes()
        made.append((len(out), len(out) + len(value)))
        out, at = out + value, end
    return out + window[at:], made


def _chain(file: np.ndarray, window: bytes, ranges: list[tuple[int, int]]):
    """(codes, tags) of a window."""
    data = np.frombuffer(window, np.uint8)
    a, b, chain = tokens(data, np.array([0, len(data)]))
    if not len(a):
        return None
    codes = np.stack(features(data, a, b, chain, file[None, :]), axis=1)
    tags = np.full(len(a), crf.OUTSIDE)
    for start, end in ranges:
        hit = np.flatnonzero((a < end) & (b > start))
        tags[hit] = crf.INSIDE
        tags[hit[:1]] = crf.BEGIN
    return codes, tags


def learn(df: DataFrame, text: str = "text", train_docs: int = TRAIN_DOCS, windows: int = WINDOWS, seed: int = 0) -> crf.Field | None:
    """A field trained on the texts' own pattern matches; None if there is no match to learn from."""
    rng = np.random.default_rng(seed)
    rows, any_value = [], False
    for file, window, ranges in examples(df, text, train_docs, windows):
        rows.append(_chain(file, window, ranges))
        if ranges:
            any_value = True
            rows.append(_chain(file, *varied(window, ranges, rng)))
    if not any_value:
        return None
    return crf.train(SIZES, [r for r in rows if r is not None], seed=seed)


def find_secrets(df: DataFrame, field: crf.Field | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``spans``, an array of (kind, start, end) by start, then kind as in KINDS.

    A kept column may not be called spans.
    """
    if "spans" in keep:
        raise ValueError("a kept column is named like the result: spans")
    n_keep = len(keep)

    def task(batch):
        data, offsets = flat(batch[n_keep])
        for first, last in blocks(offsets):
            part = data[offsets[first] : offsets[last]]
            own = offsets[first : last + 1] - offsets[first]
            rows = []
            for i, spans in enumerate(all_spans(part, own, field)):
                if spans:
                    lead = part[own[i] : own[i + 1]] & 0xC0 != 0x80  # first bytes of characters
                    upto = np.append(0, np.cumsum(lead))
                    spans = [
                        {"kind": KINDS[k], "start": int(upto[s - own[i]]), "end": int(upto[e - own[i]])} for k, s, e in spans
                    ]
                rows.append(spans)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            columns = [batch[c].slice(first, last - first) for c in range(n_keep)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], names=[f"c{c}" for c in range(n_keep)] + ["spans"])

    rows = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).cast("binary").alias("t"))
    kinds = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.select(*keep).schema)]
    schema = ", ".join([*kinds, "spans array<struct<kind:string,start:bigint,end:bigint>>"])
    return map_arrow(rows, task, schema).toDF(*keep, "spans")
