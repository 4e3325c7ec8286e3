"""Ranked lexical search: the best documents of each item by range-maximum tables over posting lists.

Documents are cut into shards of bounded size inside the tasks that read them. A shard keeps, for every
term of the items, its postings in document order with their impact on a score, and a sparse table
that names the posting of the greatest impact in any range. The search of an item opens document
intervals best first: an interval's bound is the sum of the range maxima of the item's terms in it,
its split is the document of the greatest of them, which is scored exactly; the halves on both sides
are opened if their bounds can still beat the item's last place. All open items of a shard move on
together, as flat arrays.

A task carries the best documents from shard to shard, and a short first pass over all shards sets a
score that is reached already by as many documents as are wanted; neither changes a result.

Terms are runs of digits, letters and characters above U+007F; ASCII capitals count as small. Null and
empty texts have no term: such a document is not counted and never found, such an item finds nothing.
Equal scores go by ascending id, a null id last. Repeated documents are ranked one by one; repeated
items with equal id and text are answered once, texts under one id each for themselves. Empty tables
give an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpoint, frugal, map_arrow
from .terms import LETTERS_DIGITS, stretches

#: Places of an item.
TOP = 10
#: Bytes of different item texts searched in one pass over the documents; a longer text is a pass alone.
PASS_BYTES = 4 << 20
#: Postings of a shard; a document with more is a shard alone.
SHARD_POSTINGS = 1 << 19
#: Terms of the items of a shard that are searched together; an item with more is searched alone.
OPEN_TERMS = 1 << 11
#: Intervals an item opens at once, or a third of its open ones if that is more.
OPEN = 8
#: Rounds of the first pass.
FIRST_ROUNDS = 3

_POSTINGS = "n long, terms binary, counts binary"


def bags(text: bytes) -> Counter:
    """How often each term occurs in a text."""
    found: Counter = Counter()
    for words in stretches(text, LETTERS_DIGITS):
        found.update(words)
    return found


def postings(df: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(id, n, terms, counts) of each document with a term: number of terms, vocabulary codes, frequencies."""
    key_type = df.schema[key].dataType.simpleString()
    known = vocabulary.keys()

    def task(batch):
        rows, sizes, codes, counts = [], [], [], []
        for i, value in enumerate(batch[1]):
            found = bags(value.as_py() or b"")
            if not found:
                continue
            both = found.keys() & known
            rows.append(i)
            sizes.append(sum(found.values()))
            codes.append(np.array([vocabulary[w] for w in both], np.int32).tobytes())
            counts.append(np.array([found[w] for w in both], np.int32).tobytes())
        if rows:
            columns = [batch[0].take(pa.array(rows)), pa.array(sizes, pa.int64()), pa.array(codes), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "terms", "counts"])

    rows = df.select(F.col(key), F.col(text).cast("binary"))
    return map_arrow(rows, task, f"id {key_type}, {_POSTINGS}")


def statistics(found: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(documents, terms of all documents with repeats, documents of each vocabulary term)."""

    def task(batches):
        held = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            if batch.num_rows:
                codes = np.frombuffer(b"".join(batch["terms"].to_pylist()), np.int32)
                held[:-2] += np.bincount(codes, minlength=n_terms)
                held[-2] += batch.num_rows
                held[-1] += pc.sum(batch["n"]).as_py()
        met = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(held[met])], names=["at", "n"])

    out = np.zeros(n_terms + 2, np.int64)
    for r in found.select("n", "terms").mapInArrow(task, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]  # one row a term of the pass
    return int(out[-2]), int(out[-1]), out[:-2]


def weights(n_docs: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)


def lengths(n: np.ndarray, n_docs: int, n_all: int) -> np.ndarray:
    """100 times the length of a document against the mean, three quarters of it, in whole numbers."""
    if len(n) and 75 * int(n.max()) * n_docs >= 1 << 63:
        share = np.array([75 * x * n_docs // n_all for x in n.tolist()], np.int64)
    else:
        share = 75 * n * n_docs // max(n_all, 1)
    return 25 + share


class RangeMax:
    """The place of the greatest value in any range, the first of equal ones; ranges up to ``most`` long."""

    def __init__(self, values: np.ndarray, most: int):
        self.values = values
        levels, width = [np.arange(len(values), dtype=np.int32)], 1
        while 2 * width <= most:
            a, b = levels[-1][:-width], levels[-1][width:]
            levels.append(np.where(values[b] > values[a], b, a))
            width *= 2
        self.base = np.cumsum([0, *map(len, levels)])
        self.flat = np.concatenate(levels)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = np.frexp((b - a).astype(float))[1] - 1
        base = self.base[level]
        i, j = self.flat[base + a], self.flat[base + b - (1 << level)]
        return np.where(self.values[j] > self.values[i], j, i)


@dataclass
class Shard:
    """Postings of some documents, by term and then by place of the document in the shard."""

    starts: np.ndarray  # first posting of each term, and the end
    keys: np.ndarray  # term * documents + place
    impact: np.ndarray
    greatest: RangeMax
    least_id: RangeMax  # of the ranks of ids, negated
    ranks: np.ndarray

    @property
    def size(self) -> int:
        return len(self.ranks)


def build(codes, counts, per_doc, length, ranks, weight) -> Shard:
    """A shard of documents with ``per_doc`` postings each.

    Documents are placed by their most frequent term and then by length, so that neighbours are alike
    and the maxima of a range come from documents like each other.
    """
    n = len(per_doc)
    doc = np.repeat(np.arange(n), per_doc)
    top = np.zeros(n, np.int64)
    if len(doc):
        order = np.lexsort((codes, -counts, doc))
        first = np.flatnonzero(np.append(True, np.diff(doc[order])))
        top[doc[order[first]]] = codes[order[first]]
    order = np.lexsort((ranks, length, top))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    w = weight[codes]
    impact = w * (1_000_000_000 * counts // (1000 * counts + 8 * length[doc]))
    use = impact > 0
    keys = codes[use] * np.int64(n) + place[doc[use]]
    by = np.argsort(keys)
    keys, impact = keys[by], impact[use][by]
    starts = np.searchsorted(keys, np.arange(len(weight) + 1) * np.int64(n))
    most = int(np.diff(starts).max(initial=1))
    placed = ranks[order]
    return Shard(starts, keys, impact, RangeMax(impact, most), RangeMax(-placed, n), placed)


@dataclass
class Intervals:
    """Open intervals of several items; the entries are the terms an interval still holds, flat."""

    item: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    count: np.ndarray  # entries of each interval, one at least
    term: np.ndarray
    times: np.ndarray
    a: np.ndarray
    b: np.ndarray
    bound: np.ndarray | None = None
    split: np.ndarray | None = None
    least: np.ndarray | None = None

    def own(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.item)), self.count)

    def take(self, keep: np.ndarray) -> Intervals:
        e = np.repeat(keep, self.count)
        by_interval = [x[keep] if x is not None else None for x in (self.bound, self.split, self.least)]
        return Intervals(
            self.item[keep], self.lo[keep], self.hi[keep], self.count[keep],
            self.term[e], self.times[e], self.a[e], self.b[e], *by_interval,
        )

    def joined(self, other: Intervals) -> Intervals:
        names = self.__dataclass_fields__
        return Intervals(*[np.concatenate([getattr(self, f), getattr(other, f)]) for f in names])


def _judged(shard: Shard, x: Intervals) -> Intervals:
    """The bounds of intervals, and the document each is split at."""
    at = shard.greatest(x.a, x.b)
    most = x.times * shard.impact[at]
    first = np.cumsum(x.count) - x.count
    x.bound = np.add.reduceat(most, first) if len(first) else np.zeros(0, np.int64)
    top = np.maximum.reduceat(most, first) if len(first) else x.bound
    own = x.own()
    hit = np.flatnonzero(most == top[own])
    chosen = hit[np.searchsorted(own[hit], np.arange(len(first)))]
    x.split = shard.keys[at[chosen]] - x.term[chosen] * np.int64(shard.size)
    x.least = shard.ranks[shard.least_id(x.lo, x.hi)]
    return x


def _opened(shard: Shard, x: Intervals) -> tuple[np.ndarray, Intervals]:
    """(exact score of each interval's split document, the intervals on both sides of it)."""
    own = x.own()
    key = x.term * np.int64(shard.size) + x.split[own]
    p = np.searchsorted(shard.keys, key)
    there = shard.keys[np.minimum(p, len(shard.keys) - 1)] == key
    part = np.where(there, x.times * shard.impact[np.minimum(p, len(shard.keys) - 1)], 0)
    score = np.add.reduceat(part, np.cumsum(x.count) - x.count)
    n = len(x.item)
    left, right = p > x.a, x.b > p + there
    owner = np.concatenate([own[left], own[right] + n])
    count = np.bincount(owner, minlength=2 * n)
    some = count > 0
    sides = Intervals(
        np.tile(x.item, 2)[some],
        np.concatenate([x.lo, x.split + 1])[some],
        np.concatenate([x.split, x.hi])[some],
        count[some],
        np.concatenate([x.term[left], x.term[right]]),
        np.concatenate([x.times[left], x.times[right]]),
        np.concatenate([x.a[left], (p + there)[right]]),
        np.concatenate([p[left], x.b[right]]),
    )
    return score, sides


class Best:
    """The best places of each item so far: scores and ids as ranks; an empty place has score 0."""

    def __init__(self, n_items: int, top: int, floor: np.ndarray):
        self.score = np.zeros((n_items, top), np.int64)
        self.rank = np.full((n_items, top), np.iinfo(np.int64).max)
        self.floor = floor

    def passes(self, item: np.ndarray, score: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Whether a document of this score and id, or a better one, would get a place."""
        last = self.score[item, -1]
        beats = (score > last) | ((score == last) & (rank < self.rank[item, -1]))
        return beats & (score >= np.maximum(self.floor[item], 1))

    def add(self, item: np.ndarray, score: np.ndarray, rank: np.ndarray) -> None:
        good = self.passes(item, score, rank)
        if not good.any():
            return
        items, top = np.unique(item[good]), self.score.shape[1]
        code = np.concatenate([np.repeat(np.arange(len(items)), top), np.searchsorted(items, item[good])])
        scores = np.concatenate([self.score[items].ravel(), score[good]])
        ranks = np.concatenate([self.rank[items].ravel(), rank[good]])
        order = np.lexsort((ranks, -scores, code))
        code = code[order]
        place = np.arange(len(code)) - np.searchsorted(code, code)
        order = order[place < top]
        self.score[items] = scores[order].reshape(-1, top)
        self.rank[items] = ranks[order].reshape(-1, top)


def search(shard: Shard, items: list[tuple[int, np.ndarray, np.ndarray]], best: Best, rounds: int | None = None) -> None:
    """Brings the best documents of the shard into ``best``; items are (code, terms, times).

    Without ``rounds`` every interval whose bound could still give a place has been opened at the end.
    """
    item, count, term, times = [], [], [], []
    for code, t, c in items:
        t_in = shard.starts[t + 1] > shard.starts[t]
        if t_in.any():
            item.append(code)
            count.append(int(t_in.sum()))
            term.append(t[t_in])
            times.append(c[t_in])
    if not item:
        return
    term, n = np.concatenate(term), len(item)
    x = Intervals(
        np.array(item), np.zeros(n, np.int64), np.full(n, shard.size), np.array(count),
        term, np.concatenate(times), shard.starts[term], shard.starts[term + 1],
    )
    x = _judged(shard, x)
    while True:
        x = x.take(best.passes(x.item, x.bound, x.least))
        if not len(x.item) or rounds == 0:
            return
        if rounds is not None:
            rounds -= 1
        order = np.lexsort((x.least, -x.bound, x.item))
        sorted_item = x.item[order]
        start = np.searchsorted(sorted_item, sorted_item)
        size = np.searchsorted(sorted_item, sorted_item, side="right") - start
        now = np.zeros(len(order), bool)
        now[order[np.arange(len(order)) - start < np.maximum(OPEN, size // 3)]] = True
        taken = x.take(now)
        score, sides = _opened(shard, taken)
        best.add(taken.item, score, shard.ranks[taken.split])
        rest = x.take(~now)
        if len(sides.item):
            sides = _judged(shard, sides)
            rest = rest.joined(sides.take(best.passes(sides.item, sides.bound, sides.least)))
        x = rest


def _together(items: list, most: int = OPEN_TERMS):
    """Items in groups of at most ``most`` terms, or of one item with more."""
    group, size = [], 0
    for item in items:
        if group and size + len(item[1]) > most:
            yield group
            group, size = [], 0
        group.append(item)
        size += len(item[1])
    if group:
        yield group


def _shards(batches, most: int):
    """Rows of batches as (ids, n, postings of each row, codes, counts) with at most ``most`` postings."""
    for batch in batches:
        start = 0
        sizes = np.array([len(v.as_buffer()) // 4 for v in batch["terms"]], np.int64)
        ends = np.cumsum(sizes)
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = max(int(np.searchsorted(ends, before + most, side="right")), start + 1)
            part = batch.slice(start, end - start)
            codes, counts = (
                np.frombuffer(b"".join(part[c].to_pylist()), np.int32).astype(np.int64) for c in ("terms", "counts")
            )
            yield part["id"], part["n"].to_numpy(), sizes[start:end], codes, counts
            start = end


def best_of_tasks(found: DataFrame, items: list, stats, top: int, floor: np.ndarray, rounds: int | None = None) -> DataFrame:
    """(item, id, score): the best documents of each task for every item."""
    n_docs, n_all, held = stats
    weight = weights(n_docs, held)
    id_type = found.schema["id"].dataType.simpleString()

    def task(batches):
        frugal()
        ids = None
        best = Best(len(floor), top, floor)
        for more, n, sizes, codes, counts in _shards(batches, SHARD_POSTINGS):
            # The places kept so far get their ranks among the ids of this shard.
            kept = best.score > 0
            pool = more if ids is None else pa.concat_arrays([more, ids])
            order = pc.sort_indices(pool, null_placement="at_end").to_numpy()
            rank = np.empty(len(pool), np.int64)
            rank[order] = np.arange(len(pool))
            best.rank[kept] = rank[len(more) :]
            shard = build(codes, counts, sizes, lengths(n, n_docs, n_all), rank[: len(more)], weight)
            if len(shard.keys):
                for group in _together(items):
                    search(shard, group, best, rounds)
            kept = best.score > 0
            ids = pool.take(pa.array(order[best.rank[kept]]))
        if ids is not None and len(ids):
            item = np.nonzero(best.score > 0)[0]
            score = best.score[best.score > 0]
            yield pa.RecordBatch.from_arrays([pa.array(item), ids, pa.array(score)], names=["item", "id", "score"])
        frugal()

    return found.mapInArrow(task, f"item long, id {id_type}, score long")


def _ranked(best: DataFrame, top: int) -> DataFrame:
    """The first places of each item; a task sends on at most ``top`` rows an item."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    place = F.row_number().over(W.partitionBy("item").orderBy(*order))
    return best.withColumn("rank", place).where(F.col("rank") <= top)


def _pass(documents: DataFrame, texts: list[tuple[str, bytes]], key: str, text: str, top: int) -> DataFrame:
    """(digest, rank, id, score) of the item texts of one pass."""
    found = [(digest, bags(value)) for digest, value in texts]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*(f for _, f in found))))}
    items = []
    for i, (_, bag) in enumerate(found):
        codes = np.array([vocabulary[w] for w in bag], np.int64)
        items.append((i, codes, np.array(list(bag.values()), np.int64)))
    rows = checkpoint(postings(documents, vocabulary, key, text))
    stats = statistics(rows, len(vocabulary))
    floor = np.zeros(len(items), np.int64)
    first = _ranked(best_of_tasks(rows, items, stats, top, floor, FIRST_ROUNDS), top)
    for r in first.where(F.col("rank") == top).collect():  # one row an item of the pass
        floor[r["item"]] = r["score"]
    best = _ranked(best_of_tasks(rows, items, stats, top, floor), top)
    names = documents.sparkSession.createDataFrame(
        [(i, digest) for i, (digest, _) in enumerate(texts)], "item long, __digest string"
    )
    return checkpoint(best.join(F.broadcast(names), "item").select("__digest", "rank", "id", "score"))


def ranked_search(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    item: str = "item_id",
    text: str = "text",
    top: int = TOP,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """(item, rank, key, score): the ``top`` best documents of each item with a score above 0.

    Different item texts are read to the driver ``pass_bytes`` at a time, each time for one pass over
    the documents whose result is written; so is what the driver ever holds.
    """
    asked = items.select(F.col(item).alias("__item"), F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    asked = asked.withColumn("__digest", F.sha2(F.col("__text").cast("binary"), 256))
    texts = checkpoint(asked.groupBy("__digest").agg(F.first("__text").alias("__text")))
    size = texts.agg(F.sum(F.octet_length("__text") + 64)).first()[0] or 0
    n_passes = size // pass_bytes + 1
    number = F.pmod(F.xxhash64("__digest"), F.lit(n_passes))
    answers = []
    for i in range(n_passes):
        block = texts.where(number == i).select("__digest", F.col("__text").cast("binary")).collect()
        if block:
            answers.append(_pass(documents, [(r[0], bytes(r[1])) for r in block], key, text, top))
    if not answers:
        kinds = f"{item} {items.schema[item].dataType.simpleString()}, rank int, "
        kinds += f"{key} {documents.schema[key].dataType.simpleString()}, score long"
        return documents.sparkSession.createDataFrame([], kinds)
    found = answers[0]
    for more in answers[1:]:
        found = found.unionByName(more)
    named = asked.select("__item", "__digest").distinct().join(found, "__digest")
    return named.select(F.col("__item").alias(item), "rank", F.col("id").alias(key), "score")
