"""Importance resampling towards a target: array-scored weights, winners by distributed quickselect.

Features of a text are its runs of one and two consecutive words, hashed into buckets. A bucket's gain
is the logarithm of its share in the target over its share in the documents, a document's weight the
mean gain of its features, its score the weight plus Gumbel noise from its id. The highest scores are
drawn; that is sampling without replacement in proportion to the exponential of the weight.

The k-th best row is found without sorting the table: each round takes random pivot keys among the rows
still open, counts exactly how many rows lie before, at and after each, and keeps the gap that holds
the k-th. Only the rows up to it are sorted, by range, and numbered with the counts of the ranges.

Words are runs of digits, letters and characters above U+007F; ASCII capitals count as small. Null and
empty texts have no feature, weight 0 and are never drawn. A null id counts as empty in the noise and
comes last among ties. Repeated rows are rows of their own; of equal rows as many as have room are drawn.
Empty documents give an empty result, an empty target gives gains against no target feature. Columns
other than id and text are not read.
"""

from __future__ import annotations

from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpoint, map_arrow, partitions
from .terms import LETTERS_DIGITS, stretches

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Pivots of a round; each round leaves about one part in PIVOTS + 1 of the open rows.
PIVOTS = 15
#: Exponent of the noise: 2**32 values of the hash.
_SPACE = 1 << 32


def bucket_ids(text: bytes, buckets: int = BUCKETS):
    """Bucket of every feature of a text, as arrays of one bounded stretch each.

    The checksum of two words goes on from that of the first and the blank.
    """
    before: list[int] = []
    for words in stretches(text, LETTERS_DIGITS):
        one = list(map(crc32, words))
        with_blank = before + list(map(crc32, repeat(b" ", len(one)), one))
        both = words if before else words[1:]
        two = list(map(crc32, both, with_blank))
        before = with_blank[-1:]
        yield len(one), np.array(one + two, np.uint32) % np.uint32(buckets)


def bucket_counts(df: DataFrame, text: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket; a task sends one row for each bucket it met."""

    def task(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch[0]:
                for _, ids in bucket_ids(value.as_py() or b"", buckets):
                    counts += np.bincount(ids, minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["bucket", "n"])

    texts = df.select(F.col(text).cast("binary"))
    return texts.mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, in thousandths: ``buckets`` numbers, whatever the size of the tables."""
    rows = []
    for counts in (documents, target):
        row = np.zeros(buckets)
        for r in counts.collect():  # one row a bucket
            row[r.bucket] = r.n
        rows.append(row)
    s, t = rows
    share = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def weigh(df: DataFrame, gain: np.ndarray, key: str, text: str) -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    key_type = df.schema[key].dataType.simpleString()

    def task(batch):
        out = np.zeros((3, batch.num_rows), np.int64)
        for i, value in enumerate(batch[1]):
            words = features = total = 0
            for n, ids in bucket_ids(value.as_py() or b"", len(gain)):
                words += n
                features += len(ids)
                total += int(gain[ids].sum())
            out[:, i] = words, features, total // features if features else 0
        yield pa.RecordBatch.from_arrays(
            [batch[0], *map(pa.array, out)], names=["id", "n_words", "n_features", "weight"]
        )

    rows = df.select(F.col(key), F.col(text).cast("binary"))
    return map_arrow(rows, task, f"id {key_type}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 8 hex digits of sha256 of seed and key."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / _SPACE)))


def _before(order: list[str], row: tuple) -> Column:
    """Whether a row comes before ``row`` in ascending order of the columns, nulls last."""
    out = F.lit(False)
    for name, value in reversed(list(zip(order, row, strict=True))):
        c = F.col(name)
        if value is None:
            out = c.isNotNull() | out
        else:
            out = F.coalesce(c < F.lit(value), F.lit(False)) | (c.eqNullSafe(F.lit(value)) & out)
    return out


def _same(order: list[str], row: tuple) -> Column:
    out = F.lit(True)
    for name, value in zip(order, row, strict=True):
        out = out & F.col(name).eqNullSafe(F.lit(value))
    return out


def kth(rows: DataFrame, order: list[str], k: int, pivots: int = PIVOTS, seed: int = SEED):
    """(key of the k-th row, rows before it, rows equal to it) in ascending order of the columns.

    ``k`` counts from 1; None if there are fewer rows. Distributed quickselect: a round is one job that
    draws random pivots among the open rows and one that counts the rows before and at each of them.
    Rows of one key leave together, so a group of equal keys is met once at most.
    """
    keys, skipped, turn = rows.select(*order), 0, 0
    while True:
        turn += 1
        mixed = F.xxhash64(F.lit(seed + turn), *order)
        drawn = {tuple(r)[1:] for r in keys.select(mixed.alias("__at"), *order).orderBy("__at").limit(pivots).collect()}
        if not drawn:
            return None
        drawn = list(drawn)
        counts = keys.agg(
            *[F.count_if(_before(order, p)) for p in drawn], *[F.count_if(_same(order, p)) for p in drawn]
        ).first()
        found = sorted(zip(counts[: len(drawn)], counts[len(drawn) :], drawn, strict=True), key=lambda x: x[0])
        low = None
        for n, same, pivot in found:
            if skipped + n >= k:
                keys = keys.where(_before(order, pivot))
                break
            if skipped + n + same >= k:
                return pivot, skipped + n, same
            low = (n + same, pivot)
        if low:
            skipped += low[0]
            keys = keys.where(~_before(order, low[1]) & ~_same(order, low[1]))


def ranked(rows: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """Distinct ``order`` rows with a count ``n``, as that many rows numbered from 1 in this order.

    Rows and their copies are sorted by range; only the sizes of the ranges are summed over all.
    """
    each = rows.where("n > 0").withColumn("__copy", F.explode(F.expr("sequence(1L, n)"))).drop("n")
    by = [*[F.col(c).asc_nulls_last() for c in order], F.col("__copy")]
    placed = checkpoint(each.repartitionByRange(partitions(rows), *by).sortWithinPartitions(*by))
    at = F.monotonically_increasing_id()  # the range in the high bits, the place in it below
    placed = placed.withColumn("__at", at).withColumn("__part", F.shiftright("__at", 33))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("size"))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("__part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("__start"))
    number = F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(starts), "__part").select(*[c for c in rows.columns if c != "n"], number.alias(out))


def resample(
    documents: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """(key, n_features, weight, score, rank) of every document; rank is null where it is not drawn.

    ``percent`` of the documents with at least ``least_words`` words are drawn, highest scores first,
    ties to the smaller key.
    """
    gain = gains(bucket_counts(documents, text, buckets), bucket_counts(target, text, buckets), buckets)
    scored = weigh(documents, gain, key, text).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = checkpoint(scored.withColumn("down", -F.col("score")))
    able = scored.where(F.col("n_words") >= least_words)
    order = ["down", "id", "n_features"]
    k = percent * able.count() // 100
    at = kth(able, order, k) if k > 0 else None
    columns = ["id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if at is None:
        return scored.select(*columns, none).withColumnRenamed("id", key)
    last, n_before, _ = at
    ahead, level = _before(order, last), _same(order, last)
    drawn = (F.col("n_words") >= least_words) & (ahead | level)
    groups = (
        scored.where(drawn)
        .groupBy("down", *columns)
        .agg(F.count("*").alias("n"))
        .withColumn("n", F.when(level, F.least("n", F.lit(k - n_before))).otherwise(F.col("n")))
    )
    winners = ranked(groups, order).select(*columns, "rank")
    # Of the rows at the k-th key, which are equal in every column of the result, some have no room.
    left = (
        scored.where((F.col("n_words") >= least_words) & level)
        .groupBy(*columns)
        .agg((F.count("*") - F.lit(k - n_before)).alias("n"))
        .where("n > 0")
        .select(*columns, F.explode(F.expr("sequence(1L, n)")).alias("rank"))
        .withColumn("rank", F.lit(None).cast("long"))
    )
    rest = scored.where(~drawn).select(*columns, none)
    return rest.unionByName(left).unionByName(winners).withColumnRenamed("id", key)
