"""Dense row numbers, exact splits and batch numbers without a global sort.

A ``row_number`` over a whole table runs in one task. Here rows are ordered by
a shuffle key spread evenly over ``[0, 2**KEY_BITS)``. Its top bits name a
bucket, the bucket counts (at most ``2**BUCKET_BITS`` numbers) give every
bucket its offset, and rows are ranked inside their bucket only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

KEY_BITS = 32
BUCKET_BITS = 16
COPY_BLOCK = 1 << 16


def hash_key(columns: list[str], seed: int = 0) -> Column:
    """Evenly spread shuffle key from the content of ``columns``."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << KEY_BITS))


def _bucket(key: str) -> Column:
    return F.shiftright(key, KEY_BITS - BUCKET_BITS)


def _in_range(key: Column) -> Column:
    """A caller's shuffle key, failing the query outside ``[0, 2**KEY_BITS)``."""
    key = key.cast("long")
    wrong = F.raise_error(F.concat(F.lit("shuffle key out of range: "), key.cast("string")))
    return F.when(key.between(0, (1 << KEY_BITS) - 1), key).otherwise(wrong)


def _sortable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]


def _is_even(keyed: DataFrame) -> bool:
    """Whether no bucket is far above the mean: one thin scan, combined map-side."""
    sizes = keyed.groupBy("_bucket").count()
    row = sizes.agg(F.max("count").alias("top"), F.sum("count").alias("total")).first()
    return (row["top"] or 0) <= COPY_BLOCK + 4 * (row["total"] or 0) / (1 << BUCKET_BITS)


def _offsets(keyed: DataFrame, weight: Column) -> DataFrame:
    """Rows before each bucket: at most ``2**BUCKET_BITS`` rows by construction."""
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return (
        keyed.groupBy("_bucket")
        .agg(F.sum(weight).alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )


def dense_index(
    df: DataFrame, shuffle_key: Column | None = None, seed: int = 0, out: str = "idx"
) -> DataFrame:
    """Number all rows 0, 1, 2, ... in a reproducible shuffled order.

    The order is that of ``shuffle_key``, by default a seeded hash of the whole
    row, then of two more hashes of the row, so it depends on the rows alone,
    not on how they are partitioned and not on how many copies there are. A
    supplied key must be spread evenly over ``[0, 2**KEY_BITS)``; one outside
    fails the query.

    Copies of one row cannot be told apart by any key, and enough of them
    would overload their bucket. The bucket counts show that beforehand; then
    copies are collapsed map-side, numbered by range and spread out again in
    blocks.
    """
    columns = df.columns
    key = hash_key(columns, seed) if shuffle_key is None else _in_range(shuffle_key)
    keyed = df.withColumn("_key", key).withColumn("_bucket", _bucket("_key"))
    hashes = {f"_h{s}": F.xxhash64(F.lit(s), *_sortable(df)) for s in (1, 2)}
    if _is_even(keyed):
        return _rank(keyed.withColumns(hashes), ["_key", "_h1", "_h2"], F.lit(1)).select(
            *columns, (F.col("_base") + F.col("_start")).alias(out)
        )
    units = (
        keyed.groupBy(*columns, "_key", "_bucket")
        .agg(F.count("*").alias("_copies"))
        .withColumns(hashes)
        .withColumn("_block", F.explode(F.expr(f"sequence(0L, (_copies - 1) div {COPY_BLOCK})")))
        .withColumn(
            "_n", F.least(F.lit(COPY_BLOCK), F.col("_copies") - F.col("_block") * COPY_BLOCK)
        )
    )
    identity = ["_h1", "_h2", "_block"]
    thin = units.select("_key", "_bucket", *identity, "_n")
    starts = _rank(thin, ["_key", *identity], F.col("_n")).select(
        *identity, (F.col("_base") + F.col("_start")).alias("_start")
    )
    numbered = units.join(starts, identity)
    numbers = F.sequence(F.col("_start"), F.col("_start") + F.col("_n") - 1)
    return numbered.select(*columns, F.explode(numbers).alias(out))


def _rank(keyed: DataFrame, order: list[str], weight: Column) -> DataFrame:
    before = W.partitionBy("_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(weight).over(before), F.lit(0))
    offsets = _offsets(keyed, weight)
    return keyed.withColumn("_start", start).join(F.broadcast(offsets), "_bucket")


def exact_split(
    df: DataFrame,
    fraction: float = 0.8,
    key: list[str] | None = None,
    seed: int = 0,
    shuffle_key: Column | None = None,
    out: str = "split",
) -> DataFrame:
    """Tag exactly ``int(fraction * rows)`` rows ``train``, the others ``validation``.

    Two small histograms of the shuffle key find the value where the cut falls,
    and every other row is tagged by comparison: no row moves. Only rows that
    share the cut value are ranked. The histograms are read now, when the plan
    is built. Name ``key`` columns to hash those alone and keep the scans narrow.
    """
    columns = df.columns
    hashed = hash_key(key or columns, seed) if shuffle_key is None else _in_range(shuffle_key)
    keyed = df.withColumn("_key", hashed)
    low_bits = KEY_BITS - BUCKET_BITS

    def tagged(rows: DataFrame, is_train: Column) -> DataFrame:
        return rows.select(*columns, F.when(is_train, "train").otherwise("validation").alias(out))

    coarse = _cut(keyed.groupBy(_bucket("_key").alias("part")).count(), fraction=fraction)
    if coarse is None:
        return tagged(keyed, F.lit(True))
    inside = keyed.where(_bucket("_key") == coarse["part"])
    low = F.col("_key").bitwiseAND((1 << low_bits) - 1)
    fine = _cut(
        inside.groupBy(low.alias("part")).count(), wanted=coarse["wanted"] - coarse["before"]
    )
    cut = (coarse["part"] << low_bits) + fine["part"]
    room = fine["wanted"] - fine["before"]
    if room == fine["count"]:
        return tagged(keyed, F.col("_key") <= cut)
    ties = dense_index(keyed.where(F.col("_key") == cut).select(*columns), seed=seed, out="_rank")
    clear = keyed.where(F.col("_key") != cut)
    return tagged(clear, F.col("_key") < cut).unionByName(tagged(ties, F.col("_rank") < room))


def _cut(counts: DataFrame, fraction: float | None = None, wanted: int | None = None):
    """First part whose running count reaches the wanted rows: one row of numbers.

    ``counts`` has at most ``2**BUCKET_BITS`` rows, whatever the table's size.
    """
    running = F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("count").over(W.partitionBy())
    goal = F.floor(F.lit(fraction) * total) if wanted is None else F.lit(wanted)
    return (
        counts.select("part", "count", running.alias("run"), goal.cast("long").alias("wanted"))
        .where("run >= wanted")
        .orderBy("part")
        .select("part", "count", "wanted", (F.col("run") - F.col("count")).alias("before"))
        .first()
    )


def assign_batches(
    df: DataFrame,
    size: int,
    seed: int = 0,
    shuffle_key: Column | None = None,
    out: str = "batch_id",
) -> DataFrame:
    """Cut the shuffled order into batches of ``size``; the last may be smaller."""
    numbered = dense_index(df, shuffle_key, seed, out="_idx")
    return numbered.withColumn(out, F.floor(F.col("_idx") / size)).drop("_idx")


def shuffled(
    df: DataFrame, key: list[str], seed: int = 0, shuffle_key: Column | None = None
) -> DataFrame:
    """Rows in a reproducible random order, that of a seeded hash or of ``shuffle_key``."""
    first = F.xxhash64(F.lit(seed), *key) if shuffle_key is None else shuffle_key
    return df.orderBy(first, *key)
