"""Pooling of token vectors into one vector per sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from featloom.operators import chunked

MASK_FLOOR = 1e-9
RUN_BLOCK = 1 << 16


def mean_pool(
    tokens: DataFrame,
    seq: str = "seq_id",
    vec: str = "vec",
    mask: str | None = "mask",
) -> DataFrame:
    """Masked mean per sequence; without a mask, the plain mean over time.

    A missing vector does not count; a sequence of nothing else gets a null vector. Vectors of two
    widths in one sequence fail the query.
    """
    weight = F.lit(1.0) if mask is None else F.col(mask).cast("double")
    rows = tokens.select(seq, F.col(vec).alias("_v"), weight.alias("_m"))
    sums = chunked.aggregate_chunks(
        rows,
        [seq],
        F.col("_v"),
        "sum(cast({x} AS double) * _m)",
        carry={"_total": F.sum("_m"), "_least": F.min("_width")},
        keep_empty=True,
    )
    floor = F.greatest(F.col("_total"), F.lit(MASK_FLOOR))
    name = F.coalesce(F.col(seq).cast("string"), F.lit("null"))
    wrong = F.raise_error(F.concat(F.lit("vectors of several widths in sequence "), name))
    mean = F.transform("entries", lambda s: s / floor)
    means = sums.withColumn("entries", F.when(F.col("_least").eqNullSafe(F.col("width")), mean).otherwise(wrong))
    return chunked.gather(means, [seq], vec)


def running_total(
    df: DataFrame,
    keys: list[str],
    pos: str,
    value: str,
    out: str,
    block: int = RUN_BLOCK,
) -> DataFrame:
    """Cumulative sum of ``value`` along ``pos`` within each key.

    Long sequences are cut into blocks of positions. Totals of the blocks give
    each block its offset, so no task ever holds a whole sequence.
    """
    blocked = df.withColumn("_block", F.floor(F.col(pos) / block))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*keys, "_block")
        .agg(F.sum(value).alias("_sum"))
        .select(*keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    )
    inside = W.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    return (
        blocked.withColumn("_run", F.sum(value).over(inside))
        .join(offsets, [*keys, "_block"])
        .withColumn(out, F.col("_base") + F.col("_run"))
        .drop("_block", "_run", "_base")
    )


def last_pool(
    tokens: DataFrame,
    seq: str = "seq_id",
    pos: str = "pos",
    vec: str = "vec",
    mask: str = "mask",
    right_padded: bool = False,
) -> DataFrame:
    """Vector at index ``cumsum(mask)[max(sum(mask) - 1, 0)] - 1``.

    Index -1 means the last position. For right-padded masks that is the last
    real token; say so with ``right_padded`` and one map-side-combined
    aggregate replaces the join on positions. Otherwise positions must be 0, 1,
    2, ... in every sequence; a gap or another start fails the query.
    """
    if right_padded:
        real = F.col(mask) == 1
        chosen = F.coalesce(
            F.max_by(F.when(real, F.col(vec)), F.when(real, F.col(pos))), F.max_by(vec, pos)
        )
        return tokens.groupBy(seq).agg(chosen.alias(vec))
    marks = tokens.select(seq, pos, F.col(mask).cast("long").alias("_m"))
    count, at = F.count("*"), F.col(pos).cast("long")
    dense = (F.max(at) == count - 1) & (F.min(at) == 0) & (F.sum(at) == count * (count - 1) / 2)
    wrong = F.raise_error(F.concat(F.lit("positions are not 0, 1, 2, ... in "), F.first(seq).cast("string")))
    ends = marks.groupBy(seq).agg(
        F.sum("_m").alias("_n"), F.when(dense, F.max(pos)).otherwise(wrong).alias("_last")
    )
    # The cumulative sum at position n - 1 is the count of marks up to there.
    index = (
        marks.join(ends, seq)
        .groupBy(seq)
        .agg(
            F.sum(F.when(F.col(pos) <= F.greatest(F.col("_n") - 1, F.lit(0)), F.col("_m")))
            .alias("_run"),
            F.max("_last").alias("_last"),
        )
        .select(
            seq,
            F.when(F.col("_run") == 0, F.col("_last")).otherwise(F.col("_run") - 1).alias(pos),
        )
    )
    return tokens.select(seq, pos, vec).join(index, [seq, pos]).select(seq, vec)


POOLERS = {"mean": mean_pool, "last": last_pool}


def pool(tokens: DataFrame, mode: str = "mean", **columns) -> DataFrame:
    """Pool by name: ``mean`` or ``last``."""
    return POOLERS[mode](tokens, **columns)
