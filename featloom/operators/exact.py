"""Sums, means and spreads that are equal to the last bit however the rows are dealt out.

A sum of doubles depends on the order of its terms. Here each term is cut, at fixed places of the binary
scale, into two whole numbers of a bin of ``BIN`` exponents; whole numbers add up exactly in any order.
The bins of a group, a bounded number, are put together in their order at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Exponents of a bin, and the bins of all doubles; the lowest holds what is smaller too.
BIN = 32
LEAST, MOST = -28, 31


def _power(bins: Column, of) -> Column:
    """The power of two ``2 ** of(k)`` for bin k, from a table."""
    return F.get(F.array(*[F.lit(2.0 ** of(k)) for k in range(LEAST, MOST + 1)]), bins - LEAST)


def exact_moments(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys, column, n, mean, std`` (sample) of the values that are there, NaN counted as missing.

    Bit for bit the same under any partitioning and order. Squares are rounded one by one; the spread
    is that of the two sums, so it has about ``1e-16 * (1 + mean**2 / std**2)`` relative error. A group
    without a value of a column has no row for it; infinite values, or squares, fail the query.
    """
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    long = df.select(*keys, F.inline(values)).where(F.col("v").isNotNull() & ~F.isnan("v"))
    terms = F.array(
        F.struct(F.lit(1).alias("kind"), F.col("v").alias("t")),
        F.struct(F.lit(2).alias("kind"), (F.col("v") * F.col("v")).alias("t")),
    )
    infinite = F.raise_error(F.concat(F.lit("infinite sum in column "), F.col("column"))).cast("double")
    each = long.select(*keys, "column", F.inline(terms)).withColumn(
        "t", F.when(F.abs("t") < float("inf"), F.col("t")).otherwise(infinite)
    )
    # The exponent may be off by one next to a power of two, in every run alike: the scale leaves room.
    exponent = F.when(F.col("t") == 0, F.lit(float(LEAST * BIN))).otherwise(F.log2(F.abs("t")))
    each = each.withColumn("bin", F.floor(exponent / BIN).cast("int"))
    each = each.withColumn("bin", F.greatest(F.least("bin", F.lit(MOST)), F.lit(LEAST)))
    each = each.withColumn("y", F.col("t") * _power(F.col("bin"), lambda k: 54 - BIN * k))
    high = F.floor(F.col("y") / F.lit(2.0**32))
    low = F.col("y") - high * F.lit(2.0**32)
    sums = each.groupBy(*keys, "column", "kind", "bin").agg(
        F.sum(high.cast("decimal(20,0)")).alias("high"),
        F.sum(F.floor(low).cast("decimal(20,0)")).alias("low"),
        F.count("*").alias("n"),
    )
    part = (F.col("high").cast("double") * F.lit(2.0**32) + F.col("low").cast("double")) * _power(
        F.col("bin"), lambda k: BIN * k - 54
    )
    bins = sums.select(*keys, "column", "n", F.struct("kind", "bin", part.alias("part")).alias("bin"))
    whole = bins.groupBy(*keys, "column").agg(
        F.sort_array(F.collect_list("bin")).alias("bins"),
        F.sum(F.when(F.col("bin.kind") == 1, F.col("n"))).alias("n"),
    )

    def total(kind: int) -> Column:
        mine = F.filter("bins", lambda b: b["kind"] == kind)
        return F.aggregate(mine, F.lit(0.0), lambda a, b: a + b["part"])

    n = F.col("n").cast("double")
    square = F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / n, F.lit(0.0))
    return whole.withColumns({"_s": total(1), "_q": total(2)}).select(
        *keys, "column", "n", (F.col("_s") / n).alias("mean"), F.sqrt(F.try_divide(square, n - 1)).alias("std")
    )
