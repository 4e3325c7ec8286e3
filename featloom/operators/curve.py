"""Clustering of rows on a space-filling curve over two keys.

A table sorted by one key answers lookups by that key from few files and by the other from all. Along
a Hilbert curve over the rank codes of both a file covers a small range of each, so that a lookup by
either reads about the square root of the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks of a key: 2**BITS ranges of about equally many rows.
BITS = 8
#: Rows whose keys the ranges are taken from, about; the keys of a table with fewer rows are all read.
SAMPLE_ROWS = 50_000


def range_bounds(df: DataFrame, keys: list[str] | tuple[str, ...], bits: int = BITS, sample: int = SAMPLE_ROWS) -> dict[str, list]:
    """For each key the values that cut the rows into up to ``2**bits`` ranges; a frequent value is one cut.

    The rows are those of the least hash, the same in each run. The driver gets at most ``2**bits`` values of a key.
    """
    rows, total = df.select(*keys), df.count()
    if total > sample:
        # Of all columns, so that the rows of a frequent key are drawn one by one.
        rows = df.where(F.xxhash64(*df.columns) < -(1 << 63) + int(sample / total * (1 << 64))).select(*keys)
    out = {}
    for key in keys:
        counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
        cut = F.expr(f"ceil(sum(n) OVER (ORDER BY `{key}`) * {1 << bits} / sum(n) OVER ())")
        ends = counts.select(key, cut.alias("cut")).groupBy("cut").agg(F.max(key).alias("end"))
        out[key] = sorted(r["end"] for r in ends.collect())[:-1]
    return out


def rank_code(key: Column, bounds: list, bits: int = BITS) -> Column:
    """Which range the key is in, by bisection, spread over ``[0, 2**bits)``; null is with the least keys."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(bits))])
    cuts = F.array(*map(F.lit, bounds))
    below = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: at + F.when(F.get(cuts, at + step - 1) < key, step).otherwise(0),
    )
    return F.floor(below * (1 << bits) / (len(bounds) + 1))


def curve_place(x: Column, y: Column, bits: int = BITS) -> Column:
    """Place of the cell (x, y) on the Hilbert curve, whose stretches cover compact areas.

    From the coarsest square to the finest: which quarter the cell is in, then the quarter turned so
    that it is entered where the one before it is left.
    """
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    sides = F.array(*[F.lit(1 << i).cast("long") for i in reversed(range(bits))])

    def quarter(at: Column, side: Column) -> Column:
        right = at["x"].bitwiseAND(side) > 0
        upper = at["y"].bitwiseAND(side) > 0
        nth = F.when(right, F.when(upper, 2).otherwise(3)).otherwise(F.when(upper, 1).otherwise(0))
        flip = right & ~upper
        last = F.lit((1 << bits) - 1).cast("long")
        fx = F.when(flip, last - at["x"]).otherwise(at["x"])
        fy = F.when(flip, last - at["y"]).otherwise(at["y"])
        return F.struct(
            F.when(upper, fx).otherwise(fy).alias("x"),
            F.when(upper, fy).otherwise(fx).alias("y"),
            (at["d"] + side * side * nth).alias("d"),
        )

    return F.aggregate(sides, start, quarter, lambda at: at["d"])


def clustered(df: DataFrame, keys: tuple[str, str], bits: int = BITS, files: int | None = None) -> DataFrame:
    """The rows in partitions along the curve over two ``keys``, sorted along it inside.

    Rows that share all keys may span partitions. Reads the rows' number and a sample of keys now.
    """
    bounds = range_bounds(df, keys, bits)
    place = curve_place(*[rank_code(F.col(k), bounds[k], bits) for k in keys], bits)
    others = [f.name for f in df.schema if f.name not in keys and f.dataType.typeName() not in ("map", "variant")]
    order = ["_place", *keys, *others]
    placed = df.withColumn("_place", place)
    ranged = placed.repartitionByRange(*order) if files is None else placed.repartitionByRange(files, *order)
    return ranged.sortWithinPartitions(*order[: 1 + len(keys)]).drop("_place")
