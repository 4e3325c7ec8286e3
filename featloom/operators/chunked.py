"""Grouped statistics of vector columns.

A vector is cut into chunks of ``CHUNK`` entries, and the entries of a chunk
are aggregated as plain columns. That emits ``width / CHUNK`` rows per vector
rather than ``width``, keeps every aggregate on generated code (which stops
above 100 fields), needs no width at plan time and combines map-side, so a
group that holds a third of the rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 32

# Mean of a position, NaN counted as missing.
MEAN = "avg(CASE WHEN NOT isnan({x}) THEN {x} END)"


def chunks(vec: Column, size: int = CHUNK) -> Column:
    """``vec`` as an array of slices."""
    starts = F.when(F.size(vec) > 0, F.sequence(F.lit(1), F.size(vec), F.lit(size)))
    return F.transform(starts, lambda i: F.slice(vec, i, size))


def aggregate_chunks(
    df: DataFrame,
    keys: list[str],
    vec: Column,
    entry: str,
    carry: dict[str, Column] | None = None,
    size: int = CHUNK,
    groups: DataFrame | None = None,
    width: int | None = None,
    keep_empty: bool = False,
) -> DataFrame:
    """Group by ``keys`` and chunk; ``entry`` aggregates one vector position.

    ``entry`` is SQL over ``{x}``, the value at the position: as text, dozens
    of cells cost one call to the JVM instead of several each. Returns
    ``keys, chunk, entries, width`` and the aggregates of ``carry``, whose input
    columns must be columns of ``df``. ``entries`` has null cells behind the end
    of the last chunk; :func:`positions` and :func:`gather` drop them.

    ``groups`` holds distinct keys that must be in the result even
    without a vector, as null entries up to ``width``: they join the
    aggregate's input rather than its output. With ``keep_empty`` rows without
    a vector form a chunk of their own, which :func:`gather` leaves out.
    """
    inputs = [c for c in df.columns if c not in keys]
    cut = df.select(
        *keys,
        *inputs,
        F.size(vec).alias("_width"),
        (F.posexplode_outer if keep_empty else F.posexplode)(chunks(vec, size)).alias(
            "chunk", "_slice"
        ),
    )
    if groups is not None:
        empty = groups.select(
            *keys,
            F.lit(width).alias("_width"),
            F.explode(F.sequence(F.lit(0), F.lit((width - 1) // size))).alias("chunk"),
        )
        cut = cut.unionByName(empty, allowMissingColumns=True)
    cells = ", ".join(entry.replace("{x}", f"get(_slice, {i})") for i in range(size))
    extra = [c.alias(name) for name, c in (carry or {}).items()]
    return cut.groupBy(*keys, "chunk").agg(
        F.expr(f"array({cells})").alias("entries"), F.max("_width").alias("width"), *extra
    )


def positions(grouped: DataFrame, keys: list[str], size: int = CHUNK) -> DataFrame:
    """One row per vector position: ``keys, pos, value``."""
    return (
        grouped.select(
            *keys, "chunk", "width", F.posexplode("entries").alias("_i", "value")
        )
        .select(*keys, (F.col("chunk") * size + F.col("_i")).alias("pos"), "value", "width")
        .where(F.col("pos") < F.col("width"))
        .drop("width")
    )


def gather(grouped: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """One row per group with its chunks joined in order: at most ``width`` cells."""
    part = F.when(F.col("chunk").isNotNull(), F.struct("chunk", "entries"))
    parts = F.array_sort(F.collect_list(part))
    whole = F.flatten(F.transform(parts, lambda p: p["entries"]))
    width = F.max(F.when(F.col("chunk").isNotNull(), F.col("width")))
    return grouped.groupBy(*keys).agg(
        F.when(width.isNotNull(), F.slice(whole, F.lit(1), width)).alias(vec)
    )
