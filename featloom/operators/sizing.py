"""Size checks for data that is small by nature but not by contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes a hinted broadcast may have: Spark's own automatic broadcast size.
BROADCAST_BYTES = 10 << 20


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row by its column types, texts and nested values taken as long ones."""
    return sum(256 if f.dataType.simpleString()[:3] in ("str", "arr", "map") else 16 for f in df.schema)


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows, reading no more than needed."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(
    small: DataFrame, probe: DataFrame | None = None, rows: int | None = None
) -> DataFrame:
    """``small`` with a broadcast hint when it proves to be small, else without.

    The estimate of an aggregate's size is the size of its input, so without
    the hint a large table joined to its own statistics would be shuffled by
    the statistics' key, which may have two values. ``probe`` is a cheaper
    frame of the same row count, such as the distinct group keys.
    """
    limit = BROADCAST_BYTES // row_bytes(small) if rows is None else rows
    return F.broadcast(small) if has_at_most(small if probe is None else probe, limit) else small


def width_of(df: DataFrame, vec: str) -> int:
    """The one width of all vectors of a column, from every row; different widths are an error.

    Reads the column's sizes now: pass the width where it is known and keep the plan lazy.
    """
    size = F.when(F.col(vec).isNotNull(), F.size(vec))
    row = df.agg(F.min(size).alias("least"), F.max(size).alias("most")).first()
    if row["most"] is None:
        raise ValueError(f"no vector in column {vec!r}: pass the width")
    if row["least"] != row["most"]:
        raise ValueError(f"vectors of widths {row['least']} to {row['most']} in {vec!r}")
    return row["most"]
