"""Name -> query and its SQL form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.workload.views import Views, with_views


@dataclass(frozen=True)
class Query:
    build: Callable[[Views], DataFrame]
    ids: str
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(ids: str, sql: str | None = None):
    """Register a function of :class:`Views` under its name.

    ``ids`` lists the operators it shows; ``sql`` is written from their
    semantics, for another engine.
    """

    def register(build: Callable[[Views], DataFrame]):
        if build.__name__ in REGISTRY:
            raise ValueError(build.__name__)
        REGISTRY[build.__name__] = Query(build, ids, sql and with_views(sql))
        return build

    return register


def r6(c: Column | str) -> Column:
    """Six decimals, without negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def longs(df: DataFrame, *names: str) -> DataFrame:
    """Whole numbers in the width SQL gives them."""
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def cells(df: DataFrame, ids: list[str], vec: str, digits: int = 6) -> DataFrame:
    """Vector cells as rows ``ids, pos, value`` with rounded values."""
    rounded = F.round(F.col("value").cast("double"), digits) + F.lit(0.0)
    exploded = df.select(*ids, F.posexplode(vec).alias("pos", "value"))
    return longs(exploded.withColumn("value", rounded), "pos")
