"""Tables of a SQL server."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    partitions: int = 64,
    predicates: list[str] | None = None,
    fetch_size: int = 10_000,
    **options: str,
) -> DataFrame:
    """Full scan of a table.

    One connection reads everything unless the read is split: by ranges of a
    numeric, date or timestamp ``partition_column``, whose ends the server is
    asked for, or by ``predicates``, one task each, for keys that are text or
    uneven. Column selections and filters are pushed to the server.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    reader = reader.option("fetchsize", fetch_size)
    if predicates:
        return spark.read.jdbc(
            url, table, predicates=predicates, properties={**options, "fetchsize": str(fetch_size)}
        )
    if partition_column is None:
        return reader.option("dbtable", table).load()
    ends = f"SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi FROM {table}"
    low, high = reader.option("query", ends).load().first()
    source = spark.read.format("jdbc").option("url", url).options(**options)
    source = source.option("fetchsize", fetch_size).option("dbtable", table)
    if low is None:
        return source.load()
    return (
        source.option("partitionColumn", partition_column)
        .option("lowerBound", str(low))
        .option("upperBound", str(high))
        .option("numPartitions", partitions)
        .load()
    )
