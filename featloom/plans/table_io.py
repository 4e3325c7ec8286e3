"""Move whole tables between CSV, the catalog and a SQL server."""

from __future__ import annotations

from pyspark.sql import SparkSession

from featloom.sinks import tables
from featloom.sources.csv import read_csv
from featloom.sources.jdbc import read_table


def csv_to_table(spark: SparkSession, csv: str, table: str, wide_ints: bool = False) -> None:
    """CSV as a typed catalog table of complete rows; an existing table is an error."""
    tables.save_typed(read_csv(spark, csv), table, wide_ints=wide_ints)


def csv_to_jdbc(spark: SparkSession, csv: str, url: str, table: str, **options) -> None:
    """CSV as a typed table of complete rows on a SQL server."""
    tables.write_jdbc(read_csv(spark, csv), url, table, **options)


def jdbc_to_csv(spark: SparkSession, url: str, table: str, target: str, **options) -> None:
    """A table of a SQL server as CSV files with headers."""
    tables.write_csv(read_table(spark, url, table, **options), target)
