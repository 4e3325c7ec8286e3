"""CSV with a header and pandas' missing-value tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom import fixed
from featloom.functions.text import null_if_token
from featloom.sources.records import csv_texts

INT, DOUBLE, BOOL, TEXT, MISSING = 1, 2, 4, 8, 16


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    na_tokens: list[str] = fixed.PANDAS_NA,
    multi_line: bool | str = True,
) -> DataFrame:
    """Read CSV; missing-value tokens, and NaN, become null.

    Columns go by the names in the header, which must be the same in every file
    of ``path``; a schema picks and casts them by name, and a name it has but
    the header lacks is an error. Without a schema, types are inferred from all
    rows in one aggregate: whole numbers, then numbers, then True/False, then
    text; a whole-number column with missing values is double.
    ``multi_line`` lets quoted values hold line breaks, but then a file is one
    task. For large files pass ``"split"``, which reads splits in parallel, twice
    (:mod:`featloom.sources.records`), or False where no value has a line break.
    """
    raw = _texts(spark, path, multi_line)
    if schema is None:
        return typed_cells(raw, na_tokens)
    raw = _without_tokens(raw, na_tokens)
    if missing := [n for n in schema.names if n not in raw.columns]:
        raise ValueError(f"not in the header: {', '.join(missing)}")
    return raw.select(*[_cast(f).alias(f.name) for f in schema])


def read_wide_csv(
    spark: SparkSession,
    path: str | list[str],
    text_columns: list[str],
    na_tokens: list[str] = fixed.PANDAS_NA,
    multi_line: bool | str = True,
) -> DataFrame:
    """A feature file: the named columns as text, the others as doubles, without reading it first."""
    raw = _without_tokens(_texts(spark, path, multi_line), na_tokens)
    kinds = [
        T.StructField(n, T.StringType() if n in text_columns else T.DoubleType())
        for n in raw.columns
    ]
    return raw.select(*[_cast(f).alias(f.name) for f in kinds])


def typed_cells(raw: DataFrame, na_tokens: list[str] = fixed.PANDAS_NA) -> DataFrame:
    """An all-text frame with missing tokens as null and inferred types, read once for them."""
    raw = _without_tokens(raw, na_tokens)
    return raw.select(*[_cast(f).alias(f.name) for f in infer_schema(raw)])


def _without_tokens(raw: DataFrame, na_tokens: list[str]) -> DataFrame:
    return raw.select(*[null_if_token(F.col(f"`{n}`"), na_tokens).alias(n) for n in raw.columns])


def _texts(spark: SparkSession, path: str | list[str], multi_line: bool | str) -> DataFrame:
    """All columns as text under the header's names; files with another header fail the query."""
    if multi_line not in (True, False, "split"):
        raise ValueError(f"multi_line: {multi_line}")
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    reader = reader.option("multiLine", multi_line is True).option("escape", '"').option("nullValue", "")
    first = path if isinstance(path, str) else path[0]
    names = reader.csv(first).columns
    if multi_line == "split":
        return csv_texts(spark, path, names)
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return reader.option("enforceSchema", False).schema(text).csv(path)


# What pandas reads as a number. Spark's own cast would also take Java's suffixes, as in "3f".
NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def _cast(field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.NumericType):
        wrong = F.raise_error(F.concat(F.lit(f"{field.name}: not a number: "), value))
        value = F.when(value.isNull() | value.rlike(NUMBER), F.trim(value)).otherwise(wrong)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        number = value.cast(field.dataType)
        return F.when(~F.isnan(number), number)
    return value.cast(field.dataType)


def _kind(value: Column) -> Column:
    return (
        F.when(value.isNull(), MISSING)
        .when(value.rlike(r"^\s*[+-]?\d+\s*$") & value.try_cast("bigint").isNotNull(), INT)
        .when(value.rlike(NUMBER), DOUBLE)
        .when(value.isin("True", "False", "TRUE", "FALSE", "true", "false"), BOOL)
        .otherwise(TEXT)
    )


def _type(kinds: int) -> T.DataType:
    seen = kinds & ~MISSING
    if seen == INT and not kinds & MISSING:
        return T.LongType()
    if seen in (INT, DOUBLE, INT | DOUBLE) or seen == 0:
        return T.DoubleType()
    if seen == BOOL and not kinds & MISSING:
        return T.BooleanType()
    return T.StringType()


def infer_schema(raw: DataFrame) -> T.StructType:
    """Schema of an all-string frame, from one pass with one number per column."""
    kinds = raw.agg(*[F.bit_or(_kind(F.col(f"`{n}`"))).alias(n) for n in raw.columns]).first()
    return T.StructType([T.StructField(n, _type(kinds[n] or 0)) for n in raw.columns])
