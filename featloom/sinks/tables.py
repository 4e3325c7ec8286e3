"""Typed tables, long feature tables, wide embedding files and CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom import fixed
from featloom.functions import text
from featloom.operators import curve, reshape

LONG_COLUMNS = ["group_id", "feat", "value", "group_norm"]


def table_type(name: str, dtype: T.DataType, wide_ints: bool = False) -> T.DataType:
    """Column type of a loaded table, by name first, then by inferred type."""
    whole = isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    integer = T.LongType() if wide_ints else T.IntegerType()
    if name in fixed.VARCHAR_SIZES:
        keep_integer = name == "user_id" and whole
        return integer if keep_integer else T.VarcharType(fixed.VARCHAR_SIZES[name])
    if whole:
        return integer
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return T.FloatType()
    if isinstance(dtype, (T.BooleanType, T.TimestampType, T.TimestampNTZType)):
        return dtype
    return T.StringType()


def typed_schema(
    schema: T.StructType,
    overrides: dict[str, T.DataType] | None = None,
    wide_ints: bool = False,
) -> T.StructType:
    overrides = overrides or {}
    return T.StructType(
        [
            T.StructField(f.name, overrides.get(f.name) or table_type(f.name, f.dataType, wide_ints))
            for f in schema
        ]
    )


def typed(
    df: DataFrame, overrides: dict[str, T.DataType] | None = None, wide_ints: bool = False
) -> DataFrame:
    """Cast to the mapped types. A text longer than its column fails the query."""
    out = []
    for f in typed_schema(df.schema, overrides, wide_ints):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.VarcharType):
            n = f.dataType.length
            long = F.raise_error(F.lit(f"{f.name} is longer than {n} characters"))
            c = c.cast("string")
            c = F.when(c.isNull() | (F.length(c) <= n), c).otherwise(long)
        else:
            c = c.cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def save_typed(
    df: DataFrame,
    table: str,
    overrides: dict[str, T.DataType] | None = None,
    wide_ints: bool = False,
) -> None:
    """Create a catalog table of complete rows; an existing one is an error."""
    complete = reshape.drop_incomplete(df)
    typed(complete, overrides, wide_ints).write.mode("errorifexists").saveAsTable(table)


def save_bucketed(
    df: DataFrame, table: str, key: str, buckets: int, mode: str = "errorifexists"
) -> None:
    """Catalog table bucketed and sorted by its join key.

    Segments and features saved with the same key and bucket count are joined
    without shuffling either, which at scale is the cost of per-user features.
    Rows are first brought to their bucket, so there is one file per bucket.
    """
    (
        df.repartition(buckets, key)
        .write.mode(mode)
        .bucketBy(buckets, key)
        .sortBy(key)
        .saveAsTable(table)
    )


def _jdbc(
    df: DataFrame,
    url: str,
    table: str,
    column_types: dict[str, str],
    mode: str,
    connections: int,
    batch_size: int,
    options: dict[str, str],
) -> None:
    writer = df.write.format("jdbc").option("url", url).option("dbtable", table)
    writer = writer.option("batchsize", batch_size).option("numPartitions", connections)
    if column_types:
        named = ", ".join(f"{name} {kind}" for name, kind in column_types.items())
        writer = writer.option("createTableColumnTypes", named)
    writer.options(**options).mode(mode).save()


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    mode: str = "errorifexists",
    connections: int = 32,
    batch_size: int = 10_000,
    wide_ints: bool = False,
    **options: str,
) -> None:
    """Load complete rows into a SQL server with typed columns and batched inserts.

    Each task inserts its partition in one transaction. A task that is retried
    after its commit repeats rows, so load into a staging table and rename it
    when the job has succeeded.
    """
    sizes = {
        f.name: f"VARCHAR({f.dataType.length})"
        for f in typed_schema(df.schema, wide_ints=wide_ints)
        if isinstance(f.dataType, T.VarcharType)
    }
    rows = typed(reshape.drop_incomplete(df), wide_ints=wide_ints)
    _jdbc(rows, url, table, sizes, mode, connections, batch_size, options)


def write_long_jdbc(
    long: DataFrame,
    url: str,
    table: str,
    feat_length: int | None = None,
    mode: str = "errorifexists",
    connections: int = 32,
    batch_size: int = 10_000,
    **options: str,
) -> None:
    """Load a long feature table; the longest feature name sizes ``feat``."""
    if feat_length is None:
        feat_length = reshape.longest_feature(long).first()["max_length"] or 1
    sizes = {"feat": f"VARCHAR({feat_length})"}
    if isinstance(long.schema["group_id"].dataType, T.StringType):
        sizes["group_id"] = f"VARCHAR({fixed.VARCHAR_SIZES['user_id']})"
    rows = long.select(*LONG_COLUMNS)
    _jdbc(rows, url, table, sizes, mode, connections, batch_size, options)


def write_long(long: DataFrame, path: str, mode: str = "errorifexists", files: int | None = None) -> None:
    """Long feature table as Parquet, clustered by feature and by group alike.

    Rows lie along a space-filling curve over the ranks of both keys, so the
    statistics of files and row groups stand in for an index on each: a lookup
    by feature or by group reads few of the files. A frequent feature or group
    spans many files.
    """
    rows = long.select(*LONG_COLUMNS)
    curve.clustered(rows, ("feat", "group_id"), files=files).write.mode(mode).parquet(path)


def refuse_existing(spark: SparkSession, *paths: str) -> None:
    """An error, before any work, if one of the outputs is there already."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if system.exists(target):
            raise ValueError(f"output exists: {path}")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of CSV files, each with the header."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_embeddings(
    encoded: DataFrame, path: str, tag: str = "dataset_name", mode: str = "errorifexists"
) -> None:
    """Embeddings as Parquet, one folder per corpus."""
    encoded.write.mode(mode).partitionBy(tag).parquet(path)


def write_embeddings_csv(
    encoded: DataFrame,
    path: str,
    dims: int | None = None,
    tag: str = "dataset_name",
    key: str = "message_id",
    vec: str = "embedding",
    mode: str = "errorifexists",
) -> None:
    """The same as wide CSV: the id and ``f0000``.. in one folder per corpus."""
    wide = reshape.vec_to_cols(encoded, [tag, key], vec, dims)
    wide.write.mode(mode).partitionBy(tag).option("header", True).csv(path)


def write_by_path(
    encoded: DataFrame, path: str, key: str = "path", mode: str = "errorifexists"
) -> None:
    """One table keyed by input path and stem, in place of a file per input."""
    named = encoded.withColumn("stem", text.stem(F.col(key)))
    named.write.mode(mode).parquet(path)
