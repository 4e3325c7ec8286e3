"""Wide, long and vector forms of a feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom import fixed
from featloom.functions import text, vectors
from featloom.operators.sizing import width_of


def feature_columns(df: DataFrame, ids: list[str]) -> list[str]:
    """Every column that is not an id, in table order."""
    return [c for c in df.columns if c not in ids]


def features_after(df: DataFrame, skip: int) -> list[str]:
    """Columns after the first ``skip``, which must all be numeric."""
    fields = df.schema.fields[skip:]
    text_fields = [f.name for f in fields if not isinstance(f.dataType, T.NumericType)]
    if text_fields:
        raise TypeError(f"not numeric: {', '.join(text_fields)}")
    return [f.name for f in fields]


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with a null, or NaN, in any column."""
    return df.dropna("any")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def with_group_norm(long: DataFrame) -> DataFrame:
    return long.withColumn("group_norm", F.col("value"))


def prediction_rows(df: DataFrame) -> DataFrame:
    """Drop the row id of a prediction table and call its group ``user_id``."""
    return df.drop("id").withColumnRenamed("group_id", "user_id")


def to_long(df: DataFrame, ids: list[str], feats: list[str] | None = None) -> DataFrame:
    """One row per (row, feature). Null values keep their row.

    Name ``feats`` when only some are wanted: a later filter on ``feat`` does
    not prune columns of the scan, this does. Names and values are zipped as
    arrays: a table of hundreds of columns takes a third of the time that the
    projection per column behind ``unpivot`` does.
    """
    feats = feats or feature_columns(df, ids)
    names = F.array(*[F.lit(c) for c in feats]).alias("feat")
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in feats]).alias("value")
    return df.select(*ids, F.inline(F.arrays_zip(names, values)))


def vec_to_long(df: DataFrame, ids: list[str], vec: str) -> DataFrame:
    """One row per (row, vector entry), features named by position."""
    return df.select(*ids, F.posexplode(vec).alias("pos", "value")).select(
        *ids, text.feature_name(F.col("pos")).alias("feat"), F.col("value").cast("double")
    )


def unique_values(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """One row per key; a key with two rows fails the query."""
    name = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    message = F.concat(F.lit("duplicate key: "), name)
    counted = long.groupBy(*keys).agg(F.first(value).alias(value), F.count("*").alias("_n"))
    checked = F.when(F.col("_n") == 1, F.col(value)).otherwise(F.raise_error(message))
    return counted.select(*keys, checked.alias(value))


def to_wide(long: DataFrame, key: str, feats: list[str] | None = None) -> DataFrame:
    """One row per key, one column per feature; a duplicate pair of key and feature is an error.

    Values are scattered into an array by their feature's place in ``feats``, in one shuffle and one
    aggregate however many features there are. Rows of other features only keep their key. Without
    ``feats`` Spark first reads the distinct feature names; a row without a feature has none.
    """
    if feats is None:
        names = long.select("feat").where(F.col("feat").isNotNull()).distinct()
        feats = sorted(r["feat"] for r in names.collect())
    # As long as the list of columns that is asked for.
    places = long.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, feats))).alias("_at", "_feat"))
    coded = long.join(F.broadcast(places), F.col("feat") == F.col("_feat"), "left")
    cell = F.when(F.col("_at").isNotNull(), F.struct("_at", "value"))
    cells = coded.groupBy(key).agg(F.sort_array(F.collect_list(cell)).alias("_cells"))

    def spread(x: Column, i: Column) -> Column:
        """The value behind a null for every feature between the one before and its own."""
        before = F.coalesce(F.when(i > 0, F.get("_cells", i - 1)["_at"]), F.lit(-1))
        name = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(", "), F.get(F.array(*map(F.lit, feats)), x["_at"]))
        twice = F.raise_error(F.concat(F.lit("duplicate key: "), name)).cast("int")
        gap = F.when(x["_at"] == before, twice).otherwise(x["_at"] - before - 1)
        return F.concat(F.array_repeat(F.lit(None).cast(kind), gap), F.array(x["value"]))

    kind = long.schema["value"].dataType
    filled = cells.select(F.col(key), F.flatten(F.transform("_cells", spread)).alias("_row"))
    return filled.select(key, *[F.get("_row", F.lit(i)).alias(f) for i, f in enumerate(feats)])


def vec_to_cols(df: DataFrame, ids: list[str], vec: str, dims: int | None = None) -> DataFrame:
    """A vector as columns ``f0000``.. for formats without arrays.

    A vector of another width fails the query. Without ``dims`` the sizes are read first.
    """
    dims = dims or width_of(df, vec)
    checked = df.select(*ids, vectors.assert_width(F.col(vec), dims).alias("_vec"))
    cells = [F.get("_vec", F.lit(i)).alias(fixed.FEATURE_FORMAT % i) for i in range(dims)]
    return checked.select(*ids, *cells)


def cols_to_vec(
    df: DataFrame, ids: list[str], feats: list[str], vec: str = "embedding", dtype: str = "float"
) -> DataFrame:
    """Named columns as one vector, by name and never by file order."""
    return df.select(*ids, F.array(*[F.col(c).cast(dtype) for c in feats]).alias(vec))


def outcome_vector(df: DataFrame, ids: list[str], vec: str = "outcomes") -> DataFrame:
    return cols_to_vec(df, ids, fixed.OUTCOMES, vec)


def longest_name(df: DataFrame, ids: list[str]) -> int:
    """Length of the longest feature name, which sizes the ``feat`` column."""
    return max(len(c) for c in feature_columns(df, ids))


def longest_feature(long: DataFrame) -> DataFrame:
    """The same for a long table, where the names are data."""
    return long.agg(F.max(F.length("feat")).alias("max_length"))
