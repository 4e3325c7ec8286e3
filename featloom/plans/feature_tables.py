"""Feature-table jobs."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom import fixed
from featloom.operators import groupfeats, reshape
from featloom.sinks import tables
from featloom.sources.csv import read_csv, read_wide_csv


def corpus_for(path: str) -> str:
    """Corpus whose name starts the file name."""
    for corpus in fixed.CORPUS_ID_TYPES:
        if os.path.basename(path).startswith(corpus):
            return corpus
    raise ValueError(f"no corpus for {path}")


def user_feature_table(
    segments: DataFrame, feats: DataFrame, id_type: str | None = None, **options
) -> DataFrame:
    """Mean of every feature over a user's segments, as a long table.

    ``feats`` is ``message_id`` with one array column, or a wide table
    ``message_id, f0000, ...`` whose columns become the array.
    """
    vec = options.pop("vec", "embedding")
    if vec not in feats.columns:
        names = reshape.feature_columns(feats, ["message_id"])
        options.setdefault("dims", len(names))
        feats = reshape.cols_to_vec(feats, ["message_id"], names, vec, "double")
    return groupfeats.group_mean(segments, feats, vec=vec, id_type=id_type, **options)


def cohort_feature_table(corpora: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """Features of the segments in an id list, without aggregation, as a long table.

    The corpora are put together first, so that the id list is read and joined once.
    """
    rows = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), corpora.values()
    )
    rows = groupfeats.cohort(rows, ids)
    if "embedding" in rows.columns:
        long = reshape.vec_to_long(rows, ["message_id"], "embedding")
    else:
        long = reshape.to_long(rows, ["message_id"])
    return reshape.with_group_norm(long.withColumnRenamed("message_id", "group_id"))


def frame_to_long(df: DataFrame, group: str, id_type: str = "string") -> DataFrame:
    """Complete rows of any wide table as a long feature table."""
    long = reshape.to_long(reshape.drop_incomplete(df), [group])
    return reshape.with_group_norm(
        long.select(F.col(group).cast(id_type).alias("group_id"), "feat", "value")
    )


def fill_user_features(
    spark: SparkSession, segments_csv: str, features_csv: str, target: str
) -> None:
    """CSV files in, long feature table out; the corpus sets the id type."""
    id_type = fixed.CORPUS_ID_TYPES[corpus_for(features_csv)]
    ids = T.StructType([T.StructField(n, T.StringType()) for n in ("user_id", "message_id")])
    feats = read_wide_csv(spark, features_csv, ["message_id"])
    table = user_feature_table(read_csv(spark, segments_csv, ids), feats, id_type)
    tables.write_long(table, target)


def fill_cohort_features(spark: SparkSession, folder: str, ids_csv: str, target: str) -> None:
    """The embedding CSV of every corpus in, cohort rows out, without aggregation."""
    corpora = {
        corpus: read_wide_csv(spark, f"{folder}/{corpus}_embeddings.csv", ["message_id"])
        for corpus in fixed.CORPUS_ID_TYPES
    }
    id_only = T.StructType([T.StructField("message_id", T.StringType())])
    ids = read_csv(spark, ids_csv, id_only)
    tables.write_long(cohort_feature_table(corpora, ids), target)


def csv_to_long(spark: SparkSession, csv: str, group: str, target: str) -> None:
    """Any wide CSV as a long feature table; group ids are whole numbers in one corpus."""
    try:
        id_type = fixed.CORPUS_ID_TYPES[corpus_for(csv)]
    except ValueError:
        id_type = "string"
    tables.write_long(frame_to_long(read_wide_csv(spark, csv, [group]), group, id_type), target)
