"""Compare two models' predictions of user outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from featloom.operators import compare, reshape
from featloom.sources.csv import read_csv


def compare_models(
    truth: DataFrame, baseline: DataFrame, pred: DataFrame, nan_policy: str = "propagate"
) -> DataFrame:
    """t and p per outcome from a wide truth and two ``id, group_id, feat, value`` tables.

    The work stays long: the truth is unpivoted, the predictions never pivoted.
    """
    return compare.paired_ttest(
        compare.truth_long(truth),
        reshape.prediction_rows(baseline),
        reshape.prediction_rows(pred),
        nan_policy,
    )


def compare_files(
    spark: SparkSession, truth: str, baseline: str, pred: str, nan_policy: str = "propagate"
) -> DataFrame:
    """The same from CSV files."""
    frames = [read_csv(spark, p) for p in (truth, baseline, pred)]
    return compare_models(*frames, nan_policy)
