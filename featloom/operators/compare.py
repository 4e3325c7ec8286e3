"""Model comparison: align, absolute residuals, paired t-test per outcome."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.functions.stats import log_two_sided_p
from featloom.operators.exact import exact_moments
from featloom.operators.reshape import nan_to_null, to_long

KEYS = ["user_id", "feat"]
SIDES = ["truth", "baseline", "pred"]


def _side_by_side(truth: DataFrame, baseline: DataFrame, pred: DataFrame) -> DataFrame:
    """``user_id, feat``, the three values, and ``_truth`` etc: whether there is a row.

    A union and one aggregate, in place of a duplicate check per table and two
    joins: every input is read and shuffled once. Null keys match nothing, and
    a key with two rows in one table fails the query.
    """
    value = nan_to_null(F.col("value").cast("double")).alias("value")
    tagged = [
        df.select(*KEYS, value, F.lit(side).alias("_side"))
        for side, df in zip(SIDES, (truth, baseline, pred))
    ]
    found = []
    for side in SIDES:
        mine = F.col("_side") == side
        found += [
            F.max(F.when(mine, F.col("value"))).alias(side),
            F.count(F.when(mine, 1)).alias(f"_{side}"),
        ]
    rows = (
        reduce(DataFrame.unionByName, tagged)
        .where(F.col("user_id").isNotNull() & F.col("feat").isNotNull())
        .groupBy(*KEYS)
        .agg(*found)
    )
    counts = [F.col(f"_{side}") for side in SIDES]
    key = F.concat_ws(", ", *[F.col(k).cast("string") for k in KEYS])
    twice = F.raise_error(F.concat(F.lit("duplicate key: "), key))

    def unless_twice(c: Column) -> Column:
        return F.when(F.greatest(*counts) == 1, c).otherwise(twice)

    # On the row marks too, so that no consumer can filter the failure away.
    checked = [*SIDES, *(f"_{side}" for side in SIDES)]
    return rows.withColumns({c: unless_twice(F.col(c)) for c in checked})


def truth_long(truth: DataFrame, feats: list[str] | None = None) -> DataFrame:
    """Wide truth table as long rows."""
    return to_long(truth, ["user_id"], feats)


def align(truth: DataFrame, baseline: DataFrame, pred: DataFrame) -> DataFrame:
    """Truth, baseline and prediction of every (user, outcome) that all three have.

    Three long tables ``user_id, feat, value``. Duplicate keys fail the query.
    """
    everywhere = F.least(*[F.col(f"_{s}") for s in SIDES]) == 1
    return _side_by_side(truth, baseline, pred).where(everywhere).select(*KEYS, *SIDES)


def residuals(aligned: DataFrame) -> DataFrame:
    """Absolute error of baseline and prediction."""
    return aligned.withColumns(
        {
            "baseline_residual": F.abs(F.col("truth") - F.col("baseline")),
            "pred_residual": F.abs(F.col("truth") - F.col("pred")),
        }
    )


def paired_ttest(
    truth: DataFrame,
    baseline: DataFrame,
    pred: DataFrame,
    nan_policy: str = "propagate",
    reproducible: bool = False,
) -> DataFrame:
    """Paired t-test of baseline against prediction residuals, per outcome.

    Long tables ``user_id, feat, value``; only users of all three count, and
    the outcomes are those of ``pred``. t above 0 means the prediction is
    better. With ``propagate`` an outcome that lacks a value for any common
    user has null t and p; ``omit`` tests the pairs there are. Fewer than two
    pairs, or differences without spread, give null. Sorted by p, null last; by
    its logarithm, so that order follows t also where p is too small to print.
    With ``reproducible`` t and p are equal to the last bit under any partitioning.
    """
    if nan_policy not in ("propagate", "omit"):
        raise ValueError(f"nan_policy: {nan_policy}")
    rows = residuals(_side_by_side(truth, baseline, pred)).withColumn(
        "difference", F.col("baseline_residual") - F.col("pred_residual")
    )
    pairs = rows.where("_pred = 1")
    if reproducible:
        moments = exact_moments(pairs, ["feat"], ["difference"]).select(
            "feat", F.col("n").alias("_n"), F.col("mean").alias("_mean"), F.col("std").alias("_sd")
        )
        every = pairs.groupBy("feat").agg(F.count("difference").alias("n"))
        tests = every.join(moments, "feat", "left").drop("_n")
    else:
        tests = pairs.groupBy("feat").agg(
            F.count("difference").alias("n"),
            F.avg("difference").alias("_mean"),
            F.stddev_samp("difference").alias("_sd"),
        )
    t = F.try_divide(F.col("_mean"), F.col("_sd") / F.sqrt(F.col("n").cast("double")))
    if nan_policy == "propagate":
        t = F.when(F.col("n") == _common_users(rows).scalar(), t)
    tests = tests.select("feat", "n", t.alias("t_statistic"))
    log_p = log_two_sided_p(F.col("t_statistic"), (F.col("n") - 1).cast("double"))
    return (
        tests.withColumn("_log_p", log_p)
        .orderBy(F.col("_log_p").asc_nulls_last(), "feat")
        .select("feat", "n", "t_statistic", F.exp("_log_p").alias("p_value"))
    )


def _common_users(rows: DataFrame) -> DataFrame:
    """One row: how many users all three tables have."""
    users = rows.groupBy("user_id").agg(*[F.max(f"_{s}").alias(s) for s in SIDES])
    return users.where(F.least(*SIDES) > 0).agg(F.count("*").alias("users"))
