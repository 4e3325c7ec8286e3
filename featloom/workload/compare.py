"""Model comparison."""

from pyspark.sql import functions as F

from featloom.functions.stats import log_two_sided_p
from featloom.operators import compare, reshape
from featloom.plans.model_comparison import compare_models
from featloom.workload.registry import query, r6

ALIGNED = """
    SELECT t.user_id, t.feat, t.value AS truth, b.value AS baseline, p.value AS pred
    FROM {truth_long} t
    JOIN {baseline} b ON b.group_id = t.user_id AND b.feat = t.feat
    JOIN {pred} p ON p.group_id = t.user_id AND p.feat = t.feat"""

# The p-value by the tail integral of the t density, Simpson's rule on a finite
# range after u = tan(theta) * sqrt(nu), which makes the integrand cos^(nu - 1).
TTEST = f"""
    WITH d AS (SELECT feat, abs(truth - baseline) - abs(truth - pred) AS d FROM ({ALIGNED})),
    s AS (SELECT feat, count(*) AS users, count(d) AS n,
                 CASE WHEN count(*) = count(d)
                      THEN avg(d) / (stddev_samp(d) / sqrt(count(d))) END AS t
          FROM d GROUP BY feat),
    q AS (SELECT feat, n, t, n - 1 AS nu, atan(abs(t) / sqrt(n - 1)) AS lo FROM s),
    p AS (SELECT feat, sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
                           * pow(cos(lo + (pi() / 2 - lo) * i / 2000), nu - 1))
                       * (pi() / 2 - lo) / 6000 AS tail
          FROM q, range(2001) AS r(i) GROUP BY feat, lo, nu)
    SELECT q.feat, q.n, round(q.t, 6) + 0.0 AS t_statistic,
           round(2 * p.tail * exp(lgamma((nu + 1) / 2) - lgamma(nu / 2)) / sqrt(pi()), 6) + 0.0
           AS p_value
    FROM q JOIN p ON p.feat = q.feat ORDER BY p_value"""


def _frames(v):
    return v.truth_long, reshape.prediction_rows(v.baseline), reshape.prediction_rows(v.pred)


@query(
    "JON-4",
    f"""SELECT user_id, feat, round(truth, 6) + 0.0 AS truth,
               round(baseline, 6) + 0.0 AS baseline, round(pred, 6) + 0.0 AS pred
        FROM ({ALIGNED})""",
)
def aligned_predictions(v):
    aligned = compare.align(*_frames(v))
    values = ["truth", "baseline", "pred"]
    return aligned.select("user_id", "feat", *[r6(c).alias(c) for c in values])


@query(
    "PRJ-9 JON-4",
    f"""SELECT user_id, feat, round(abs(truth - baseline), 6) + 0.0 AS baseline_residual,
               round(abs(truth - pred), 6) + 0.0 AS pred_residual
        FROM ({ALIGNED})""",
)
def absolute_residuals(v):
    rows = compare.residuals(compare.align(*_frames(v)))
    return rows.select(
        "user_id",
        "feat",
        r6("baseline_residual").alias("baseline_residual"),
        r6("pred_residual").alias("pred_residual"),
    )


def _rounded(tests):
    return tests.withColumns({"t_statistic": r6("t_statistic"), "p_value": r6("p_value")})


@query("AGG-8 JON-3 JON-4 SRT-2", TTEST)
def paired_ttest(v):
    return _rounded(compare.paired_ttest(*_frames(v)))


@query("AGG-8", TTEST)
def paired_ttest_exact(v):
    """The same, equal to the last bit under any partitioning."""
    return _rounded(compare.paired_ttest(*_frames(v), reproducible=True))


@query("AGG-8 RSH-1 PRJ-2 SRT-2", TTEST)
def model_comparison(v):
    """The whole job from a wide truth table."""
    truth = reshape.to_wide(v.truth_long, "user_id")
    return _rounded(compare_models(truth, v.baseline, v.pred)).select(
        "feat", F.col("n"), "t_statistic", "p_value"
    )


# One test per user of the values against 0: at these t almost every p is far below 1e-6.
USER_TESTS = """
    WITH s AS (SELECT user_id, count(value) AS n,
                      avg(value) / (stddev_samp(value) / sqrt(count(value))) AS t
               FROM {events} GROUP BY user_id HAVING count(value) > 2),
    q AS (SELECT user_id, n, t, n - 1 AS nu, atan(abs(t) / sqrt(n - 1)) AS lo FROM s),
    p AS (SELECT user_id, sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
                              * pow(cos(lo + (pi() / 2 - lo) * i / 4000), nu - 1))
                          * (pi() / 2 - lo) / 12000 AS tail
          FROM q, range(4001) AS r(i) GROUP BY user_id, lo, nu)
    SELECT q.user_id, q.n, round(q.t, 6) + 0.0 AS t_statistic,
           round(ln(2 * p.tail) + lgamma((nu + 1) / 2) - lgamma(nu / 2) - ln(pi()) / 2, 5) + 0.0
           AS log_p
    FROM q JOIN p ON p.user_id = q.user_id"""


@query("AGG-8", USER_TESTS)
def user_mean_tests(v):
    """Relative precision of p far in the tail."""
    tests = v.events.groupBy("user_id").agg(
        F.count("value").alias("n"),
        (F.avg("value") / (F.stddev_samp("value") / F.sqrt(F.count("value")))).alias("t"),
    )
    log_p = log_two_sided_p(F.col("t"), (F.col("n") - 1).cast("double"))
    return tests.where("n > 2").select(
        "user_id", "n", r6("t").alias("t_statistic"), (F.round(log_p, 5) + 0.0).alias("log_p")
    )
