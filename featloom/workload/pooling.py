"""Pooling of token vectors."""

from pyspark.sql import functions as F

from featloom.functions.vectors import l2_normalize
from featloom.operators import pooling
from featloom.workload.registry import cells, query

MEAN = """
    SELECT t.seq_id, i - 1 AS pos,
           round(sum(cast(t.vec[i] AS double) * {m}) / greatest(sum({m}), 1e-9), 6) + 0.0 AS value
    FROM {{tokens}} t, range(1, 65) AS d(i) GROUP BY t.seq_id, i"""

LAST = """
    WITH counted AS (
        SELECT *, sum(mask) OVER (PARTITION BY seq_id ORDER BY pos) AS run,
               greatest(sum(mask) OVER (PARTITION BY seq_id) - 1, 0) AS place,
               max(pos) OVER (PARTITION BY seq_id) AS final
        FROM {tokens}),
    target AS (
        SELECT seq_id, CASE WHEN run = 0 THEN final ELSE run - 1 END AS pos
        FROM counted WHERE pos = place)
    SELECT t.seq_id, i - 1 AS pos, round(cast(t.vec[i] AS double), 6) + 0.0 AS value
    FROM {tokens} t JOIN target USING (seq_id, pos), range(1, 65) AS d(i)"""


@query("AGG-5", MEAN.format(m="t.mask"))
def mean_pooled(v):
    return cells(pooling.mean_pool(v.tokens), ["seq_id"], "vec")


@query("AGG-7", MEAN.format(m="1"))
def mean_over_time(v):
    return cells(pooling.mean_pool(v.tokens, mask=None), ["seq_id"], "vec")


@query("AGG-6 UDF-4", LAST)
def last_pooled(v):
    return cells(pooling.pool(v.tokens, "last"), ["seq_id"], "vec")


@query("AGG-6", LAST)
def last_pooled_right_padded(v):
    return cells(pooling.last_pool(v.tokens, right_padded=True), ["seq_id"], "vec")


@query(
    "WIN-4",
    """SELECT seq_id, pos, mask,
              cast(sum(mask) OVER (PARTITION BY seq_id ORDER BY pos) AS bigint) AS run
       FROM {tokens}""",
)
def running_mask(v):
    rows = v.tokens.select("seq_id", "pos", "mask")
    return pooling.running_total(rows, ["seq_id"], "pos", "mask", "run")


@query(
    "AGG-7 VEC-1",
    """WITH pooled AS (
           SELECT t.seq_id, i, avg(cast(t.vec[i] AS double)) AS m
           FROM {tokens} t, range(1, 65) AS d(i) GROUP BY t.seq_id, i)
       SELECT seq_id, i - 1 AS pos,
              round(m / greatest(sqrt(sum(m * m) OVER (PARTITION BY seq_id)), 1e-12), 6) + 0.0
              AS value
       FROM pooled""",
)
def unit_mean_over_time(v):
    pooled = pooling.pool(v.tokens, "mean", mask=None)
    return cells(pooled.withColumn("vec", l2_normalize(F.col("vec"))), ["seq_id"], "vec")
