"""Row-local vector operators."""

from pyspark.sql import functions as F

from featloom.functions import vectors as vec
from featloom.operators import prep, reshape
from featloom.workload.registry import cells, longs, query, r6



@query(
    "VEC-1",
    """SELECT message_id, i - 1 AS pos, round(e / greatest(n, 1e-12), 6) + 0.0 AS value
       FROM (SELECT f.message_id, i, cast(e AS double) AS e,
                    sqrt(sum(cast(e AS double) * cast(e AS double))
                         OVER (PARTITION BY f.message_id)) AS n
             FROM {feats} f, unnest(f.embedding) WITH ORDINALITY AS u(e, i))""",
)
def unit_vectors(v):
    unit = v.feats.select("message_id", vec.l2_normalize(F.col("embedding")).alias("unit"))
    return cells(unit, ["message_id"], "unit")


COSINES = """
    SELECT p.id, p.batch_id,
           sum(cast(p.x[i] AS double) * p.y[i]) /
           (greatest(sqrt(sum(cast(p.x[i] AS double) * p.x[i])), 1e-8) *
            greatest(sqrt(sum(cast(p.y[i] AS double) * p.y[i])), 1e-8)) AS c
    FROM {pairs} p, range(1, 65) AS d(i) GROUP BY p.id, p.batch_id"""


@query("VEC-2", f"SELECT id, round(c, 6) + 0.0 AS cosine FROM ({COSINES})")
def pair_cosine(v):
    return v.pairs.select("id", r6(vec.cosine(F.col("x"), F.col("y"))).alias("cosine"))


@query(
    "VEC-10",
    f"""SELECT id, round(greatest(1 - c, 0), 6) + 0.0 AS hinge,
               round(greatest(c, 1e-9), 6) + 0.0 AS clamped,
               round(exp(c / 0.1), 4) + 0.0 AS heat,
               round(-ln(exp(c / 0.1) / (exp(c / 0.1) + 1)), 6) + 0.0 AS loss
        FROM ({COSINES})""",
)
def loss_terms(v):
    heat = vec.tempered_exp(F.col("c"), 0.1)
    return v.pairs.select("id", vec.cosine(F.col("x"), F.col("y")).alias("c")).select(
        "id",
        r6(vec.hinge(1 - F.col("c"))).alias("hinge"),
        r6(vec.clamp_min(F.col("c"), 1e-9)).alias("clamped"),
        (F.round(heat, 4) + 0.0).alias("heat"),
        r6(vec.neg_log_ratio(heat, heat + 1)).alias("loss"),
    )


OUTCOME_LIST = "[ope, agr, ext, con, neu, valence, arousal, ang, anx, dep]"


def _teachers(v):
    outcomes = reshape.outcome_vector(v.segments, ["message_id"])
    return v.feats.join(outcomes, "message_id")


@query(
    "VEC-3",
    f"""SELECT message_id, i - 1 AS pos, round(cast(value AS double), 4) + 0.0 AS value
       FROM (SELECT message_id,
                    list_concat(embedding, cast({OUTCOME_LIST} AS float[])) AS whole
             FROM {{feats}} JOIN {{segments}} USING (message_id)),
            unnest(whole) WITH ORDINALITY AS u(value, i)""",
)
def teacher_with_outcomes(v):
    whole = _teachers(v).select(
        "message_id", vec.append(F.col("embedding"), F.col("outcomes")).alias("whole")
    )
    return cells(whole, ["message_id"], "whole", 4)


@query(
    "VEC-4",
    f"""SELECT message_id, i - 1 AS pos,
              round(CASE WHEN i <= 10 THEN cast(cast(o[i] AS float) AS double)
                         ELSE cast(e AS double) END, 4) + 0.0 AS value
       FROM (SELECT message_id, embedding, {OUTCOME_LIST} AS o
             FROM {{feats}} JOIN {{segments}} USING (message_id)),
            unnest(embedding) WITH ORDINALITY AS u(e, i)""",
)
def teacher_head_replaced(v):
    whole = _teachers(v).select(
        "message_id", vec.replace_head(F.col("embedding"), F.col("outcomes")).alias("whole")
    )
    return cells(whole, ["message_id"], "whole", 4)


# A head whose weights follow a rule, so that SQL can state it too.
WEIGHTS = [[((r * 7 + i * 3) % 11 - 5) / 10 for i in range(64)] for r in range(16)]
BIAS = [(r % 5) / 10 for r in range(16)]
EXTRA_WEIGHTS = [[((r * 5 + i * 2) % 7 - 3) / 10 for i in range(16)] for r in range(10)]
EXTRA_BIAS = [(r % 3) / 10 for r in range(10)]

HEAD = """
    SELECT f.message_id, r,
           tanh(sum(cast(f.embedding[i + 1] AS double) * (((r * 7 + i * 3) % 11 - 5) / 10.0))
                + (r % 5) / 10.0) AS h
    FROM {feats} f, range(16) AS a(r), range(64) AS b(i)
    GROUP BY f.message_id, r"""


@query("VEC-5", f"SELECT message_id, r AS pos, round(h, 6) + 0.0 AS value FROM ({HEAD})")
def dense_head(v):
    head = vec.dense(F.col("embedding"), WEIGHTS, BIAS, "tanh")
    return cells(v.feats.select("message_id", head.alias("h")), ["message_id"], "h")


@query(
    "VEC-6",
    f"""WITH head AS ({HEAD})
        SELECT message_id, r AS pos, round(h, 6) + 0.0 AS value FROM head
        UNION ALL
        SELECT message_id, 16 + q AS pos,
               round(tanh(sum(h * (((q * 5 + r * 2) % 7 - 3) / 10.0)) + (q % 3) / 10.0), 6) + 0.0
        FROM head, range(10) AS c(q) GROUP BY message_id, q""",
)
def dense_head_projected(v):
    head = vec.dense_with_projection(
        F.col("embedding"), WEIGHTS, BIAS, EXTRA_WEIGHTS, EXTRA_BIAS, "tanh"
    )
    return cells(v.feats.select("message_id", head.alias("h")), ["message_id"], "h")


@query("VEC-13", "SELECT message_id, len(embedding) + 10 AS width FROM {feats}")
def width_contract(v):
    """The output width is the embedding width plus the new dimensions."""
    whole = vec.append(F.col("embedding"), F.array_repeat(F.lit(0.0), 10))
    checked = vec.assert_width(whole, 64 + 10)
    return longs(v.feats.select("message_id", F.size(checked).alias("width")), "width")


@query(
    "AGG-4",
    """SELECT round(avg(m), 6) + 0.0 AS mean, round(avg(s), 6) + 0.0 AS std
       FROM (SELECT i, avg(cast(e AS double)) AS m, stddev_pop(cast(e AS double)) AS s
             FROM {feats} f, unnest(f.embedding) WITH ORDINALITY AS u(e, i) GROUP BY i)""",
)
def embedding_distribution(v):
    dist = prep.embedding_distribution(v.feats)
    return dist.select(r6("mean").alias("mean"), r6("std").alias("std"))
