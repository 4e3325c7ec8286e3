"""Rescaling, splitting, batching, padding."""

from pyspark.sql import functions as F

from featloom import fixed
from featloom.operators import index, prep
from featloom.plans.training_prep import prepare_batches
from featloom.workload.registry import cells, longs, query, r6

OUTCOMES = fixed.OUTCOMES
# An arithmetic shuffle key over [0, 2^32) that SQL can state too; no id overflows it.
SPREAD = "((message_id % 4294967296) * 1640531527) % 4294967296"


OUTCOME_STATS = (
    "SELECT dataset_name, "
    + ", ".join(
        f"round(avg({c}), 6) + 0.0 AS {c}_mean, round(stddev_samp({c}), 6) + 0.0 AS {c}_std"
        for c in OUTCOMES
    )
    + " FROM {segments} GROUP BY dataset_name"
)


@query("AGG-3", OUTCOME_STATS)
def outcome_stats(v):
    stats = prep.outcome_stats(v.segments)
    names = [c for c in stats.columns if c != "dataset_name"]
    return stats.select("dataset_name", *[r6(c).alias(c) for c in names])


@query("AGG-3", OUTCOME_STATS)
def outcome_stats_exact(v):
    stats = prep.outcome_stats(v.segments, reproducible=True)
    names = [c for c in stats.columns if c != "dataset_name"]
    return stats.select("dataset_name", *[r6(c).alias(c) for c in names])


@query(
    "VEC-9 AGG-3 AGG-4",
    """WITH dist AS (
           SELECT avg(m) AS mean, avg(s) AS std
           FROM (SELECT i, avg(cast(e AS double)) AS m, stddev_pop(cast(e AS double)) AS s
                 FROM {feats} f, unnest(f.embedding) WITH ORDINALITY AS u(e, i) GROUP BY i))
       SELECT message_id, """
    + ", ".join(
        f"""round(({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w * dist.std + dist.mean, 6)
            + 0.0 AS {c}"""
        for c in OUTCOMES
    )
    + " FROM {segments}, dist WINDOW w AS (PARTITION BY dataset_name)",
)
def rescaled_outcomes(v):
    scaled = prep.zscore_rescale(v.segments, target=prep.embedding_distribution(v.feats))
    return scaled.select("message_id", *[r6(c).alias(c) for c in OUTCOMES])


@query(
    "WIN-6",
    f"""SELECT message_id, CASE WHEN n <= floor(0.8 * total) THEN 'train' ELSE 'validation' END
               AS split
        FROM (SELECT message_id, count(*) OVER () AS total,
                     row_number() OVER (ORDER BY {SPREAD}) AS n FROM {{segments}})""",
)
def exact_split(v):
    rows = v.segments.select("message_id")
    return index.exact_split(rows, 0.8, shuffle_key=F.expr(SPREAD))


@query(
    "WIN-6 AGG-13",
    """SELECT 'train' AS split, cast(floor(0.8 * count(*)) AS bigint) AS rows FROM {segments}
       UNION ALL
       SELECT 'validation', count(*) - cast(floor(0.8 * count(*)) AS bigint) FROM {segments}""",
)
def hashed_split_sizes(v):
    split = index.exact_split(v.segments, 0.8, key=["message_id"], seed=7)
    return prep.row_counts(split, "split")


@query(
    "WIN-7",
    f"""SELECT message_id, cast((row_number() OVER (ORDER BY {SPREAD}) - 1) // 48 AS bigint)
               AS batch_id
        FROM {{segments}}""",
)
def batch_numbers(v):
    rows = v.segments.select("message_id")
    return index.assign_batches(rows, 48, shuffle_key=F.expr(SPREAD))


@query(
    "WIN-7 AGG-13",
    """SELECT b AS batch_id, least(700, n - b * 700) AS rows
       FROM (SELECT count(*) AS n FROM {segments}), range(1000000) AS r(b) WHERE b * 700 < n""",
)
def hashed_batch_sizes(v):
    return prep.row_counts(index.assign_batches(v.segments, 700, seed=3), "batch_id")


@query(
    "SRT-4",
    f"""SELECT user_id, message_id, row_number() OVER (ORDER BY {SPREAD}) - 1 AS place
        FROM {{segments}} ORDER BY place""",
)
def shuffled_segments(v):
    """The shuffled order, each row with its place in it."""
    rows = v.segments.select("user_id", "message_id")
    placed = index.dense_index(rows, shuffle_key=F.expr(SPREAD), out="place")
    return index.shuffled(placed, ["message_id"], shuffle_key=F.expr(SPREAD))


PREPARED = """
    WITH scaled AS (
        SELECT message_id, dataset_name,
               (ope - avg(ope) OVER w) / stddev_samp(ope) OVER w AS ope,
               (agr - avg(agr) OVER w) / stddev_samp(agr) OVER w AS agr
        FROM {segments} WINDOW w AS (PARTITION BY dataset_name)),
    said AS (
        SELECT s.*, regexp_split_to_array(m.message, ' ')[1:12] AS tokens
        FROM scaled s JOIN (SELECT event_id AS message_id, concat_ws(' ', event_type, 'at',
                                   cast(event_id % 7 AS varchar)) AS message FROM events) m
        USING (message_id)),
    split AS (
        SELECT *, row_number() OVER (ORDER BY {SPREAD}) AS n, count(*) OVER () AS total FROM said),
    tagged AS (
        SELECT *, CASE WHEN n <= floor(0.8 * total) THEN 'train' ELSE 'validation' END AS split
        FROM split),
    dealt AS (
        SELECT *, (row_number() OVER (PARTITION BY split ORDER BY {SPREAD}) - 1) // 32 AS batch_id
        FROM tagged)
    SELECT message_id, split, cast(batch_id AS bigint) AS batch_id, round(ope, 6) + 0.0 AS ope,
           round(agr, 6) + 0.0 AS agr, len(tokens) AS ones,
           max(len(tokens)) OVER (PARTITION BY split, batch_id) AS width
    FROM dealt""".replace("{SPREAD}", SPREAD)


@query("SET-1 VEC-9 WIN-6 WIN-7 VEC-8", PREPARED)
def training_batches(v):
    """The whole preparation job."""
    message = F.concat_ws(" ", "message", F.lit("at"), (F.col("message_id") % 7).cast("string"))
    rows = v.segments.select("message_id", "dataset_name", "ope", "agr", message.alias("message"))
    corpora = {
        name: rows.where(F.col("dataset_name") == name).drop("dataset_name") for name in ("a", "b")
    }
    made = prepare_batches(
        corpora, 32, 0.8, cols=["ope", "agr"], max_length=12, shuffle_key=F.expr(SPREAD)
    )
    ones = F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m)
    out = made.select(
        "message_id",
        "split",
        "batch_id",
        r6("ope").alias("ope"),
        r6("agr").alias("agr"),
        ones.alias("ones"),
        F.size("attention_mask").alias("width"),
    )
    return longs(out, "ones", "width")


@query(
    "VEC-7",
    """WITH seqs AS (
           SELECT seq_id, seq_id // 4 AS batch_id, list(pos ORDER BY pos) AS x
           FROM {tokens} WHERE mask = 1 GROUP BY seq_id)
       SELECT seq_id, batch_id, i - 1 AS pos, coalesce(cast(x[i] AS double), 0.0) AS value
       FROM (SELECT *, max(len(x)) OVER (PARTITION BY batch_id) AS w FROM seqs) s,
            range(1, 9) AS d(i)
       WHERE i <= w""",
)
def padded_sequences(v):
    seqs = (
        v.tokens.where("mask = 1")
        .groupBy("seq_id")
        .agg(F.sort_array(F.collect_list(F.col("pos").cast("double"))).alias("x"))
        .withColumn("batch_id", F.floor(F.col("seq_id") / 4))
    )
    padded = prep.pad_to_batch(seqs, "batch_id", "x")
    return cells(padded, ["seq_id", "batch_id"], "x")


@query(
    "VEC-8",
    """WITH lists AS (
           SELECT message_id, user_id,
                  list_filter(regexp_split_to_array(message, '\\s+'), lambda w: w <> '')[1:512] AS t
           FROM {messages}),
       wide AS (SELECT *, max(len(t)) OVER (PARTITION BY user_id) AS w FROM lists)
       SELECT message_id, w AS width, len(t) AS ones, md5(array_to_string(t, ' ')) AS fingerprint
       FROM wide""",
)
def token_masks(v):
    rows = v.messages.withColumn("tokens", prep.words(F.col("message")))
    masked = prep.truncate_mask(rows, "tokens", batch="user_id")
    ones = F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m)
    real = F.slice("tokens", F.lit(1), ones)
    counted = masked.select(
        "message_id",
        F.size("attention_mask").alias("width"),
        ones.alias("ones"),
        F.md5(F.array_join(real, " ")).alias("fingerprint"),
    )
    return longs(counted, "width", "ones")


@query(
    "VEC-8",
    """SELECT doc_id, least(512, len(list_filter(regexp_split_to_array(text, '\\s+'),
                                                 lambda w: w <> ''))) AS ones
       FROM documents""",
)
def document_token_masks(v):
    rows = v.documents.select("doc_id", prep.words(F.col("text")).alias("tokens"))
    masked = prep.truncate_mask(rows, "tokens")
    return longs(masked.select("doc_id", F.size("attention_mask").alias("ones")), "ones")
