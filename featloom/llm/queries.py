"""The registered queries of this subpackage and their SQL forms."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontam,
    langid,
    lattice,
    minhash,
    quality,
    resample,
    search,
    secrets,
    shards,
    suffixdedup,
    tokencount,
    toxicity,
    urlrules,
)
from .common import held_out, read


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return lattice.round_trip(read(spark, sf_dir, "documents"), path, ["doc_id"])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    net = langid.learn(docs.where(~F.col("held_out")))
    return langid.identify(docs, net, keep=["doc_id", "held_out"])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    labels = read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 4, 2))
    scorer = toxicity.learn(docs, labels)
    return toxicity.score(docs, scorer, ["doc_id", "held_out"])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeated_bytes(read(spark, sf_dir, "documents")).drop("spans")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return tokencount.count_tokens(read(spark, sf_dir, "documents"), path, ["doc_id"])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn(docs, read(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    made = shards.propagate(
        read(spark, sf_dir, "documents"),
        "doc_id",
        size=F.octet_length(text) + 1,
        crc=F.crc32(text),
        group=F.xxhash64(text),
    )
    return made.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# The rules of the contract.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    judged = urlrules.judge_urls(pages, urlrules.parse_rules(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"]
    )
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        (F.size("leaks") == 0).alias("kept"),
        F.size("leaks").cast("long").alias("n_items"),
        F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"),
        F.array_min(F.transform("leaks", lambda x: x["edits"])).alias("least_edits"),
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, secrets.learn(docs), ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] != secrets.KINDS[3])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_language_id,
        op3_toxicity,
        op4_suffix_dedup,
        op5_token_counts,
        op6_quality_rules,
        op7_sharding,
        op8_url_filters,
        op9_minhash,
        op10_decontamination,
        op11_ranked_search,
        op12_importance_resampling,
        op13_secret_scans,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op11_ranked_search": r"""
        WITH texts AS (
            SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        asked AS (
            SELECT item_id, u.term, count(*) AS times FROM (
                SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark), unnest(w) AS u(term)
            GROUP BY ALL),
        postings AS (SELECT n, doc_id, len(w) AS size, u.term, count(*) AS tf FROM texts, unnest(w) AS u(term) GROUP BY ALL),
        total AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS size FROM texts WHERE len(w) > 0),
        weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, total GROUP BY term, docs),
        scores AS (
            SELECT item_id, n, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.size * docs) // t.size))))::BIGINT AS score
            FROM asked JOIN postings p USING (term) JOIN weight USING (term), total t GROUP BY ALL),
        placed AS (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
            FROM scores WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
    """,
    "op12_importance_resampling": r"""
        WITH RECURSIVE
        bits(i, k, v) AS (
            SELECT i, 0, i FROM range(256) AS r(i)
            UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
        crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS steps FROM bits WHERE k = 8),
        texts AS (SELECT true AS doc, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
        words AS (
            SELECT doc, id, row_number() OVER () AS n, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
        feats AS MATERIALIZED (
            SELECT doc, id, n, u.f FROM words, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS u(f)),
        names AS MATERIALIZED (
            SELECT f, xor(list_reduce(list_transform(range(0, strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT),
                lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 10000 AS bucket
            FROM (SELECT DISTINCT f FROM feats), crc),
        counts AS (SELECT bucket, count(*) FILTER (doc) AS s, count(*) FILTER (NOT doc) AS t FROM feats JOIN names USING (f) GROUP BY bucket),
        totals AS (SELECT count(*) FILTER (doc) AS s, count(*) FILTER (NOT doc) AS t FROM feats),
        gains AS (SELECT bucket, floor(1000 * ln((c.t + 1)::DOUBLE * (z.s + 10000) / ((c.s + 1)::DOUBLE * (z.t + 10000))))::BIGINT AS gain FROM counts c, totals z),
        means AS (
            SELECT n, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
            FROM feats JOIN names USING (f) JOIN gains USING (bucket) WHERE doc GROUP BY n),
        scored AS (
            SELECT id AS doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM words LEFT JOIN means USING (n) WHERE doc),
        placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS k FROM scored)
        SELECT doc_id, n_features, weight, score,
            CASE WHEN able AND k <= 25 * (SELECT count(*) FROM scored WHERE able) // 100 THEN k END AS rank
        FROM placed
    """,
    "op9_minhash": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) >= 5
                THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' ' || len(w)] ELSE [] END AS s
            FROM words),
        grams AS (SELECT doc_id, len(s) AS n, hash(g) AS g FROM sets, unnest(s) AS u(g)),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
        SELECT s.doc_id, len(s.s) AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
        FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
    """,
    "op8_url_filters": r"""
        WITH rules(host, path, verdict) AS (VALUES
            ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
            ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        parts AS (SELECT page_id,
            translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
            row_number() OVER () AS n
            FROM pages),
        fits AS (SELECT n, r.host || r.path AS rule, verdict,
            row_number() OVER (PARTITION BY n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
            FROM parts p JOIN rules r
            ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)
    """,
}
