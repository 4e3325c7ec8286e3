"""Projections, joins, reshapes and set operations over segment and feature tables."""

from pyspark.sql import functions as F

from featloom import fixed
from featloom.functions import text
from featloom.operators import encode, groupfeats, prep, reshape
from featloom.plans import feature_tables
from featloom.sinks import tables
from featloom.sources import csv, media
from featloom.workload.registry import cells, longs, query, r6

OUTCOMES = fixed.OUTCOMES
ROUNDED = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in OUTCOMES)


@query("PRJ-1", "SELECT user_id, message_id FROM {segments}")
def segment_ids(v):
    return v.segments.select("user_id", "message_id")


@query(
    "PRJ-2",
    "SELECT group_id AS user_id, feat, round(value, 6) + 0.0 AS value FROM {pred}",
)
def prediction_columns(v):
    return reshape.prediction_rows(v.pred).withColumn("value", r6("value"))


@query("PRJ-3", f"SELECT message_id, {ROUNDED} FROM {{segments}}")
def outcome_columns(v):
    names = reshape.features_after(v.segments, 5)
    return v.segments.select("message_id", *[r6(c).alias(c) for c in names])


@query(
    "PRJ-4",
    """SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic
       FROM documents d JOIN labels l ON l.doc_id = d.doc_id
       WHERE d.lang IS NOT NULL AND d.n_chars IS NOT NULL
         AND l.quality IS NOT NULL AND l.toxic IS NOT NULL""",
)
def complete_rows(v):
    joined = v.documents.select("doc_id", "lang", "n_chars").join(v.labels, "doc_id", "left")
    return reshape.drop_incomplete(joined)


@query(
    "PRJ-5 PRJ-6 RSH-1 SNK-2",
    " UNION ALL ".join(
        f"""SELECT message_id AS group_id, '{c}' AS feat, round({c}, 6) + 0.0 AS value,
                   round({c}, 6) + 0.0 AS group_norm FROM {{segments}}"""
        for c in OUTCOMES
    ),
)
def outcomes_long(v):
    wide = v.segments.drop("user_id", "filename", "message", "dataset_name")
    long = feature_tables.frame_to_long(wide, "message_id", "bigint")
    return long.withColumns({"value": r6("value"), "group_norm": r6("group_norm")})


@query(
    "PRJ-8 SRC-4",
    """SELECT message_id,
              CASE dataset_name WHEN 'a' THEN 'hitop' ELSE 'wtc' END AS dataset_name,
              CASE dataset_name WHEN 'a' THEN 'string' ELSE 'int' END AS id_type,
              CASE dataset_name WHEN 'b' THEN cast(user_id AS integer) END AS int_id
       FROM {segments}""",
)
def corpus_routing(v):
    folder = F.when(F.col("dataset_name") == "a", "hitop").otherwise("wtc")
    files = v.segments.select(
        "message_id",
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("/data/embeddings/"), folder, F.lit("_embeddings.csv")).alias("path"),
    )
    int_id = groupfeats.typed_group_id(F.col("user_id"), "wtc")
    return media.with_corpus(files, "path").select(
        "message_id",
        "dataset_name",
        "id_type",
        F.when(F.col("id_type") == "int", int_id).alias("int_id"),
    )


@query(
    "SRC-5",
    """SELECT message_id, CASE dataset_name WHEN 'a' THEN '/media/first/' ELSE '/media/second/' END
              || filename AS path
       FROM {segments}""",
)
def media_paths(v):
    folders = {"a": "/media/first", "b": "/media/second/"}
    return media.with_media_path(v.segments, folders).select("message_id", "path")


@query(
    "PRJ-13 PRJ-12",
    """SELECT dataset_name, message_id, '/m/' || dataset_name || '/' || filename AS path, message
       FROM {segments}""",
)
def inference_rows(v):
    paths = media.with_media_path(v.segments, {"a": "/m/a", "b": "/m/b"})
    return prep.inference_view(paths)


@query(
    "PRJ-13 RSH-4",
    f"""SELECT '/m/' || dataset_name || '/' || filename AS path, message,
              i - 1 AS pos, round(cast(cast(value AS float) AS double), 4) + 0.0 AS value
       FROM (SELECT *, [{', '.join(OUTCOMES)}] AS o FROM {{segments}}),
            unnest(o) WITH ORDINALITY AS u(value, i)""",
)
def training_rows(v):
    paths = media.with_media_path(v.segments, {"a": "/m/a", "b": "/m/b"})
    return cells(prep.training_view(paths), ["path", "message"], "outcomes", 4)


@query(
    "PRJ-14",
    r"SELECT message_id, regexp_replace(message, '[^\x00-\x7F]+', '', 'g') AS message FROM {messages}",
)
def ascii_messages(v):
    return v.messages.select("message_id", text.strip_non_ascii(F.col("message")).alias("message"))


@query(
    "JON-1",
    """SELECT s.user_id, s.message_id, f.label, f.message_id IS NOT NULL AS matched
       FROM {segments} s LEFT JOIN {feats} f ON f.message_id = s.message_id""",
)
def segments_with_features(v):
    joined = groupfeats.attach_features(v.segments.select("user_id", "message_id"), v.feats)
    return joined.select(
        "user_id", "message_id", "label", F.col("embedding").isNotNull().alias("matched")
    )


@query(
    "JON-2 PRJ-10",
    """SELECT message_id, label FROM {feats}
       WHERE message_id IN (SELECT message_id FROM {cohort})""",
)
def cohort_rows(v):
    return groupfeats.cohort(v.feats.select("message_id", "label"), v.cohort)


@query(
    "JON-2 SET-1 RSH-1 PRJ-6",
    """SELECT f.message_id AS group_id, printf('f%04d', i - 1) AS feat,
              round(cast(value AS double), 6) + 0.0 AS value,
              round(cast(value AS double), 6) + 0.0 AS group_norm
       FROM {feats} f, unnest(f.embedding) WITH ORDINALITY AS u(value, i)
       WHERE f.message_id IN (SELECT message_id FROM {cohort})
         AND f.message_id IN (SELECT message_id FROM {segments})""",
)
def cohort_feature_table(v):
    corpora = {
        name: groupfeats.cohort(
            v.feats.drop("label"), v.segments.where(F.col("dataset_name") == name)
        )
        for name in ("a", "b")
    }
    long = feature_tables.cohort_feature_table(corpora, v.cohort)
    return long.withColumns({"value": r6("value"), "group_norm": r6("group_norm")})


USER_FEATURES = """
    SELECT user_id AS group_id, printf('f%04d', i - 1) AS feat,
           round(avg(cast(f.embedding[i] AS double)), 6) + 0.0 AS value,
           round(avg(cast(f.embedding[i] AS double)), 6) + 0.0 AS group_norm
    FROM (SELECT user_id, message_id FROM {segments}) s
    LEFT JOIN {feats} f ON f.message_id = s.message_id, POSITIONS AS d(i)
    GROUP BY user_id, i"""


@query("AGG-1 JON-1 RSH-1 PRJ-6", USER_FEATURES.replace("POSITIONS", "range(1, 65)"))
def user_features(v):
    """The flagship: per-user mean of every feature, users without a match kept."""
    long = feature_tables.user_feature_table(v.segments, v.feats)
    return long.withColumns({"value": r6("value"), "group_norm": r6("group_norm")})


@query("AGG-1", USER_FEATURES.replace("POSITIONS", "range(1, 65)"))
def user_features_merged(v):
    """The same from two halves of the segments, a third of the features after the first of them."""
    halves = [v.segments.where(F.col("message_id") % 2 == i).select("user_id", "message_id") for i in (0, 1)]
    early = F.col("message_id") % 3 != 0
    first = groupfeats.group_states(halves[0], v.feats.where(early))
    waiting = halves[0].join(v.feats.where(early).select("message_id"), "message_id", "left_anti")
    states, _ = groupfeats.advance_states(first, waiting, halves[1], v.feats, v.feats.where(~early))
    long = groupfeats.means_of_states(states)
    return long.withColumns({"value": r6("value"), "group_norm": r6("group_norm")})


@query("AGG-1 PRJ-5", USER_FEATURES.replace("POSITIONS", "unnest([1, 8, 64])"))
def user_features_selected(v):
    long = feature_tables.user_feature_table(
        v.segments, v.feats, feats_only=["f0000", "f0007", "f0063"]
    )
    return long.withColumns({"value": r6("value"), "group_norm": r6("group_norm")})


@query("AGG-2", "SELECT DISTINCT user_id FROM {segments} ORDER BY user_id")
def user_keys(v):
    return groupfeats.group_keys(v.segments, "user_id")


@query("AGG-13", "SELECT dataset_name, count(*) AS rows FROM {segments} GROUP BY dataset_name")
def corpus_rows(v):
    return prep.row_counts(v.segments, "dataset_name")


@query("AGG-14", "SELECT max(length(feat)) AS max_length FROM {truth_long}")
def longest_feature(v):
    return longs(reshape.longest_feature(v.truth_long), "max_length")


FEATS = ["click", "error", "purchase", "signup", "view"]


@query(
    "RSH-2",
    "SELECT user_id, "
    + ", ".join(
        f"round(max(CASE WHEN feat = '{f}' THEN value END), 6) + 0.0 AS {f}" for f in FEATS
    )
    + " FROM {truth_long} GROUP BY user_id",
)
def truth_wide(v):
    wide = reshape.to_wide(v.truth_long, "user_id")
    names = reshape.feature_columns(wide, ["user_id"])
    return wide.select("user_id", *[r6(f).alias(f) for f in names])


@query(
    "RSH-3 PRJ-11",
    "SELECT message_id, "
    + ", ".join(
        f"round(cast(embedding[{i + 1}] AS double), 6) + 0.0 AS f{i:04d}" for i in range(64)
    )
    + " FROM {feats}",
)
def vector_columns(v):
    wide = reshape.vec_to_cols(v.feats, ["message_id"], "embedding")
    names = reshape.feature_columns(wide, ["message_id"])
    return wide.select("message_id", *[r6(F.col(c).cast("double")).alias(c) for c in names])


@query(
    "RSH-4",
    f"""SELECT message_id, i - 1 AS pos,
              round(cast(cast(value AS float) AS double), 4) + 0.0 AS value
       FROM (SELECT message_id, [{', '.join(OUTCOMES)}] AS o FROM {{segments}}),
            unnest(o) WITH ORDINALITY AS u(value, i)""",
)
def outcome_vectors(v):
    rows = reshape.outcome_vector(v.segments, ["message_id"])
    return cells(rows, ["message_id"], "outcomes", 4)


@query("RSH-1", """
    SELECT f.message_id, printf('f%04d', i - 1) AS feat,
           round(cast(value AS double), 6) + 0.0 AS value
    FROM {feats} f, unnest(f.embedding) WITH ORDINALITY AS u(value, i)""")
def vectors_long(v):
    long = reshape.vec_to_long(v.feats, ["message_id"], "embedding")
    return long.withColumn("value", r6("value"))


@query(
    "SET-1 PRJ-12",
    """SELECT 'documents' AS dataset_name, doc_id AS message_id, length(text) AS n, lang,
              cast(NULL AS varchar) AS role FROM documents
       UNION ALL
       SELECT 'conversations', message_id, length(message), NULL, role FROM {messages}""",
)
def corpus_union(v):
    union = groupfeats.tagged_union(
        {
            "documents": v.documents.select(
                F.col("doc_id").alias("message_id"), F.length("text").alias("n"), "lang"
            ),
            "conversations": v.messages.select(
                "message_id", F.length("message").alias("n"), "role"
            ),
        }
    )
    return longs(union.select("dataset_name", "message_id", "n", "lang", "role"), "n")


@query(
    "PRJ-7",
    """SELECT cast(user_id AS int) AS user_id, cast(message_id AS varchar) AS message_id, filename,
              message, round(cast(cast(ope AS float) AS double), 4) + 0.0 AS ope,
              round(cast(cast(agr AS float) AS double), 4) + 0.0 AS agr
       FROM {segments}""",
)
def typed_segments(v):
    rows = v.segments.select("user_id", "message_id", "filename", "message", "ope", "agr")
    floats = {c: F.round(F.col(c).cast("double"), 4) + F.lit(0.0) for c in ("ope", "agr")}
    return tables.typed(rows).withColumns(floats)


@query(
    "SRT-3 SRC-3",
    r"""SELECT path, regexp_replace(regexp_extract(path, '[^/]*$'), '^(.+)\.[^.]+$', '\1') AS stem,
              lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\.[^.]+)$', 1)) AS suffix,
              length, modified
       FROM (SELECT concat('/media/', filename) AS path, cast(message_id * 16 AS bigint) AS length,
                    message_id AS modified FROM {segments})
       ORDER BY path""",
)
def media_files(v):
    files = v.segments.select(
        F.concat(F.lit("/media/"), "filename").alias("path"),
        (F.col("message_id") * 16).cast("long").alias("length"),
        F.col("message_id").alias("modificationTime"),
    )
    return media.listing(files)


# Texts a CSV column may hold, made from the events: numbers, Java's number suffixes, missing tokens.
CELLS = """
    SELECT event_id,
           CASE WHEN event_id % 11 = 0 THEN 'NA' ELSE cast(event_id AS varchar(20)) END AS whole,
           CASE WHEN event_id % 5 = 0 THEN 'null' WHEN event_id % 3 = 0
                THEN concat(cast(event_id AS varchar(20)), 'e-1')
                ELSE concat(cast(event_id AS varchar(20)), '.5') END AS number,
           CASE WHEN event_id % 2 = 0 THEN concat(cast(event_id AS varchar(20)), 'f')
                ELSE concat(cast(event_id AS varchar(20)), 'd') END AS id,
           CASE WHEN event_id % 7 = 0 THEN '<NA>' ELSE event_type END AS word
    FROM {events}"""


@query(
    "SRC-1",
    f"""SELECT event_id, round(CASE WHEN whole <> 'NA' THEN cast(whole AS double) END, 6) AS whole,
               round(CASE WHEN number <> 'null' THEN cast(number AS double) END, 6) AS number,
               id, CASE WHEN word <> '<NA>' THEN word END AS word
        FROM ({CELLS})""",
)
def typed_cells(v):
    texts = v.spark.sql(CELLS, events=v.events)
    made = csv.typed_cells(texts.withColumn("event_id", F.col("event_id").cast("string")))
    return made.withColumns({c: F.round(c, 6) for c in ("whole", "number")})


IDS = [("customer", "c_custkey"), ("orders", "o_custkey"), ("events", "user_id")]


@query(
    "SET-2 JON-3",
    " INTERSECT ".join(f"SELECT {c} AS user_id FROM {t}" for t, c in IDS),
)
def common_users(v):
    frames = [getattr(v, t).select(F.col(c).alias("user_id")) for t, c in IDS]
    return groupfeats.common_ids(frames)


@query(
    "JON-3 AGG-13",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS source, count(*) AS rows FROM {t}
            WHERE {c} IN ({" INTERSECT ".join(f"SELECT {c2} FROM {t2}" for t2, c2 in IDS)})"""
        for t, c in IDS
    ),
)
def common_user_rows(v):
    frames = [getattr(v, t).select(F.col(c).alias("user_id")) for t, c in IDS]
    kept = groupfeats.keep_common(frames)
    tagged = groupfeats.tagged_union({t: f for (t, _), f in zip(IDS, kept)}, "source")
    return prep.row_counts(tagged, "source")


@query("SET-3", "SELECT DISTINCT url AS path FROM pages")
def distinct_paths(v):
    return encode.distinct_inputs(v.pages.select(F.col("url").alias("path")))


@query(
    "SRT-1 RSH-1",
    """SELECT user_id, feat, round(value, 6) + 0.0 AS value FROM {truth_long}
       ORDER BY user_id, feat""",
)
def truth_sorted(v):
    return v.truth_long.withColumn("value", r6("value")).orderBy("user_id", "feat")


@query(
    "STR-1",
    r"""SELECT page_id, regexp_extract(url, '[^/]*$') AS base_name,
              CASE WHEN regexp_matches(url, '[^/]\.[^./]+$')
                   THEN regexp_extract(url, '([^/]+)\.[^./]+$', 1)
                   ELSE regexp_extract(url, '[^/]*$') END AS stem,
              CASE WHEN regexp_matches(url, '[^/]\.[^./]+$')
                   THEN lower(regexp_extract(url, '\.[^./]+$')) ELSE '' END AS suffix
       FROM pages""",
)
def path_parts(v):
    url = F.col("url")
    return v.pages.select(
        "page_id",
        text.base_name(url).alias("base_name"),
        text.stem(url).alias("stem"),
        text.suffix(url).alias("suffix"),
    )


@query(
    "WIN-5 SNK-5 STR-1",
    r"""SELECT stem, path, page_id FROM (
          SELECT *, row_number() OVER (PARTITION BY stem ORDER BY path DESC) AS rn FROM (
            SELECT page_id, url || '#' || cast(page_id AS varchar) AS path,
                   CASE WHEN regexp_matches(url, '[^/]\.[^./]+$')
                        THEN regexp_extract(url, '([^/]+)\.[^./]+$', 1)
                        ELSE regexp_extract(url, '[^/]*$') END AS stem
            FROM pages))
       WHERE rn = 1""",
)
def last_page_per_stem(v):
    pages = v.pages.select(
        text.stem(F.col("url")).alias("stem"),
        F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("path"),
        "page_id",
    )
    return encode.last_write_wins(pages)


