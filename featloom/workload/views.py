"""Views that give the test tables the shape of segment, feature and run tables.

One text serves Spark and DuckDB; ``{name}`` stands for a base table or view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    # One row per utterance, two corpora, ten outcomes.
    "segments": """
        SELECT user_id, event_id AS message_id,
               concat('seg_', cast(event_id AS varchar(20)), '.wav') AS filename,
               event_type AS message,
               CASE WHEN event_id % 3 = 0 THEN 'b' ELSE 'a' END AS dataset_name,
               (value * 1) % 97 AS ope, (value * 2) % 97 AS agr, (value * 3) % 97 AS ext,
               (value * 4) % 97 AS con, (value * 5) % 97 AS neu, (value * 6) % 97 AS valence,
               (value * 7) % 97 AS arousal, (value * 8) % 97 AS ang, (value * 9) % 97 AS anx,
               (value * 10) % 97 AS dep
        FROM {events}""",
    "feats": "SELECT vec_id AS message_id, embedding, label FROM {embeddings}",
    "cohort": "SELECT doc_id AS message_id FROM {labels} WHERE quality = 1",
    # Sequences of eight positions with right-padded masks.
    "tokens": """
        SELECT cast((vec_id - vec_id % 8) / 8 AS bigint) AS seq_id, vec_id % 8 AS pos,
               CASE WHEN vec_id % 8 < 3 + cast((vec_id - vec_id % 8) / 8 AS bigint) % 6
                    THEN 1 ELSE 0 END AS mask,
               embedding AS vec
        FROM {embeddings}""",
    # The first half of the vectors as students, the second half as teachers.
    "pairs": """
        SELECT s.vec_id AS id, cast(floor(s.vec_id / 48.0) AS int) AS batch_id,
               s.embedding AS x, t.embedding AS y, s.label
        FROM {embeddings} s
        JOIN (SELECT vec_id - (SELECT cast(count(*) / 2 AS bigint) FROM {embeddings}) AS pair_id,
                     embedding
              FROM {embeddings}) t
          ON t.pair_id = s.vec_id""",
    "truth_long": """
        SELECT user_id, event_type AS feat, avg(value) AS value
        FROM {events} GROUP BY user_id, event_type""",
    # The mean of each outcome, for every user.
    "baseline": """
        SELECT 0 AS id, u.user_id AS group_id, g.feat, g.value
        FROM (SELECT user_id, event_type FROM {events} GROUP BY user_id, event_type) u
        JOIN (SELECT event_type AS feat, avg(value) AS value FROM {events} GROUP BY event_type) g
          ON u.event_type = g.feat""",
    # A user's mean over the first half of the month.
    "pred": """
        SELECT 0 AS id, user_id AS group_id, event_type AS feat,
               avg(CASE WHEN ts < timestamp '2024-01-16 00:00:00' THEN value END) AS value
        FROM {events} GROUP BY user_id, event_type""",
    "runlog": """
        SELECT user_id AS run_id, day(ts) - 1 AS epoch,
               CASE WHEN event_type IN ('error', 'view') THEN 'val' ELSE 'train' END AS phase,
               event_id AS step, value AS loss
        FROM {events}""",
    # Seven runs of thousands of epochs, at any scale a seventh of the table each; the loss falls slowly.
    "long_log": """
        SELECT l_linenumber AS run_id, l_orderkey AS epoch, 'val' AS phase, l_partkey AS step,
               (l_extendedprice / l_quantity) * (1 + 5000.0 / (5000 + l_orderkey)) AS loss
        FROM {lineitem}""",
    # Three series of two channels in three-hour slots, with gaps.
    "series": """
        SELECT user_id % 3 AS series_id, event_id % 2 AS channel,
               cast(floor(((day(ts) - 1) * 24 + hour(ts)) / 3.0) AS int) AS idx,
               avg(value) AS value
        FROM {events} GROUP BY 1, 2, 3""",
    # Seven series of two channels as long as the table, with gaps.
    "long_series": """
        SELECT l_linenumber AS series_id, l_suppkey % 2 AS channel, l_orderkey AS idx, avg(l_quantity) AS value
        FROM {lineitem} GROUP BY 1, 2, 3""",
    "messages": """
        SELECT conv_id AS user_id, conv_id * 100 + turn AS message_id, role, text AS message
        FROM {conversations}""",
}


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Views:
    """Base tables and views of one data folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            sql = VIEWS[name]
            df = self.spark.sql(sql, **{n: getattr(self, n) for n in _names(sql)})
        elif name in BASE:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        else:
            raise AttributeError(name)
        setattr(self, name, df)
        return df


def with_views(sql: str) -> str:
    """SQL for DuckDB: the views a text names, in order, then the text."""
    used: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in _names(text):
            if name in VIEWS and name not in used:
                visit(VIEWS[name])
                used[name] = VIEWS[name]

    def plain(text: str) -> str:
        return re.sub(r"\{(\w+)\}", r"\1", text)

    visit(sql)
    ctes = ", ".join(f"{name} AS ({plain(text)})" for name, text in used.items())
    body = plain(sql).strip()
    if not used:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes}, {body[len('WITH'):]}"
    return f"WITH {ctes} {body}"
