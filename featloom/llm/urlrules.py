"""URL rules by a sort-merge range join; DataFrame functions only.

A rule names a host with all its subdomains and the start of a path. The key of a host is its labels in
reverse, each with an end mark, so a rule's host is the interval of the keys that begin with its own; a
path is likewise the interval of the paths it begins. Intervals either nest or lie apart, so a sweep in
key order needs one stack of open ones. A rule's event carries the stack as it is from there on: itself
and the rules around it. A URL takes the stack of the last event before it and drops what has closed
since, which is what does not begin its key.

Two sweeps: over host keys, which gives each URL the hosts of rules it belongs to, and for each of these
over paths, which gives the longest rule. Both are cut by a hash of the URL, with a copy of the rules'
events in each of the cuts, so a host or a top-level domain with a third of all URLs is spread like any
other. Equal URLs are judged once.

A null URL, or one without ``://``: host and path empty, no rule. The longest rule wins, then the one
with the longer host; of repeated rules with different verdicts, the first verdict by name. An empty
table gives an empty result; other columns named like results are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Cuts of a sweep for each shuffle partition, so that partitions get about equally many.
CUTS = 4
#: Ends a label of a key; labels have it and its two neighbours written with the third.
END, _AFTER, _ESCAPE = "\x01", "\x02", "\x03"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels in reverse, each ended: a host's key begins the keys of its subdomains and no others."""
    for char, code in ((_ESCAPE, "c"), (_AFTER, "b"), (END, "a")):
        host = F.replace(host, F.lit(char), F.lit(_ESCAPE + code))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), END), F.lit(END))


def _host_events(rules: DataFrame) -> DataFrame:
    """(key, stack): each host of a rule with the keys of all hosts of rules that it belongs to."""
    hosts = rules.select("key").distinct()
    labels = F.split("key", END)  # the last one is empty
    starts = F.transform(
        F.sequence(F.lit(1), F.size(labels) - 1),
        lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), END), F.lit(END)),
    )
    inner = hosts.select(F.col("key").alias("inner"), F.explode(starts).alias("key"))
    around = inner.join(hosts, "key").groupBy("inner").agg(F.collect_list("key").alias("stack"))
    return around.withColumnRenamed("inner", "key")


def _path_events(rules: DataFrame) -> DataFrame:
    """(key, path, stack): each rule with itself and the rules of its host that begin its path."""
    lengths = rules.agg(F.collect_set(F.length("path"))).scalar()
    inner = rules.select("key", F.col("path").alias("inner"), lengths.alias("lengths")).select(
        "key", "inner", F.explode(F.filter("lengths", lambda n: n <= F.length("inner"))).alias("n")
    )
    starts = inner.select("key", "inner", F.substring(F.col("inner"), F.lit(1), F.col("n")).alias("path"))
    entry = F.struct(F.length("rule").alias("length"), F.length("key").alias("host_length"), "rule", "verdict", "path")
    return (
        starts.join(rules, ["key", "path"])
        .groupBy("key", "inner")
        .agg(F.collect_list(entry).alias("stack"))
        .withColumnRenamed("inner", "path")
    )


def _sweep(points: DataFrame, events: DataFrame, order: list[str], cuts: int) -> DataFrame:
    """The points with ``event``: the last event at or before each in ``order``, with its columns.

    Points are cut by their column ``salt``, and every cut sees all events.
    """
    columns = [c for c in points.columns if c not in ("salt", *order)]
    marked = points.withColumn("kind", F.lit(1))
    copies = events.withColumn("event", F.struct(*events.columns)).select(
        *order, "event", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("salt"), F.lit(0).alias("kind")
    )
    by = Window.partitionBy("salt").orderBy(*order, "kind")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        marked.unionByName(copies, allowMissingColumns=True)
        .withColumn("event", F.last("event", ignorenulls=True).over(so_far))
        .where("kind = 1 AND event IS NOT NULL")
        .select("salt", *order, *columns, "event")
    )


def judge_urls(
    df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """The rows with host, path, rule and verdict; ``rules`` has host, path and verdict."""
    made = {"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))}
    df = df.drop("rule", "verdict").withColumns(made)
    known = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).select(
        host_key(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict"
    )
    cuts = CUTS * partitions(df)
    urls = df.select("host", "path").distinct()
    points = urls.select(
        "host",
        "path",
        host_key(F.col("host")).alias("key"),
        F.pmod(F.xxhash64("host", "path"), F.lit(cuts)).cast("int").alias("salt"),
    )
    # The hosts of rules that are open at a URL's host, then the rules of each that are open at its path.
    open_hosts = F.filter("event.stack", lambda k: F.startswith(F.col("key"), k))
    belongs = _sweep(points, _host_events(known), ["key"], cuts).select(
        "salt", "host", "path", F.explode(open_hosts).alias("key")
    )
    open_rules = F.filter("event.stack", lambda r: F.startswith(F.col("path"), r["path"]))
    best = (
        _sweep(belongs, _path_events(known), ["key", "path"], cuts)
        .where("event.key = key")
        .select("host", "path", F.array_max(open_rules).alias("best"))
        .where("best IS NOT NULL")
        .groupBy("host", "path")
        .agg(F.max("best").alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    return df.join(best, ["host", "path"], "left").withColumn(
        "verdict", F.coalesce("verdict", F.lit(default))
    )


def parse_rules(spark, lines: list[tuple[str, str]]) -> DataFrame:
    """Rules from (verdict, "host/path") pairs."""
    rows = [(r[: r.index("/")], r[r.index("/") :], v) for v, r in lines]
    made = [
        f"SELECT '{h}' AS host, '{p}' AS path, '{v}' AS verdict" for h, p, v in rows
    ]
    return reduce(lambda a, b: a.unionByName(b), map(spark.sql, made))
