import random

import pytest
from pyspark.sql import functions as F

from featloom.llm import urlrules
from tests.llm.helpers import SF, run
from tests.oracle import connect, duck_rows, spark_rows

import __spark_entry__ as entry


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [
        (len(h + p), len(h), h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def judged(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id int, url string, rule string, other string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    rows = urlrules.judge_urls(df, table).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}, rows


def test_query_matches_sql(spark):
    con = connect(SF)
    name = "op8_url_filters"
    assert spark_rows(run(spark, name)) == duck_rows(con, entry.oracle_sql()[name])


def test_random_rules_and_urls(spark):
    rng = random.Random(4)
    hosts = ["a", "b.a", "c.b.a", "ab.a", "b", "a.b", ""]
    paths = ["/", "/x", "/x/", "/x/y", "/xy", "", "/y/x/x"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in hosts[:6] for p in paths if rng.random() < 0.5]
    urls = [f"{s}://{'w.' * rng.randint(0, 2)}{h}{p}{t}" for h in hosts for p in paths for s in ("http", "A://B") for t in ("", "?q=/x", "#/x")]
    urls += [None, "", "nothing", "://", "http://", "http://A.B/X", "http://b.A?x://y/z", "x\ny://b.a/x\nz"]
    found, rows = judged(spark, urls, rules)
    assert len(rows) == len(urls)
    for i, url in enumerate(urls):
        assert found[i] == brute(url, rules), url


@pytest.mark.parametrize("cuts", [1, 2, 16])
def test_cuts_agree(spark, monkeypatch, cuts):
    monkeypatch.setattr(urlrules, "CUTS", cuts)
    rules = [("a", "/", "allow"), ("a", "/1", "block"), ("b.a", "/12", "allow")]
    urls = [f"http://{h}/{i}" for i in range(40) for h in ("a", "b.a", "c")]
    found, _ = judged(spark, urls, rules)
    assert all(found[i] == brute(u, rules) for i, u in enumerate(urls))


def test_nested_intervals_and_odd_labels(spark):
    """Stacks of depth, intervals that close, and hosts that hold the marks of keys themselves."""
    odd = ["\x01", "a\x01b", "a\x02", "\x03", "\x03a", "a..b", ".", "com", "co", "comm", "b.com", "x.b.com", "bb.com", "z"]
    rules = [(h, p, "block" if i % 2 else "allow") for i, h in enumerate(odd) for p in ("/", "/p", "/p/q", "/p/q/r\U0010ffff", "/pp")]
    hosts = odd + [f"w.{h}" for h in odd] + ["a.b", "a.x.b.com", "\x02", "com\x01", "com\x02"]
    urls = [f"h://{h}{p}" for h in hosts for p in ("/", "/p", "/p/", "/p/q/r", "/p/q/r\U0010ffff/", "/pq", "/q", "")]
    found, _ = judged(spark, urls, rules)
    assert all(found[i] == brute(u, rules) for i, u in enumerate(urls))


def test_a_host_with_all_urls_is_spread(spark):
    urls = [f"http://www.example.com/{i}/" for i in range(4000)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string").repartition(4)
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/7", "block")], "host string, path string, verdict string")
    made = urlrules.judge_urls(df, rules)
    assert made.where("verdict = 'block'").count() == sum(u.startswith("http://www.example.com/7") for u in urls)
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        known = rules.select(urlrules.host_key(F.col("host")).alias("key"), "path")
        points = df.select(F.lit("com\x01example\x01www\x01").alias("key"), F.pmod(F.xxhash64("url"), F.lit(32)).cast("int").alias("salt"), "url")
        swept = urlrules._sweep(points, urlrules._host_events(known), ["key"], 32)
        sizes = swept.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_empty_tables(spark):
    rules = [("a", "/", "block")]
    assert judged(spark, [], rules)[1] == []
    assert judged(spark, ["http://a/", None], [])[0] == {0: ("a", "/", None, "allow"), 1: ("", "", None, "allow")}


def test_plan_has_no_python(spark):
    plan = run(spark, "op8_url_filters")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
