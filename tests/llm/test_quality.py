import re
from collections import Counter

import numpy as np
import pytest

from featloom.llm import quality
from tests.llm.helpers import ODD, documents, empty_docs, odd_docs, run
from tests.oracle import DATA

SYMBOLS = set("#*$%&|<>")


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in SYMBOLS for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_query_matches_brute_force(spark):
    found = {r.doc_id: r for r in run(spark, "op6_quality_rules").collect()}
    docs = documents()
    assert len(found) == len(docs)
    for doc_id, text in docs:
        expected = brute(text)
        assert tuple(found[doc_id][c] for c in quality.COUNTS) == expected
        failed = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        assert found[doc_id].base_failed == failed
        assert not (failed and found[doc_id].kept)


def test_odd_rows(spark):
    rows = quality.judge(odd_docs(spark), []).collect()
    expected = sorted((-1 if i is None else i, *brute(t)) for i, t in ODD)
    assert sorted((-1 if r.doc_id is None else r.doc_id, *(r[c] for c in quality.COUNTS)) for r in rows) == expected
    assert rows[0].host == "x"


def test_empty_table(spark):
    rules = [quality.Rule((("symbol_share", ">", 0.1),))]
    assert quality.judge(empty_docs(spark), rules).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.learn(empty_docs(spark), labels) == []


def test_covering_finds_the_planted_rule():
    rng = np.random.default_rng(0)
    x = rng.random((2000, len(quality.SHARES)))
    bad = (x[:, 0] > 0.8) & (x[:, 2] <= 0.5) | (x[:, 1] > 0.95)
    rules = quality.learn_list(x, bad)
    hit = np.any([r.covers(x) for r in rules], axis=0)
    assert (hit == bad).mean() > 0.98
    assert quality.learn_list(x, np.zeros(2000, bool)) == []


def test_plan_has_no_python(spark):
    plan = run(spark, "op6_quality_rules")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("n", [0, 1, 3])
def test_verdict_is_one_ordered_conditional(spark, n):
    rules = [quality.Rule((("n_words", "<=", float(k)),)) for k in range(n)]
    df = odd_docs(spark).drop("kept")
    kept = quality.with_statistics(df).select(quality.verdict(rules).alias("k")).collect()
    assert len(kept) == len(ODD)


def test_conditions_on_one_side_of_a_share_are_merged():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.SHARES)))
    bad = rng.random(3000) < x[:, 0] ** 4  # each tighter threshold gains a little
    for rule in quality.learn_list(x, bad):
        assert len({c[:2] for c in rule.conditions}) == len(rule.conditions)


def test_repeated_ids_are_one_row_and_the_base_rule_hides_no_lesson(spark):
    """20,000 copies of a labelled row count once; texts that the base rule rejects teach nothing."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{words} {'#$' * (40 if i % 3 == 0 else 0)} {i}") for i in range(300)]
    rows += [(i, "too short ###") for i in range(300, 900)] + [(1, rows[1][1])] * 20_000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, int(i < 300 and i % 3 > 0)) for i in range(900)], "doc_id long, quality int")
    rules = quality.learn(docs, labels)
    assert rules and all(c[0] == "symbol_share" for r in rules for c in r.conditions)
    kept = {r.doc_id: r.kept for r in quality.judge(docs.where("doc_id < 300").dropDuplicates(), rules).collect()}
    assert all(kept[i] == (i % 3 > 0) for i in range(300))


def test_precision_and_recall_on_labels_kept_apart(spark):
    """Learned on four fifths of the labels, measured on the others, behind the base rule and with it."""
    from pyspark.sql import functions as F

    folder = f"{DATA}/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    apart = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rules = quality.learn(docs.select("doc_id", "text"), labels.where(~apart))
    judged = quality.judge(docs.select("doc_id", "text"), rules).join(labels.where(apart), "doc_id")
    rows = judged.select("quality", "base_failed", "kept").collect()
    bad = [r for r in rows if r.quality == 0]
    behind = [r for r in rows if not r.base_failed]
    rejected = [r for r in behind if not r.kept]
    print("rules", [str(r) for r in rules])
    print("recall", sum(not r.kept for r in bad) / len(bad), "precision", sum(r.quality == 0 for r in rows if not r.kept) / max(1, sum(not r.kept for r in rows)))
    print("behind the base rule: bad", sum(r.quality == 0 for r in behind), "rejected", len(rejected), "of them bad", sum(r.quality == 0 for r in rejected))
    if rejected:
        assert sum(r.quality == 0 for r in rejected) / len(rejected) >= 0.75
    good = [r for r in rows if r.quality == 1]
    assert sum(not r.kept for r in good) / len(good) < 0.05
