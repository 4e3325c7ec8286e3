import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from featloom.llm import resample, terms
from tests.llm.helpers import ODD, empty_docs, odd_docs


def words_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def buckets_of(text):
    w = words_of(text)
    return [crc32(x) % 10_000 for x in w] + [crc32(a + b" " + b) % 10_000 for a, b in zip(w, w[1:])]


def plain(docs, target):
    """The contract's numbers in the plainest way; repeated rows are rows of their own."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets_of(text))
    for text in target:
        t.update(buckets_of(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for key, text in docs:
        f = buckets_of(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in f]
        weight = sum(gain) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / (1 << 32))))
        out.append((key, len(f), weight, score, len(words_of(text))))
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    k = 25 * len(able) // 100
    drawn = [(*r[:4], i + 1) for i, r in enumerate(able[:k])]
    rest = [(*r[:4], None) for r in able[k:]] + [(*r[:4], None) for r in out if r[4] < 20]
    return sorted(drawn + rest, key=repr)


def made(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def target(spark, texts):
    return spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "item_id long, text string")


def test_odd_rows_and_clashing_columns(spark):
    texts = ["one two three", None, ""]
    found = resample.resample(odd_docs(spark).withColumn("rank", F.lit("x")), target(spark, texts))
    assert made(found) == plain(ODD, texts)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_empty_tables(spark):
    assert resample.resample(empty_docs(spark), target(spark, ["a b"])).count() == 0
    docs = [(i, "a b c d e " * 5) for i in range(9)]
    assert made(resample.resample(frame(spark, docs), target(spark, ["a"]).limit(0))) == plain(docs, [])


def test_one_row_repeated_for_a_third_and_ties(spark):
    rng = random.Random(5)
    some = ["alpha", "Beta", "gamma", "Ünï", "x9", "42", "漢字"]
    docs = [(i % 90, " ".join(rng.choices(some, k=rng.randint(15, 30)))) for i in range(400)]
    docs += [(1, "alpha beta " * 15)] * 200 + [(None, "gamma x9 " * 12)] * 7
    texts = ["alpha beta gamma", "漢字 42"]
    assert made(resample.resample(frame(spark, docs).repartition(5), target(spark, texts))) == plain(docs, texts)


def test_long_text_in_stretches():
    rng = random.Random(1)
    text = b" ".join(b"w%d" % rng.randrange(500) for _ in range(3000)) + b" " + b"z" * 900 + b"  "
    whole = list(terms.stretches(text, terms.LETTERS_DIGITS))
    assert len(whole) == 1
    for most in (1, 7, 64, 500):
        pieces = list(terms.stretches(text, terms.LETTERS_DIGITS, most))
        assert len(pieces) > 1 and sum(pieces, []) == whole[0]
    kept = terms.STRETCH
    try:
        resample.stretches.__defaults__ = (50,)
        got = sorted(int(x) for _, ids in resample.bucket_ids(text) for x in ids)
    finally:
        resample.stretches.__defaults__ = (kept,)
    assert got == sorted(buckets_of(text.decode()))


@pytest.mark.parametrize("pivots", [1, 2, 15])
def test_quickselect_against_sorting(spark, pivots):
    rng = random.Random(pivots)
    rows = [(rng.randrange(6), rng.choice([None, 1, 2, 3]), "x") for _ in range(120)] + [(3, 2, "y")] * 60
    df = spark.createDataFrame(rows, "a long, b long, c string").repartition(4).cache()
    whole = sorted([r[:2] for r in rows], key=lambda r: (r[0], r[1] is None, r[1] or 0))
    for k in (1, 59, 100, 180):
        key, n_before, n_same = resample.kth(df, ["a", "b"], k, pivots)
        assert key == whole[k - 1]
        assert (n_before, n_same) == (whole.index(key), whole.count(key))
    assert resample.kth(df, ["a", "b"], 181, pivots) is None


def test_ranks_do_not_depend_on_ranges(spark):
    rows = spark.range(300).select(F.pmod(F.col("id") * 7, F.lit(300)).alias("v"), (F.col("id") % 4).alias("n"))
    found = sorted((r["rank"], r.v) for r in resample.ranked(rows, ["v"]).collect())
    want = [v for v in range(300) for _ in range(next(i for i in range(300) if i * 7 % 300 == v) % 4)]
    assert found == [(i + 1, v) for i, v in enumerate(want)]
