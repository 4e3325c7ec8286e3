import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from featloom.llm import langid
from featloom.llm.common import held_out
from tests.llm.helpers import ODD, empty_docs, odd_docs, run, table, write_tables
from tests.oracle import DATA

FOLDER = f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def net(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return langid.learn(docs.where(~held_out(F.col("doc_id"), 5, 0)))


def test_gradients_by_differences(monkeypatch):
    """Backpropagation through time against central differences, in double precision."""
    monkeypatch.setattr(langid, "WINDOW", 7)
    rng = np.random.default_rng(0)
    h = langid.HIDDEN
    shapes = {"table": (2, 2, 257, h), "state": (2, 2, h, h), "out": (3, 2 * h), "bias": (3, 1)}
    w = {k: rng.normal(0, 0.5, s).astype(np.float32) for k, s in shapes.items()}
    cells = rng.integers(0, 9, (5, 7)).astype(np.int16)
    length, target = np.array([7, 7, 3, 5, 7]), np.array([0, 1, 2, 0, 1])
    for i, n in enumerate(length):
        cells[i, n:] = langid.PAD

    def loss(w):
        net = langid.Network(("a", "b", "c"), **w)
        states = langid._run(net, 0, cells), langid._run(net, 1, cells)
        total = 0.0
        for t in range(7):
            p = langid.position_probabilities(net, *states, t)
            total -= (np.log(p[target, np.arange(5)]) * (t < length)).sum()
        return total / length.sum()

    grads = langid._gradients(langid.Network(("a", "b", "c"), **w), cells, length, target)
    for name, g in grads.items():
        strong = np.argsort(np.abs(g).ravel())[-4:]
        for k in strong:
            ends = []
            for step in (1e-2, -1e-2):
                moved = {n: v.copy() for n, v in w.items()}
                moved[name].ravel()[k] += step
                ends.append(loss(moved))
            assert g.ravel()[k] == pytest.approx((ends[0] - ends[1]) / 2e-2, rel=0.05, abs=2e-4)


def test_query_on_held_out_documents(spark):
    rows = {r.doc_id: r for r in run(spark, "op2_language_id", FOLDER).collect()}
    docs = table("documents", FOLDER)
    assert len(rows) == len(docs)
    right = []
    for doc_id, _, lang, *_ in docs:
        out = zlib.crc32(str(doc_id).encode()) % 5 == 0
        assert rows[doc_id].held_out == out and 0 <= rows[doc_id].score <= 1
        if out:
            right.append(rows[doc_id].lang_pred == lang)
    assert np.mean(right) > 0.97


def test_odd_rows(spark, net):
    docs = odd_docs(spark).drop("score")
    rows = langid.identify(docs, net, keep=["doc_id", "text", "kept"], spans=True).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
        assert r.lang_pred in (*net.langs, "und")
        assert letters or r.score == 0
        size = len((r.text or "").encode())
        ends = [s.end for s in r.lang_spans]
        assert [s.start for s in r.lang_spans] == ([0, *ends[:-1]] if size else [])
        assert not size or ends[-1] == size
    with pytest.raises(ValueError, match="score"):
        langid.identify(odd_docs(spark), net, keep=["score"])


def test_empty_tables(spark, net):
    assert langid.identify(empty_docs(spark), net, keep=["doc_id"]).count() == 0
    assert langid.learn(empty_docs(spark)) is None


def test_labels_follow_a_change_of_language(spark, net):
    docs = {r[2]: r[1] for r in table("documents", FOLDER) if len(r[1]) > 1500}
    text = docs["en"][:1024] + docs["de"][:1024]
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    row = langid.identify(df, net, keep=["doc_id"], spans=True).first()
    half = len(docs["en"][:1024].encode())
    first = sum(min(s.end, half) - s.start for s in row.lang_spans if s.lang == "en" and s.start < half)
    assert first / half > 0.8


def test_nothing_to_learn_from(spark, tmp_path):
    """Empty tables, and rows that may all not be learned from: every text is undetermined."""
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string").selectExpr("*", "CAST(NULL AS string) AS lang")
    for k, (rows, n) in enumerate(((docs, 2), (docs.limit(0), 0))):
        folder = write_tables(spark, str(tmp_path / str(k)), rows)
        found = run(spark, "op2_language_id", folder).collect()
        assert len(found) == n and all(r.lang_pred == "und" and r.score == 0 for r in found)
    spans = langid.identify(docs, None, keep=["doc_id"], spans=True).collect()
    assert [r.lang_spans for r in spans] == [[], []]


def test_many_rows_of_one_key(spark):
    texts = ["the river and the house ", "la maison et le fleuve "]
    rows = [(None, texts[i % 2] * 3 + str(i), "ef"[i % 2]) for i in range(7000)]
    net = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    assert net.langs == ("e", "f")
    found = langid.identify(spark.createDataFrame([(t,) for t in texts], "text string"), net, keep=["text"]).collect()
    assert {r.text: r.lang_pred for r in found} == dict(zip(texts, "ef", strict=True))
