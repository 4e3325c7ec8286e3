"""The stages against plain versions of what they promise, and on odd input."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm import test_decontam, test_minhash, test_suffixdedup
from tests.llm.helpers import empty_docs, odd_docs, table, write_tables
from tests.oracle import DATA

FOLDER = f"{DATA}/sf0.001"


def stage(spark, name, docs, folder=FOLDER):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, folder)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_language_keeps_what_has_letters(spark, documents):
    extra = spark.createDataFrame([(9001, "12 34 !!", "en", "s", 8), (9002, None, "en", "s", 0)], documents.schema)
    out = stage(spark, "language", documents.unionByName(extra))
    assert out.schema == documents.schema
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in documents.collect()}


def test_near_duplicates_keep_one_of_each_group(spark, documents):
    expected = {i for i, _, _, kept in test_minhash.brute(pairs(documents)) if kept}
    out = stage(spark, "near_duplicates", documents)
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(expected)
    before = {r.doc_id: r for r in documents.collect()}
    assert all(before[r.doc_id] == r for r in rows)


def test_repeated_passages_are_cut(spark, documents):
    expected = test_suffixdedup.brute(pairs(documents))
    out = {r.doc_id: r for r in stage(spark, "repeated_passages", documents).collect()}
    assert len(out) == len(expected)
    exact = 0
    for doc_id, _, removed, _, sha in expected:
        r = out[doc_id]
        assert r.n_chars == len(r.text)
        exact += hashlib.sha256(r.text.encode()).hexdigest() == sha
    assert exact > 0.95 * len(expected)


def test_decontaminate_drops_the_leaks(spark, documents):
    bench = [test_decontam.fold(t).strip() for _, t in table("benchmark", FOLDER)]
    leaks = {i for i, t in pairs(documents) if any(b in test_decontam.fold(t) for b in bench)}
    out = {r.doc_id for r in stage(spark, "decontaminate", documents).collect()}
    assert leaks and not leaks & out
    assert len(out) + len(leaks) >= documents.count() - 1


def test_tokenize_is_lossless(spark, documents):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in stage(spark, "tokenize", documents).collect():
        assert model.decode(list(r.token_ids)) == r.text
        assert r.n_tokens == len(r.token_ids)


def test_run_applies_the_stages_in_order(spark, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "decontaminate", "tokenize"]
    docs = documents
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, FOLDER)
    want = sorted((r.doc_id, r.text, tuple(r.token_ids)) for r in docs.collect())
    got = sorted((r.doc_id, r.text, tuple(r.token_ids)) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert got == want and 0 < len(got) < documents.count()


def test_odd_and_empty_tables(spark, tmp_path):
    """Odd rows with columns named like results, then no rows at all, through every stage."""
    bench = spark.createDataFrame([(1, None), (None, "the same line")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd_docs(spark)), ("none", empty_docs(spark))):
        docs = docs.withColumns({"leaks": F.lit(1), "c0": F.lit("x"), "lang_pred": F.lit(2)})
        folder = write_tables(spark, str(tmp_path / name), docs, labels, bench)
        for step, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, docs, folder)
            assert out.columns == docs.columns, step
            out.count()
        rows = corpus_pipeline.run(spark, folder).collect()
        assert (len(rows) > 0) == (name == "odd")


def test_repeated_rows_leave_one(spark):
    rows = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, ""), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(pairs(stage(spark, "near_duplicates", df))) == [rows[0], rows[2], rows[3]]
    assert np.all([r.text is not None for r in df.collect()])
