import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from featloom.llm import tokencount as tc
from tests.llm.helpers import ODD, documents, empty_docs, odd_docs, run

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "b'", "s", "é", "<|endoftext|>", " ", "\n", "\t", "́", "漢", "12", "'ll", "\u0085", "<|", "Σ", ". ", ",\n", "word, ", "End. "]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def whole(tokenizer, text):
    return len(tokenizer.encode(text or "", add_special_tokens=False))


def test_query_matches_the_library(spark, tokenizer):
    rows = {r.doc_id: r for r in run(spark, "op5_token_counts").collect()}
    docs = documents()
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        n = whole(tokenizer, text)
        assert tuple(rows[doc_id])[1:] == (len(text.encode()), n, n > 2048)


@pytest.mark.parametrize("huge", [10, 10**9])
def test_random_texts(tokenizer, huge):
    rng = random.Random(1)
    counter = tc.Counter(PATH, chunk=20, overlap=3, huge=huge)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    assert counter.counts(texts) == [whole(tokenizer, t) for t in texts]


def test_long_texts_without_boundaries(tokenizer):
    counter = tc.Counter(PATH, chunk=300, overlap=16, huge=400)
    texts = ["a" * 5000, " " * 3000 + "x", "ab" * 400 + " " + "é́" * 3000, "<|endoftext|>" * 200, "x \n" * 900, "漢字" * 2000]
    assert counter.counts(texts) == [whole(tokenizer, t) for t in texts]


def test_memory_of_words_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(tc, "KNOWN_WORDS", 50)
    counter = tc.Counter(PATH)
    texts = [" ".join(f"word{k}" for k in range(i, i + 40)) for i in range(0, 400, 20)]
    for text in texts:
        assert counter.counts([text, texts[0]]) == [whole(tokenizer, text), whole(tokenizer, texts[0])]
        assert len(counter.known) <= 50 + 82


def test_odd_rows(spark, tokenizer):
    rows = tc.count_tokens(odd_docs(spark).drop("n_tokens"), PATH, ["doc_id", "text", "kept"], chunk=1000, huge=2000).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.n_tokens == whole(tokenizer, r.text)
        assert r.n_bytes == len((r.text or "").encode())
    assert tc.count_tokens(empty_docs(spark), PATH, ["doc_id"]).count() == 0
    with pytest.raises(ValueError, match="n_tokens"):
        tc.count_tokens(odd_docs(spark), PATH, ["n_tokens"])
