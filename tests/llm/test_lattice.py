import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from featloom.llm import lattice as lt
from featloom.llm.common import flat
from tests.llm.helpers import ODD, documents, empty_docs, odd_docs, run

PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(v, model, text):
    """Every segmentation of a text with its weight, by recursion over characters."""
    marked = "▁" + text.replace(" ", "▁")
    piece_of = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not model.is_byte(i) and not model.is_control(i) and not model.is_unknown(i)}

    def go(at):
        if at == len(marked):
            return [((), 0.0)]
        out = []
        for end in range(at + 1, min(len(marked), at + v.longest) + 1):
            piece = piece_of.get(marked[at:end])
            if piece is not None:
                out += [((piece, *ids), v.log_weight[piece] + w) for ids, w in go(end)]
        if marked[at] not in piece_of:
            spelled = tuple(int(v.byte_ids[b]) for b in marked[at].encode())
            out += [((*spelled, *ids), w) for ids, w in go(at + 1)]
        return out

    found = go(0)
    total = math.fsum(math.exp(w) for _, w in found)
    return {ids: math.exp(w) / total for ids, w in found}


@pytest.mark.parametrize("text", ["tokens in", "a\nthe  them", "naïve☃x"])
def test_draws_follow_the_lattice(text):
    v, model = lt.Vocabulary(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    expected = segmentations(v, model, text)
    n = 40_000
    seeds = lt.mix(np.arange(n, dtype=np.uint64) + np.uint64(1 << 40))
    ids, ends = lt.sample(v, *flat(pa.array([text] * n)), seeds)
    drawn = Counter(tuple(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True))
    assert set(drawn) <= set(expected)
    for found, share in expected.items():
        assert abs(drawn[found] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-9


def test_round_trip_of_odd_texts():
    rng = random.Random(6)
    letters = ["a", "the", " ", "  ", "▁", "\n", "\t", "é", "漢", "😀", "\x00", "ing", " ", "​"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [t or "" for _, t in ODD]
    v, model = lt.Vocabulary(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    data, offsets = flat(pa.array(texts))
    ids, ends = lt.sample(v, data, offsets, lt.mix(np.arange(len(texts), dtype=np.uint64)))
    back, back_ends = lt.decode(v, ids, ends)
    assert np.array_equal(back, data) and np.array_equal(back_ends, offsets)
    for text, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        if "▁" not in text and "\x00" not in text:
            assert model.decode(ids[a:b].tolist()) == text


def test_segmentations_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(documents()[:80], "doc_id long, text string")
    made = [
        {r.doc_id: r.token_ids for r in lt.encode(d, PATH, ["doc_id"]).collect()}
        for d in (df.repartition(5), df.coalesce(1), df.orderBy("text"))
    ]
    assert made[0] == made[1] == made[2]
    other = {r.doc_id: r.token_ids for r in lt.encode(df, PATH, ["doc_id"], seed=2).collect()}
    assert other != made[0]


def test_query_is_lossless(spark):
    rows = {r.doc_id: r for r in run(spark, "op1_sentencepiece").collect()}
    docs = documents()
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        assert rows[doc_id].lossless
        assert rows[doc_id].n_bytes == len(text.encode())
        assert 0 < rows[doc_id].n_pieces <= rows[doc_id].n_bytes + 1


def test_operators_agree(spark):
    docs = odd_docs(spark)
    encoded = lt.encode(docs, PATH, ["doc_id", "text", "score"])
    back = lt.decoded(encoded, PATH, ["doc_id", "text"]).collect()
    assert len(back) == len(ODD)
    assert all(r.decoded == (r.text or "") for r in back)
    sizes = sorted((r.doc_id or -1, len(r.token_ids)) for r in encoded.collect())
    trips = lt.round_trip(docs, PATH, ["doc_id"]).collect()
    assert sizes == sorted((r.doc_id or -1, r.n_pieces) for r in trips)
    assert all(r.lossless for r in trips)
    assert lt.encode(empty_docs(spark), PATH, ["doc_id"]).count() == 0
    assert lt.round_trip(empty_docs(spark), PATH, ["doc_id"]).count() == 0
