import hashlib
import random

import numpy as np
import pytest

from featloom.llm import suffixdedup as sd
from tests.llm.helpers import ODD, documents, empty_docs, odd_docs, run

LAST = (1 << 63) - 1


def brute(docs):
    """(n_bytes, n_removed, n_spans, sha) of each document, from a dict of all strings."""
    raw = [(LAST if i is None else i, (t or "").encode()) for i, t in docs]
    least: dict[bytes, int] = {}
    for i, b in raw:
        for k in range(len(b) - sd.LENGTH + 1):
            s = b[k : k + sd.LENGTH]
            if least.get(s, LAST + 1) > i:
                least[s] = i
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - sd.LENGTH + 1):
            if least[b[k : k + sd.LENGTH]] < i:
                gone[k : k + sd.LENGTH] = True
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows(df):
    return sorted(
        (LAST if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
        for r in df.collect()
    )


def test_query_matches_brute_force(spark):
    expected = brute(documents())
    assert sum(r[2] for r in expected) > 5000
    assert rows(run(spark, "op4_suffix_dedup")) == expected


@pytest.mark.parametrize("small", [False, True])
def test_repetitive_texts(spark, monkeypatch, small):
    """Periodic texts, overlaps, tiny alphabets, repeated ids; also with very small arrays."""
    rng = random.Random(9)
    base = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 300))) for _ in range(12)]
    docs = [(i, "".join(rng.choice(base)[rng.randint(0, 40) :] for _ in range(3))) for i in range(60)]
    docs += [(100, "a" * 400), (101, "a" * 49), (102, "a" * 50), (102, "a" * 50), (3, "é" * 200), (103, "xé" + "é" * 90)]
    docs += [(None, docs[0][1]), (None, "z" * 90), (None, "z" * 90), (104, "z" * 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    if small:
        tables = [
            (np.frombuffer(t.encode(), np.uint8), i if i is not None else LAST) for i, t in docs if len(t.encode()) >= 50
        ]
        monkeypatch.setattr(sd, "ARRAY_BYTES", 700)
        text = np.concatenate([t for t, _ in tables])
        sizes = np.array([len(t) for t, _ in tables])
        ids = np.array([i for _, i in tables])
        found = sd.least_ids(text, sizes, ids, np.arange(len(tables)) % 3)
        least: dict[bytes, int] = {}
        windows = [(t[k : k + 50].tobytes(), i) for t, i in tables for k in range(len(t) - 49)]
        for s, i in windows:
            least[s] = min(least.get(s, LAST), i)
        assert found.tolist() == [least[s] for s, _ in windows]
    else:
        assert rows(sd.repeated_bytes(df)) == brute(docs)


def test_odd_rows(spark):
    assert rows(sd.repeated_bytes(odd_docs(spark))) == brute(ODD)
    assert sd.repeated_bytes(empty_docs(spark)).count() == 0


def test_filter_keeps_rows_and_columns(spark):
    docs = [(1, "α" * 40 + "β" * 40, "a"), (2, "γ" + "α" * 39 + "tail", "b"), (3, None, "c"), (2, "short", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, bucket string")
    out = {(r.doc_id, r.bucket): r.text for r in sd.without_repeats(df).collect()}
    assert out == {(1, "a"): docs[0][1], (2, "b"): "γtail", (3, "c"): None, (2, None): "short"}
    assert sd.without_repeats(df).schema == df.schema


def test_suffix_order_and_prefixes():
    rng = random.Random(3)
    for _ in range(200):
        letters = rng.choice([b"a", b"ab", b"abc", b"\x00a", b"\x00"])
        b = bytes(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        text = np.frombuffer(b, np.uint8)
        order = sorted(range(len(b)), key=lambda i: b[i:])
        sa = sd.suffix_array(text)
        assert sa.tolist() == order
        common = sd.common_prefixes(text, sa)
        for k in range(1, len(b)):
            x, y = b[order[k - 1] :], b[order[k] :]
            m = next((j for j, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            assert common[k] == m
