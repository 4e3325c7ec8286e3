import random
import re

import __spark_entry__ as entry
import numpy as np
import pytest

from featloom.llm import minhash as mh
from featloom.llm.components import components
from featloom.llm.shingles import shingle_rows, words
from tests.llm.helpers import ODD, documents, empty_docs, odd_docs, run
from tests.oracle import DATA, connect, duck_rows, spark_rows

LAST = (1 << 63) - 1


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return frozenset()
    if len(w) < 5:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    ids = [LAST if i is None else i for i, _ in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    posting: dict = {}
    for k, s in enumerate(sets):
        for g in s:
            posting.setdefault(g, []).append(k)
    for k, s in enumerate(sets):
        common: dict[int, int] = {}
        for g in s:
            for m in posting[g]:
                if m > k:
                    common[m] = common.get(m, 0) + 1
        for m, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[m]) - n):
                root[find(m)] = find(k)
    least: dict[int, int] = {}
    for k in range(len(docs)):
        r = find(k)
        least[r] = min(least.get(r, LAST), ids[k])
    return sorted((ids[k], len(s), least[find(k)], ids[k] == least[find(k)]) for k, s in enumerate(sets))


def rows(df):
    big = lambda x: LAST if x is None else x
    return sorted((big(r.doc_id), r.n_shingles, big(r.component_id), r.kept) for r in df.collect())


def test_query_matches_brute_force(spark):
    folder = f"{DATA}/sf0.01"
    expected = brute(documents(folder))
    assert sum(not r[3] for r in expected) > 20
    assert rows(run(spark, "op9_minhash", folder)) == expected


def test_query_matches_sql(spark):
    folder = f"{DATA}/sf0.001"
    sql = entry.oracle_sql()["op9_minhash"]
    assert spark_rows(run(spark, "op9_minhash", folder)) == duck_rows(connect(folder), sql)


@pytest.mark.parametrize("tile", [2048, 7])
def test_families_of_near_copies(spark, monkeypatch, tile):
    """A family whose members are at all distances, chains, repeats and tiny texts; also cut in tiles."""
    monkeypatch.setattr(mh, "TILE", tile)
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    docs = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9999)}"
        docs.append((1000 - i, " ".join(w)))
    chain = [f"c{k}" for k in range(400)]
    docs += [(5000 + i, " ".join(chain[12 * i : 12 * i + 100])) for i in range(20)]
    docs += [(7, "One TWO three"), (9, "one\ttwo\nthree "), (8, "one two"), (6, ""), (5, None), (6, " "), (None, docs[0][1].upper())]
    docs += [(7, "another text under the same id as one above"), (3, docs[-1][1] or "x"), (None, "lonely words")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(mh.near_duplicates(df)) == brute(docs)


def test_odd_rows(spark):
    assert rows(mh.near_duplicates(odd_docs(spark))) == brute(ODD)
    assert mh.near_duplicates(empty_docs(spark)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((mh.signature(a) == mh.signature(b)).mean() - true) < 0.12
    direct = np.array([min(mh._circle()[:, k][int(p)] for p in mh.mix(a ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(mh.CIRCLE)) for k in (0, 7, 249)])
    assert direct.tolist() == mh.signature(a)[[0, 7, 249]].tolist()


def test_shingles_do_not_depend_on_place_or_spacing():
    texts = [b"A b  c\td e f", b"x y z", b"\n a B C d\x0be F ", b"", b"a b c d e f"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = shingle_rows(*words(np.frombuffer(b"".join(texts), np.uint8), offsets))
    assert found[0].tolist() == found[2].tolist() == found[4].tolist()
    assert [len(s) for s in found] == [2, 1, 2, 0, 2]


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    pairs += [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(1900, 1990)]
    pairs = [(a, b) for a, b in pairs if a != b]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    found = components(spark.createDataFrame(pairs, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == sorted((v, find(v)) for v in root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
