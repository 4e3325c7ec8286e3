import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from featloom.functions import text, vectors
from featloom.functions.stats import two_sided_p


def column(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_normalize_has_norm_one_and_keeps_zero(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.normal(size=40).tolist(),) for _ in range(50)] + [([0.0] * 40,), (None,)]
    out = column(spark, rows, "v array<double>").select(
        vectors.l2_norm(vectors.l2_normalize(F.col("v"))).alias("n")
    )
    norms = [r.n for r in out.collect()]
    assert all(abs(n - 1) < 1e-12 for n in norms[:50])
    assert norms[50:] == [0.0, None]


def test_cosine_bounds_and_zero(spark):
    rng = np.random.default_rng(2)
    rows = [(rng.normal(size=9).tolist(), rng.normal(size=9).tolist()) for _ in range(50)]
    rows.append(([0.0] * 9, rows[0][1]))
    df = column(spark, rows, "a array<double>, b array<double>")
    got = [r.c for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    want = [np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) for a, b in rows[:50]]
    assert np.allclose(got[:50], want, atol=1e-12)
    assert got[50] == 0.0
    assert max(map(abs, got)) <= 1


def test_append_replace_pad(spark):
    df = column(spark, [([1.0, 2.0, 3.0], [9.0, 8.0])], "v array<double>, h array<double>")
    v, h = F.col("v"), F.col("h")
    row = df.select(
        vectors.append(v, h), vectors.replace_head(v, h), vectors.replace_head(h, v),
        vectors.pad(v, 5), vectors.pad(v, 3),
    ).first()
    assert list(row) == [
        [1, 2, 3, 9, 8], [9, 8, 3], [1, 2, 3], [1, 2, 3, 0, 0], [1, 2, 3],
    ]


def test_width_contract_fails_the_query(spark):
    df = column(spark, [([1.0, 2.0],), ([1.0],)], "v array<double>")
    assert df.select(F.size(vectors.assert_width(F.col("v"), 2))).limit(1).count() == 1
    with pytest.raises(Exception, match="vector width is not 2: 1"):
        df.select(vectors.assert_width(F.col("v"), 2)).collect()


def test_dense_matches_numpy_and_keeps_nulls(spark):
    rng = np.random.default_rng(3)
    w, b = rng.normal(size=(7, 5)), rng.normal(size=7)
    p, c = rng.normal(size=(2, 7)), rng.normal(size=2)
    x = rng.normal(size=(20, 5))
    rows = [(i, x[i].tolist()) for i in range(20)] + [(20, None)]
    df = column(spark, rows, "id int, v array<float>").repartition(3)
    out = df.select(
        "id",
        vectors.dense(F.col("v"), w, b, "relu").alias("h"),
        vectors.dense_with_projection(F.col("v"), w, b, p, c, "tanh").alias("g"),
    ).orderBy("id").collect()
    x32 = x.astype("float32").astype("float64")
    h = np.tanh(x32 @ w.T + b)
    assert np.allclose([r.h for r in out[:20]], np.maximum(x32 @ w.T + b, 0), atol=1e-12)
    assert np.allclose([r.g for r in out[:20]], np.hstack([h, np.tanh(h @ p.T + c)]), atol=1e-12)
    assert out[20].h is None and out[20].g is None


def _p_by_integration(t, nu):
    """Tail of the t density by Simpson's rule over the angle."""
    lo, n = math.atan(abs(t) / math.sqrt(nu)), 20000
    h = (math.pi / 2 - lo) / n
    weights = [1 if i in (0, n) else 4 if i % 2 else 2 for i in range(n + 1)]
    tail = sum(w * math.cos(lo + i * h) ** (nu - 1) for i, w in enumerate(weights)) * h / 3
    scale = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi)
    return 2 * scale * tail


def test_p_value_branches(spark):
    cases = [(t, nu) for nu in (1, 2, 3, 4, 5, 10, 149, 1999, 2000, 2001, 5000)
             for t in (0.0, 0.3, -1.96, 2.5, 5.0, 12.0)]
    df = column(spark, cases, "t double, nu int")
    got = [r.p for r in df.select(two_sided_p(F.col("t"), F.col("nu")).alias("p")).collect()]
    want = [_p_by_integration(t, nu) for t, nu in cases]
    assert np.allclose(got, want, atol=1e-9)
    assert all(0 <= p <= 1 + 1e-12 for p in got)


def test_p_value_of_very_many_degrees(spark):
    df = column(spark, [(1.959963984540054, 2_000_000_000), (None, 5), (1.0, 0)], "t double, nu int")
    got = [r.p for r in df.select(two_sided_p(F.col("t"), F.col("nu")).alias("p")).collect()]
    assert abs(got[0] - 0.05) < 1e-9
    assert got[1:] == [None, None]


def test_path_parts(spark):
    names = ["/a/b/x.wav", "x.tar.gz", ".hidden", "plain", "/d/Y.M4A", "a.b/c"]
    df = column(spark, [(n,) for n in names], "p string")
    p = F.col("p")
    got = df.select(text.base_name(p), text.stem(p), text.suffix(p)).collect()
    assert [tuple(r) for r in got] == [
        ("x.wav", "x", ".wav"), ("x.tar.gz", "x.tar", ".gz"), (".hidden", ".hidden", ""),
        ("plain", "plain", ""), ("Y.M4A", "Y", ".m4a"), ("c", "c", ""),
    ]


def test_model_names(spark):
    rows = [
        ("sentence-transformers/all-MiniLM-L12-v2", "text", "all-MiniLM-L12-v2"),
        ("hf-audio/wav2vec2-bert-CV16-en", "wav2vec2-bert", "wav2vec2-bert-CV16-en"),
        ("facebook/wav2vec2-base", "wav2vec2", "wav2vec2-base"),
        ("facebook/hubert-large", "hubert", "hubert-large"),
        ("runs/7", "speech", "runs/7"),
    ]
    df = column(spark, rows, "m string, family string, folder string")
    m = F.col("m")
    for r in df.select("family", "folder", text.encoder_family(m).alias("f"),
                       text.strip_prefix(m).alias("s")).collect():
        assert (r.f, r.s) == (r.family, r.folder)


def test_feature_names_and_ascii(spark):
    df = column(spark, [(7, "naïve – ok"), (12345, "plain")], "i int, s string")
    got = df.select(text.feature_name(F.col("i")), text.strip_non_ascii(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("f0007", "nave  ok"), ("f12345", "plain")]
