import numpy as np
import pytest
from pyspark.sql import functions as F

from featloom.operators import series


def frame(spark, values, key=0):
    rows = [(key, i, float(v)) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "series_id int, idx int, value double").repartition(3)


def run(df, *args, **options):
    rows = sorted(series.resample(df, *args, **options).collect())
    assert [r.idx for r in rows] == list(range(len(rows)))
    return np.array([r.value for r in rows])


def brute(x, orig, new):
    """The formula sample by sample."""
    ratio, cutoff = orig / new, 0.99 * min(1.0, new / orig)
    out = np.zeros(int(np.ceil(len(x) * new / orig)))
    for j in range(len(out)):
        u = cutoff * (j * ratio - np.arange(len(x)))
        k = cutoff * np.sinc(u) * np.cos(np.pi * u / 12) ** 2 * (np.abs(u) <= 6)
        out[j] = (k * x).sum()
    return out


@pytest.mark.parametrize("orig,new", [(24, 8), (8, 24), (44100, 16000), (8000, 16000), (3, 2)])
@pytest.mark.parametrize("block", [1 << 14, 16, 7])
def test_matches_the_formula_whatever_the_block(spark, orig, new, block):
    x = np.random.default_rng(8).normal(size=151)
    assert np.allclose(run(frame(spark, x), orig, new, block=block), brute(x, orig, new), atol=1e-12)


@pytest.mark.parametrize("cells", [1 << 22, 0])
def test_table_of_phases_and_far_outputs(spark, monkeypatch, cells):
    """Rates whose phases are fewer or more than the outputs."""
    monkeypatch.setattr(series, "TABLE_CELLS", cells)
    x = np.random.default_rng(3).normal(size=60)
    for orig, new in ((160, 441), (1001, 1000), (7, 5)):
        assert np.allclose(run(frame(spark, x), orig, new, block=16), brute(x, orig, new), atol=1e-12)


def test_constant_and_sine_are_preserved(spark):
    n = np.arange(600)
    for orig, new in ((24, 8), (8, 24)):
        flat = run(frame(spark, np.ones(600)), orig, new)
        edge = len(flat) // 6
        assert np.abs(flat[edge:-edge] - 1).max() < 2e-3
        wave = run(frame(spark, np.sin(2 * np.pi * n / 100)), orig, new)
        want = np.sin(2 * np.pi * np.arange(len(wave)) * orig / new / 100)
        assert np.abs(wave - want)[edge:-edge].max() < 2e-3


def test_gaps_are_zero_samples(spark):
    x = [1.0] * 20 + [None] * 300 + [2.0] * 20
    zeros = np.array([0.0 if v is None else v for v in x])
    got = run(frame(spark, x), 3, 2, block=16)
    assert np.allclose(got, brute(zeros, 3, 2), atol=1e-12)
    assert (got[60:160] == 0).all()


def test_equal_rates_pass_through(spark):
    df = frame(spark, [1.0, 2.0, 3.0])
    assert sorted(series.resample(df, 8, 8).collect()) == sorted(df.collect())


def test_series_are_independent_and_text_keys_work(spark):
    rng = np.random.default_rng(9)
    xs = {k: rng.normal(size=n) for k, n in (("a", 90), ("b", 31), ("c", 1))}
    rows = [(k, i, float(v)) for k, x in xs.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id string, idx long, value double")
    out = series.resample(df, 24, 8, block=8).collect()
    for k, x in xs.items():
        got = [r.value for r in sorted(out, key=lambda r: r.idx) if r.series_id == k]
        assert np.allclose(got, brute(x, 24, 8), atol=1e-12)


def test_downmix(spark):
    df = spark.createDataFrame(
        [(0, 0, 0, 1.0), (0, 1, 0, 3.0), (0, 0, 1, 5.0)],
        "series_id int, channel int, idx int, value double",
    )
    assert sorted(map(tuple, series.downmix(df).collect())) == [(0, 0, 2.0), (0, 1, 5.0)]


def test_long_series_is_spread_over_groups(spark):
    df = spark.range(40_000).select(
        F.lit(0).alias("series_id"), F.col("id").alias("idx"), F.lit(1.0).alias("value")
    )
    out = series.resample(df, 2, 1, block=1000)
    assert out.count() == 20_000
    assert out.where("idx between 100 and 19900 and abs(value - 1) > 0.002").count() == 0
