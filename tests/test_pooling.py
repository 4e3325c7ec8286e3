import numpy as np
import pytest
from pyspark.sql import functions as F

from featloom.operators import pooling

MASKS = [
    [1, 1, 1, 0, 0], [1, 1, 1, 1, 1], [0, 0, 0, 0, 0], [0, 0, 1, 1, 1],
    [1, 0, 1, 0, 1], [0, 1, 0, 0, 0], [1, 0, 0, 0, 0],
]


def tokens(spark, masks=MASKS, dims=40):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(len(masks), len(masks[0]), dims))
    rows = [
        (s, p, m, x[s, p].tolist()) for s, mask in enumerate(masks) for p, m in enumerate(mask)
    ]
    df = spark.createDataFrame(rows, "seq_id int, pos int, mask int, vec array<double>")
    return df.repartition(4, "pos"), x


def pooled(df):
    return {r.seq_id: r.vec for r in df.collect()}


def test_mean_pool(spark):
    df, x = tokens(spark)
    got = pooled(pooling.mean_pool(df))
    for s, mask in enumerate(MASKS):
        m = np.array(mask)[:, None]
        assert np.allclose(got[s], (x[s] * m).sum(0) / max(m.sum(), 1e-9), atol=1e-12)
    assert got[2] == [0.0] * 40


def test_plain_mean(spark):
    df, x = tokens(spark)
    got = pooled(pooling.pool(df, "mean", mask=None))
    assert np.allclose([got[s] for s in range(len(MASKS))], x.mean(axis=1), atol=1e-12)


def literal_last(mask):
    run = np.cumsum(mask) - 1
    return run[max(sum(mask) - 1, 0)]


def test_last_pool_follows_the_formula_for_any_mask(spark):
    df, x = tokens(spark)
    got = pooled(pooling.pool(df, "last"))
    assert literal_last(MASKS[3]) == 0 and literal_last(MASKS[2]) == -1
    for s, mask in enumerate(MASKS):
        assert got[s] == x[s, literal_last(mask)].tolist()


def test_last_pool_wraps_for_a_left_padded_mask(spark):
    df, x = tokens(spark, [[0, 0, 1, 1]])
    assert pooled(pooling.last_pool(df))[0] == x[0, -1].tolist()


def test_right_padded_shortcut(spark):
    masks = [[1] * k + [0] * (5 - k) for k in range(6)]
    df, x = tokens(spark, masks)
    assert pooled(pooling.last_pool(df, right_padded=True)) == pooled(pooling.last_pool(df))


@pytest.mark.parametrize("block", [2, 3, 1 << 16])
def test_running_total_across_blocks(spark, block):
    df, _ = tokens(spark)
    rows = pooling.running_total(
        df.select("seq_id", "pos", "mask"), ["seq_id"], "pos", "mask", "run", block
    ).collect()
    assert len(rows) == 5 * len(MASKS)
    for r in rows:
        assert r.run == sum(MASKS[r.seq_id][: r.pos + 1])


def test_float_vectors_pool_in_double(spark):
    df, x = tokens(spark)
    floats = df.withColumn("vec", F.col("vec").cast("array<float>"))
    got = pooled(pooling.mean_pool(floats, mask=None))
    assert np.allclose(got[0], x[0].astype("float32").astype("float64").mean(0), atol=1e-12)


@pytest.mark.parametrize("widths", [(2, 3), (32, 64), (40, 33)])
def test_mean_of_two_widths_is_an_error(spark, widths):
    rows = [("ok", 0, 1, [1.0] * 5), ("ok", 1, 1, None)] + [("s", i, 1, [1.0] * w) for i, w in enumerate(widths)]
    df = spark.createDataFrame(rows, "seq_id string, pos int, mask int, vec array<float>")
    assert pooling.mean_pool(df.where("seq_id = 'ok'")).first().vec == [1.0] * 5
    with pytest.raises(Exception, match="several widths in sequence s"):
        pooling.mean_pool(df).collect()
