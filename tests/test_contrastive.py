import numpy as np
import pytest
from pyspark.sql import functions as F

from featloom.operators import contrastive


def pairs(spark, sizes, dims=12, labels=3, seed=6):
    rng = np.random.default_rng(seed)
    rows, batches = [], {}
    n = 0
    for b, size in enumerate(sizes):
        x, y = rng.normal(size=(size, dims)), rng.normal(size=(size, dims))
        label = rng.integers(0, labels, size)
        batches[b] = (x, y, label)
        for i in range(size):
            rows.append((n, b, x[i].tolist(), y[i].tolist(), int(label[i])))
            n += 1
    schema = "id int, batch_id int, x array<double>, y array<double>, label int"
    return spark.createDataFrame(rows, schema).repartition(5, "id"), batches


def unit(v):
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def brute_nce(x, y, tau, mean=False):
    z = unit(np.vstack([x, y]))
    s = np.exp(z @ z.T / tau)
    n = len(x)
    losses = [-np.log(s[i, i + n] / (s[i].sum() - s[i, i])) for i in range(n)]
    return np.mean(losses) if mean else np.sum(losses)


def brute_sim_clr(x, y):
    s = unit(x) @ unit(y).T
    off = ~np.eye(len(x), dtype=bool)
    return np.trace(s) + np.maximum(1 - s, 0)[off].sum()


def brute_supervised(x, y, label, tau):
    s = np.exp(unit(x) @ unit(y).T / tau)
    total = 0.0
    for i in range(len(x)):
        mates = [j for j in range(len(x)) if j != i and label[j] == label[i]]
        strangers = sum(s[i, j] for j in range(len(x)) if label[j] != label[i])
        others = s[i].sum() - s[i, i]
        if mates:
            total -= np.mean([np.log(s[i, m] / strangers) for m in mates])
        else:
            total -= np.log(s[i, i] / others)
    return total


def losses(df):
    return {r.batch_id: r.loss for r in df.collect()}


SIZES = [17, 1, 40, 9]


@pytest.mark.parametrize("block", [1024, 16, 5])
def test_losses_match_numpy_whatever_the_block(spark, monkeypatch, block):
    monkeypatch.setattr(contrastive, "BLOCK_ROWS", block)
    df, batches = pairs(spark, SIZES)
    nce = losses(contrastive.nce(df))
    mean = losses(contrastive.loss(df, "NCE", tau=0.5, pooling="mean"))
    clr = losses(contrastive.sim_clr(df))
    cos = losses(contrastive.loss(df, "CS"))
    for b, (x, y, _) in batches.items():
        assert nce[b] == pytest.approx(brute_nce(x, y, 0.1), abs=1e-9)
        assert mean[b] == pytest.approx(brute_nce(x, y, 0.5, True), abs=1e-9)
        assert clr[b] == pytest.approx(brute_sim_clr(x, y), abs=1e-9)
        assert cos[b] == pytest.approx(1 - np.mean((unit(x) * unit(y)).sum(1)), abs=1e-12)
    assert nce[1] == pytest.approx(0.0, abs=1e-12)


@pytest.mark.parametrize("block", [1024, 7])
def test_supervised_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(contrastive, "BLOCK_ROWS", block)
    df, batches = pairs(spark, [25, 12], labels=4)
    got = losses(contrastive.supervised(df))
    for b, (x, y, label) in batches.items():
        assert got[b] == pytest.approx(brute_supervised(x, y, label, 0.1), abs=1e-9)


def test_supervised_without_mates_or_strangers(spark):
    df, batches = pairs(spark, [6], labels=1)
    assert losses(contrastive.supervised(df))[0] == float("-inf")
    alone = df.withColumn("label", df.id)
    x, y, _ = batches[0]
    want = brute_supervised(x, y, np.arange(6), 0.1)
    assert losses(contrastive.supervised(alone))[0] == pytest.approx(want, abs=1e-9)


def test_one_batch_with_most_rows_is_cut_into_small_groups(spark, monkeypatch):
    monkeypatch.setattr(contrastive, "BLOCK_ROWS", 32)
    df, batches = pairs(spark, [300, 20, 20])
    got = losses(contrastive.nce(df))
    for b, (x, y, _) in batches.items():
        assert got[b] == pytest.approx(brute_nce(x, y, 0.1), abs=1e-8)


def test_copies_of_a_pair_are_separate_rows(spark, monkeypatch):
    df, batches = pairs(spark, [4])
    x, y, _ = batches[0]
    twice = df.unionByName(df)
    for block in (1024, 3):
        monkeypatch.setattr(contrastive, "BLOCK_ROWS", block)
        want = brute_nce(np.vstack([x, x]), np.vstack([y, y]), 0.1)
        assert losses(contrastive.nce(twice))[0] == pytest.approx(want, abs=1e-9)


def test_small_tau_does_not_overflow(spark):
    df, _ = pairs(spark, [8])
    assert np.isfinite(losses(contrastive.nce(df, tau=0.002))[0])


def test_similarity_sums(spark):
    df, batches = pairs(spark, [5, 3])
    for r in contrastive.similarity_sums(df).collect():
        x, y, _ = batches[r.batch_id]
        s = unit(x) @ unit(y).T
        assert (r.pairs, r.positive, r.total) == (
            len(x), pytest.approx(np.trace(s)), pytest.approx(s.sum())
        )


def test_missing_vectors_do_not_count(spark):
    df, batches = pairs(spark, [6])
    x, y, _ = batches[0]
    holes = df.withColumns(
        {
            "x": F.when(F.col("id") != 2, F.col("x")),
            "y": F.when(F.col("id") != 4, F.col("y")),
        }
    )
    keep = [0, 1, 3, 5]
    want = brute_nce(x[keep], y[keep], 0.1)
    assert losses(contrastive.nce(holes))[0] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("side", ["x", "y"])
def test_ragged_vectors_are_an_error(spark, side):
    df, _ = pairs(spark, [4])
    ragged = df.withColumn(side, F.when(F.col("id") == 1, F.slice(side, 1, 3)).otherwise(F.col(side)))
    with pytest.raises(Exception, match="different widths"):
        contrastive.nce(ragged).collect()


@pytest.mark.parametrize("tau", [1e-3, 1e-4])
@pytest.mark.parametrize("block", [1024, 5])
def test_small_tau_does_not_underflow(spark, monkeypatch, tau, block):
    monkeypatch.setattr(contrastive, "BLOCK_ROWS", block)
    df, batches = pairs(spark, [12])
    x, y, _ = batches[0]
    z = unit(np.vstack([x, y]))
    s = z @ z.T / tau
    np.fill_diagonal(s, -np.inf)
    top = s.max(axis=1)
    total = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
    want = sum(total[i] - s[i, i + 12] for i in range(12))
    assert losses(contrastive.nce(df, tau=tau))[0] == pytest.approx(want, rel=1e-9)


def test_labels_may_be_text_and_null_is_nobodys_mate(spark):
    df, batches = pairs(spark, [14], labels=3)
    x, y, label = batches[0]
    text = df.withColumn("label", F.concat(F.lit("l"), F.col("label").cast("string")))
    want = brute_supervised(x, y, label, 0.1)
    assert losses(contrastive.supervised(text))[0] == pytest.approx(want, abs=1e-9)
    some = df.withColumn("label", F.when(F.col("label") > 0, F.col("label")))
    own = np.where(label > 0, label, 100 + np.arange(14))
    want = brute_supervised(x, y, own, 0.1)
    assert losses(contrastive.supervised(some))[0] == pytest.approx(want, abs=1e-9)


def test_no_job_before_the_action(spark):
    df, _ = pairs(spark, [9, 3])
    spark.sparkContext.setJobGroup("loss-plan", "planning only")
    contrastive.nce(df)
    contrastive.supervised(df)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("loss-plan")
    spark.sparkContext.setJobGroup("tests", "")
