import numpy as np
import pytest

from featloom.operators import runlog

SCHEMA = "run_id string, epoch int, phase string, step int, loss double"


def log(spark, runs, steps=3):
    """One row per step; the steps of an epoch average to its loss."""
    rows = []
    for run, losses in runs.items():
        for epoch, loss in enumerate(losses):
            for s in range(steps):
                rows.append((run, epoch, "val", s, loss + (s - 1) * 0.25))
                rows.append((run, epoch, "train", s, 9.0))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_epoch_loss_divides_by_batches(spark):
    rows = runlog.epoch_loss(log(spark, {"r": [2.0, 1.0]})).where("phase = 'val'").collect()
    assert sorted((r.epoch, r.mean_loss, r.sum_loss, r.batches) for r in rows) == [
        (0, 2.0, 6.0, 3), (1, 1.0, 3.0, 3)
    ]


def test_best_epoch_is_the_first_of_a_tie(spark):
    epochs = runlog.epoch_loss(log(spark, {"r": [3.0, 1.0, 2.0, 1.0], "s": [1.0]}))
    got = {r.run_id: (r.best_epoch, r.best_loss) for r in runlog.best_epoch(epochs).collect()}
    assert got == {"r": (1, 1.0), "s": (0, 1.0)}


def test_improvements(spark):
    epochs = runlog.epoch_loss(log(spark, {"r": [3.0, 3.0, 2.0, 5.0, 1.0]}))
    rows = sorted(runlog.improvements(epochs).collect(), key=lambda r: r.epoch)
    assert [r.best_so_far for r in rows] == [3.0, 3.0, 2.0, 2.0, 1.0]
    assert [r.improved for r in rows] == [True, False, True, False, True]
    assert [r.saved for r in rows] == [False, False, True, False, True]


def replay(losses, lr, factor, patience, threshold):
    best, bad, out = float("inf"), 0, []
    for loss in losses:
        if loss < best * (1 - threshold):
            best, bad = loss, 0
        else:
            bad += 1
        if bad > patience:
            lr, bad = lr * factor, 0
        out.append((lr, bad))
    return out


def test_plateau_by_hand(spark):
    epochs = runlog.epoch_loss(log(spark, {"r": [4.0, 4.0, 4.0, 4.0, 3.0]}))
    rows = sorted(runlog.plateau_lr(epochs, 1.0, patience=2).collect(), key=lambda r: r.epoch)
    assert [r.lr for r in rows] == [1.0, 1.0, 1.0, pytest.approx(0.1), pytest.approx(0.1)]
    assert [r.bad_epochs for r in rows] == [0, 1, 2, 0, 0]


def test_gain_below_the_threshold_is_no_gain(spark):
    epochs = runlog.epoch_loss(log(spark, {"r": [4.0, 3.9999, 3.9998]}))
    rows = sorted(runlog.plateau_lr(epochs, 1.0, patience=0).collect(), key=lambda r: r.epoch)
    assert [r.lr for r in rows] == [1.0, pytest.approx(0.1), pytest.approx(0.01)]


def test_plateau_of_many_runs_over_small_batches(spark):
    rng = np.random.default_rng(7)
    runs = {f"r{i}": rng.random(int(rng.integers(1, 40))).round(3).tolist() for i in range(30)}
    epochs = runlog.epoch_loss(log(spark, runs, steps=1))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = runlog.plateau_lr(epochs, 0.5, 0.3, 2, 1e-3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for run, losses in runs.items():
        got = sorted((r.epoch, r.lr, r.bad_epochs) for r in rows if r.run_id == run)
        want = replay([x - 0.25 for x in losses], 0.5, 0.3, 2, 1e-3)
        assert [(lr, bad) for _, lr, bad in got] == [(pytest.approx(a), b) for a, b in want]


def epochs_of(spark, rows):
    return spark.createDataFrame(
        [(run, epoch, "val", loss, loss) for run, epoch, loss in rows],
        "run_id string, epoch int, phase string, mean_loss double, sum_loss double",
    )


def long_runs(seed):
    """A run with a third of all rows and others around it: noise, creeping gains, ties, negative losses, gaps."""
    rng = np.random.default_rng(seed)
    runs = {
        "hot": (3 + rng.random(600) - np.linspace(0, 2, 600)).round(2),
        None: rng.random(70).round(1),
        "creeps": 2 - np.arange(150) * 1e-4,
        "falls": 0.9 ** np.arange(120),
        "ties": np.full(90, 1.5),
        "negative": rng.normal(size=200).round(2),
        "one": np.array([1.0]),
        "short": rng.random(9),
        "huge": np.append(rng.random(40) * 1e300, [np.inf, 0.0, np.nan, 0.0, -1.0]),
    }
    rows = []
    for name, losses in runs.items():
        step = 3 if name == "short" else 1
        rows += [(name, i * step - (20 if name == "falls" else 0), float(x)) for i, x in enumerate(losses)]
    return runs, rows


@pytest.mark.parametrize("block, patience, threshold", [(16, 2, 1e-4), (7, 0, 1e-2), (50, 3, 0.0), (1, 1, 0.3)])
def test_long_runs_in_blocks_equal_the_replay_in_order(spark, block, patience, threshold):
    runs, rows = long_runs(block)
    epochs = epochs_of(spark, rows).repartition(5)
    found = runlog.plateau_lr(epochs, 0.5, 0.5, patience, threshold, block=block).collect()
    assert len(found) == len(rows)
    for run, losses in runs.items():
        got = [(r.lr, r.bad_epochs) for r in sorted((r for r in found if r.run_id == run), key=lambda r: r.epoch)]
        assert got == replay(losses.tolist(), 0.5, 0.5, patience, threshold), run


@pytest.mark.parametrize("block", [1, 16, 50])
def test_running_best_in_blocks(spark, block):
    runs, rows = long_runs(3)
    rows = [r for r in rows if r[0] != "huge"]
    found = runlog.improvements(epochs_of(spark, rows).repartition(5), block=block).collect()
    whole = runlog.improvements(epochs_of(spark, rows)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, whole))
    for run, losses in runs.items():
        if run == "huge":
            continue
        got = sorted((r for r in found if r.run_id == run), key=lambda r: r.epoch)
        assert [r.best_so_far for r in got] == np.minimum.accumulate(losses).tolist()
        before = np.append(np.inf, np.minimum.accumulate(losses)[:-1])
        assert [r.improved for r in got] == (losses < before).tolist()


def test_a_long_run_is_many_tasks(spark):
    """Blocks of one run are dealt out, and no window or sort is by run alone but that of one row a block."""
    rows = spark.range(40_000).selectExpr(
        "'r' AS run_id", "id AS epoch", "'val' AS phase", "1.0 + pmod(id * 7919, 1000) / 1000 AS mean_loss",
        "1.0 + pmod(id * 7919, 1000) / 1000 AS sum_loss",
    )
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for made in (runlog.improvements(rows, block=1000), runlog.plateau_lr(rows, 1.0, block=1000)):
            per_task = made.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
            assert sum(per_task) == 40_000 and max(per_task) < 20_000
            assert sum(n > 0 for n in per_task) >= 5
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)


def test_rows_without_a_run_or_an_epoch(spark):
    rows = [(None, 0, 1.0), (None, 1, 2.0), ("r", None, 3.0), ("r", 0, 2.0), ("r", 40, 1.0)]
    epochs = epochs_of(spark, rows)
    got = {(r.run_id, r.epoch): (r.best_so_far, r.improved) for r in runlog.improvements(epochs, block=8).collect()}
    assert got == {(None, 0): (1.0, True), (None, 1): (1.0, False), ("r", None): (3.0, True), ("r", 0): (2.0, True), ("r", 40): (1.0, True)}
    rates = runlog.plateau_lr(epochs, 1.0, patience=0, block=8).collect()
    assert sorted((str(r.run_id), r.epoch or -1, r.bad_epochs) for r in rates) == [
        ("None", -1, 0), ("None", 1, 0), ("r", -1, 0), ("r", -1, 0), ("r", 40, 0)
    ]
    assert runlog.plateau_lr(epochs.limit(0), 1.0).count() == 0 and runlog.improvements(epochs.limit(0)).count() == 0
