"""Training-run analytics."""

from featloom.operators import runlog
from featloom.workload.registry import longs, query, r6

EPOCHS = """
    SELECT run_id, epoch, phase, avg(loss) AS mean_loss, sum(loss) AS sum_loss,
           count(loss) AS batches
    FROM {runlog} GROUP BY run_id, epoch, phase"""


@query(
    "AGG-12",
    f"""SELECT run_id, epoch, phase, round(mean_loss, 6) + 0.0 AS mean_loss,
               round(sum_loss, 6) + 0.0 AS sum_loss, batches FROM ({EPOCHS})""",
)
def epoch_loss(v):
    losses = runlog.epoch_loss(v.runlog).withColumns(
        {"mean_loss": r6("mean_loss"), "sum_loss": r6("sum_loss")}
    )
    return longs(losses, "epoch")


@query(
    "WIN-1",
    f"""SELECT run_id, epoch AS best_epoch, round(mean_loss, 6) + 0.0 AS best_loss
        FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY mean_loss, epoch) AS n
              FROM ({EPOCHS}) WHERE phase = 'val') WHERE n = 1""",
)
def best_epoch(v):
    best = runlog.best_epoch(runlog.epoch_loss(v.runlog))
    return longs(best.withColumn("best_loss", r6("best_loss")), "best_epoch")


@query(
    "WIN-2",
    f"""SELECT run_id, epoch, round(mean_loss, 6) + 0.0 AS mean_loss,
               round(least(mean_loss, coalesce(before, mean_loss)), 6) + 0.0 AS best_so_far,
               before IS NULL OR mean_loss < before AS improved,
               coalesce(mean_loss < before, false) AS saved
        FROM (SELECT *, min(mean_loss) OVER (PARTITION BY run_id ORDER BY epoch
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
              FROM ({EPOCHS}) WHERE phase = 'val')""",
)
def improvements(v):
    # Epochs are the days of one month: every run is short.
    rows = runlog.improvements(runlog.epoch_loss(v.runlog), block=None).withColumns(
        {"mean_loss": r6("mean_loss"), "best_so_far": r6("best_so_far")}
    )
    return longs(rows, "epoch")


@query(
    "WIN-3",
    f"""WITH RECURSIVE steps AS (
            SELECT run_id, epoch, sum_loss,
                   row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS n
            FROM ({EPOCHS}) WHERE phase = 'val'),
        walk AS (
            SELECT run_id, epoch, n, sum_loss AS best, 0 AS bad, 1e-5::double AS lr
            FROM steps WHERE n = 1
            UNION ALL
            SELECT run_id, epoch, n, best,
                   CASE WHEN bad > 2 THEN 0 ELSE bad END,
                   CASE WHEN bad > 2 THEN lr * 0.1::double ELSE lr END
            FROM (SELECT s.run_id, s.epoch, s.n,
                         CASE WHEN s.sum_loss < w.best * (1 - 1e-4::double) THEN s.sum_loss
                              ELSE w.best END AS best,
                         CASE WHEN s.sum_loss < w.best * (1 - 1e-4::double) THEN 0
                              ELSE w.bad + 1 END AS bad,
                         w.lr
                  FROM walk w JOIN steps s ON s.run_id = w.run_id AND s.n = w.n + 1))
        SELECT run_id, epoch, round(lr * 1e9, 6) + 0.0 AS lr_nano, bad AS bad_epochs FROM walk""",
)
def plateau_lr(v):
    rates = runlog.plateau_lr(runlog.epoch_loss(v.runlog), lr=1e-5, patience=2, block=None)
    return rates.select("run_id", "epoch", r6(rates.lr * 1e9).alias("lr_nano"), "bad_epochs")


# Blocks of the long runs below, so that the small tables have several.
LONG_BLOCK = 1 << 10
LONG_EPOCHS = EPOCHS.replace("{runlog}", "{long_log}")


@query(
    "WIN-2",
    f"""SELECT run_id, epoch, round(mean_loss, 6) + 0.0 AS mean_loss,
               round(least(mean_loss, coalesce(before, mean_loss)), 6) + 0.0 AS best_so_far,
               before IS NULL OR mean_loss < before AS improved,
               coalesce(mean_loss < before, false) AS saved
        FROM (SELECT *, min(mean_loss) OVER (PARTITION BY run_id ORDER BY epoch
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
              FROM ({LONG_EPOCHS}))""",
)
def long_run_best(v):
    rows = runlog.improvements(runlog.epoch_loss(v.long_log), block=LONG_BLOCK).withColumns(
        {"mean_loss": r6("mean_loss"), "best_so_far": r6("best_so_far")}
    )
    return longs(rows, "run_id", "epoch")


@query(
    "WIN-3",
    f"""WITH RECURSIVE steps AS (
            SELECT run_id, epoch, sum_loss, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS n
            FROM ({LONG_EPOCHS})),
        gains AS (
            SELECT run_id, n, sum_loss AS best FROM steps WHERE n = 1
            UNION ALL
            SELECT s.run_id, s.n, s.sum_loss
            FROM (SELECT g.run_id, min(s.n) AS n FROM gains g JOIN steps s
                  ON s.run_id = g.run_id AND s.n > g.n AND s.sum_loss < g.best * (1 - 1e-4::double)
                  GROUP BY g.run_id) f
            JOIN steps s ON s.run_id = f.run_id AND s.n = f.n),
        stretches AS (
            SELECT run_id, n, coalesce(sum(cuts) OVER (PARTITION BY run_id ORDER BY n
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cuts
            FROM (SELECT run_id, n, (lead(n) OVER (PARTITION BY run_id ORDER BY n) - n - 1) // 11 AS cuts FROM gains))
        SELECT s.run_id, s.epoch, round(1e-5::double * pow(0.999::double, g.cuts + (s.n - g.n) // 11) * 1e9, 6) + 0.0 AS lr_nano,
               (s.n - g.n) % 11 AS bad_epochs
        FROM steps s ASOF JOIN stretches g ON s.run_id = g.run_id AND s.n >= g.n""",
)
def long_run_rates(v):
    rates = runlog.plateau_lr(runlog.epoch_loss(v.long_log), 1e-5, factor=0.999, patience=10, block=LONG_BLOCK)
    return longs(rates.select("run_id", "epoch", r6(rates.lr * 1e9).alias("lr_nano"), "bad_epochs"), "run_id")
