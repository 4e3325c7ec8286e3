"""Training-run analytics over a table of step losses.

A run may be as long as the table: nothing here orders a whole run in one task. Its epochs are cut
into blocks of ``BLOCK`` epoch numbers; rows are put in order inside blocks, and what a block needs to
know of the run before it, a running minimum or a state, is computed from one row a block and enters
the block as a row that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Epoch numbers of a block.
BLOCK = 1 << 16


def epoch_loss(
    runlog: DataFrame, run: str = "run_id", epoch: str = "epoch", phase: str = "phase"
) -> DataFrame:
    """Mean and sum of the batch losses of each epoch and phase."""
    return runlog.groupBy(run, epoch, phase).agg(
        F.avg("loss").alias("mean_loss"),
        F.sum("loss").alias("sum_loss"),
        F.count("loss").alias("batches"),
    )


def _validation(epochs: DataFrame, phase: str, val: str) -> DataFrame:
    return epochs.where((F.col(phase) == val) & F.col("mean_loss").isNotNull())


def best_epoch(
    epochs: DataFrame,
    run: str = "run_id",
    epoch: str = "epoch",
    phase: str = "phase",
    val: str = "val",
) -> DataFrame:
    """First epoch with the lowest mean validation loss."""
    rank = F.struct("mean_loss", epoch)
    return (
        _validation(epochs, phase, val)
        .groupBy(run)
        .agg(F.min(rank).alias("_best"))
        .select(
            run,
            F.col(f"_best.{epoch}").alias("best_epoch"),
            F.col("_best.mean_loss").alias("best_loss"),
        )
    )


def _block_of(epoch: Column, size: int | None) -> Column:
    """Number of an epoch's block; rows without an epoch come first, as they sort."""
    if size is None:
        return F.lit(0).cast("long")
    return F.coalesce(F.floor(epoch / size), F.lit(-(1 << 62)))


def _carried_minima(rows: DataFrame, run: str, value: str) -> DataFrame:
    """(run, _block, _carried): the least value of the run's earlier blocks, null for its first one.

    Only runs of more than one block are there. The minima are combined map-side, so that a run has
    as many rows here as it has blocks.
    """
    blocks = rows.groupBy(run, "_block").agg(F.min(value).alias("_least"))
    earlier = W.partitionBy(run).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    return (
        blocks.withColumn("_carried", F.min("_least").over(earlier))
        .withColumn("_n", F.count("*").over(W.partitionBy(run)))
        .where(F.col("_n") > 1)
        .select(run, "_block", "_carried")
    )


def improvements(
    epochs: DataFrame,
    run: str = "run_id",
    epoch: str = "epoch",
    phase: str = "phase",
    val: str = "val",
    block: int | None = BLOCK,
) -> DataFrame:
    """Per epoch: the best loss so far, whether it improved, whether it was saved.

    The first epoch sets the best without writing a checkpoint; later ones
    write one when strictly lower. Rows of one epoch go by their loss.

    The running minimum is taken inside blocks of ``block`` epochs, which the
    least loss of the blocks before enters as a first row. Pass None only where
    every run is known to be short: then a run is one block.
    """
    rows = _validation(epochs, phase, val).select(
        run, epoch, "mean_loss", _block_of(F.col(epoch), block).alias("_block")
    )
    both = rows.withColumn("_row", F.lit(True))
    if block is not None:
        carried = _carried_minima(rows, run, "mean_loss").where(F.col("_carried").isNotNull())
        first = carried.select(run, "_block", F.col("_carried").alias("mean_loss"), F.lit(False).alias("_row"))
        both = both.unionByName(first, allowMissingColumns=True)
    order = W.partitionBy(run, "_block").orderBy("_row", epoch, "mean_loss")
    earlier = F.min("mean_loss").over(order.rowsBetween(W.unboundedPreceding, -1))
    return (
        both.withColumn("_before", earlier)
        .where("_row")
        .select(
            run,
            epoch,
            "mean_loss",
            F.least(F.col("_before"), F.col("mean_loss")).alias("best_so_far"),
            (F.col("_before").isNull() | (F.col("mean_loss") < F.col("_before"))).alias("improved"),
            F.coalesce(F.col("mean_loss") < F.col("_before"), F.lit(False)).alias("saved"),
        )
    )


@dataclass(frozen=True)
class Plateau:
    """The rule of a plateau schedule, and its state: the best loss, bad epochs since, cuts so far.

    A loss is better when below ``best * (1 - threshold)``. A bad epoch beyond ``patience`` cuts the
    rate and starts the count anew.
    """

    factor: float
    patience: int
    threshold: float

    START = (inf, 0, 0)

    def first_better(self, loss: np.ndarray, at: int, best: float) -> int:
        """The first place from ``at`` with a better loss, the length if none: a search of doubling reach."""
        bound, reach, n = best * (1 - self.threshold), 16, len(loss)
        while at < n:
            hit = np.flatnonzero(loss[at : at + reach] < bound)
            if len(hit):
                return at + int(hit[0])
            at, reach = at + reach, reach * 2
        return n

    def walk(self, loss: np.ndarray, state: tuple, cuts: np.ndarray, bads: np.ndarray) -> tuple:
        """Fill the cuts and counts of a stretch that is entered in ``state``; the state after it.

        It steps from one better loss to the next; the epochs between are arithmetic.
        """
        best, bad, cut = state
        at, n, span = 0, len(loss), self.patience + 1
        while at < n:
            event = self.first_better(loss, at, best)
            counts = bad + 1 + np.arange(event - at)
            cuts[at:event] = cut + counts // span
            bads[at:event] = counts % span
            if event > at:
                cut, bad = int(cuts[event - 1]), int(bads[event - 1])
            if event < n:
                best, bad = float(loss[event]), 0
                cuts[event], bads[event] = cut, 0
            at = event + 1
        return best, bad, cut

    def summary(self, loss: np.ndarray, least: float | None) -> tuple[np.ndarray, ...]:
        """What a block does to any state it can be entered in: (loss, place, best, bad, cuts) of its first gains.

        The first gain for an entering bound is the first loss below it, so it is a strict minimum of
        the block so far, and what follows depends on it alone. ``least`` is the run's minimum before
        the block, None at its start. A bound cannot be above it, and for a positive one not below
        ``least * (1 - threshold)`` either: the minima in between and one below are all that count.
        """
        lowest = np.fmin.accumulate(np.append(inf, loss))
        place = np.flatnonzero(loss < lowest[:-1])
        if least is None:
            place = place[:1]  # the bound is infinite
        elif least > 0 and 0 <= self.threshold < 1:
            place = place[loss[place] < least]
            beyond = np.flatnonzero(loss[place] < least * (1 - self.threshold))
            place = place[: beyond[0] + 1] if len(beyond) else place
        known: dict[int, tuple[float, int, int]] = {}
        n, span = len(loss), self.patience + 1
        for start in place.tolist():
            path, at = [], start
            while at < n and at not in known:
                path.append(at)
                at = self.first_better(loss, at + 1, float(loss[at]))
            for event in reversed(path):
                bads = min(at, n) - event - 1
                after = known.get(at, (float(loss[event]), bads % span, 0))
                known[event] = (after[0], after[1], after[2] + bads // span)
                at = event
        ends = [known[p] for p in place.tolist()]
        best, bad, cuts = (np.array([e[k] for e in ends], t) for k, t in enumerate((float, np.int64, np.int64)))
        return loss[place], place, best, bad, cuts

    def enter(self, state: tuple, n: int, summary: tuple) -> tuple:
        """The state after a block of ``n`` epochs with this summary, entered in ``state``."""
        best, bad, cut = state
        losses, place, ends, bads, cuts = summary
        span = self.patience + 1
        hit = np.flatnonzero(losses < best * (1 - self.threshold))
        if not len(hit):
            return best, (bad + n) % span, cut + (bad + n) // span
        k = hit[0]
        return float(ends[k]), int(bads[k]), cut + (bad + int(place[k])) // span + int(cuts[k])


def _groups(batch: pa.RecordBatch, columns: list[str]) -> list[tuple[tuple, int, int]]:
    """(values, start, end) of the stretches of equal ``columns``."""
    change = np.zeros(batch.num_rows, bool)
    change[0] = True
    for c in columns:
        codes = batch[c].dictionary_encode(null_encoding="encode").indices.to_numpy()
        change[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(change)
    values = zip(*(batch[c].take(pa.array(starts)).to_pylist() for c in columns))
    return list(zip(values, starts.tolist(), [*starts[1:].tolist(), batch.num_rows]))


def plateau_lr(
    epochs: DataFrame,
    lr: float,
    factor: float = 0.1,
    patience: int = 5,
    threshold: float = 1e-4,
    run: str = "run_id",
    epoch: str = "epoch",
    phase: str = "phase",
    val: str = "val",
    block: int | None = BLOCK,
) -> DataFrame:
    """Learning rate after each epoch, cut when the summed validation loss stalls.

    A loss counts as better when below ``best * (1 - threshold)``. More than
    ``patience`` epochs without a better one multiply the rate by ``factor``.
    Rows without a run are one run; a null run stays null. Rows of one epoch go
    by their loss.

    Each state depends on the one before, so a long run is a prefix
    computation over state transitions: each block of ``block`` epochs of it is
    summed up by its answer to the states it can be entered in, the summaries
    of a run are applied in order, and the blocks are replayed side by side
    from the states found. A summary holds the minima of its block that lie
    within the threshold of the run's minimum before it, mostly one or two.
    Runs of one block are replayed at once. Pass None only where every run is
    known to be short: then a run is one block.
    """
    rule = Plateau(float(factor), patience, threshold)
    points = epochs.where((F.col(phase) == val) & F.col("sum_loss").isNotNull()).select(
        F.col(run).alias("run"), F.col(epoch).cast("long").alias("epoch"), F.col("sum_loss").cast("double").alias("loss")
    )
    points = points.withColumn("_block", _block_of(F.col("epoch"), block))
    rows = points.withColumn("_row", F.lit(True))
    if block is None:
        rows = rows.selectExpr("*", "NULL AS best", "NULL AS bad", "NULL AS cuts")
    else:
        states = _entry_states(points, rule).withColumn("_row", F.lit(False))
        rows = rows.unionByName(states, allowMissingColumns=True)
    rows = (
        rows.repartition("run", "_block")
        .sortWithinPartitions("run", "_block", "_row", "epoch", "loss")
        .select("run", "_block", "_row", "epoch", "loss", "best", "bad", "cuts")
    )
    run_type = points.schema["run"].dataType.simpleString()

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, rule.START
        for batch in batches:
            if not batch.num_rows:
                continue
            loss = batch["loss"].to_numpy(zero_copy_only=False)
            is_row = batch["_row"].to_numpy(zero_copy_only=False)
            cuts, bads = np.empty(len(loss), np.int64), np.empty(len(loss), np.int32)
            for name, a, b in _groups(batch, ["run", "_block"]):
                if name != last:
                    last, state = name, rule.START
                if not is_row[a]:
                    state = tuple(batch[c][a].as_py() for c in ("best", "bad", "cuts"))
                    a += 1
                state = rule.walk(loss[a:b], state, cuts[a:b], bads[a:b])
            rates = lr * np.power(rule.factor, cuts[is_row])
            mask = pa.array(is_row)
            yield pa.RecordBatch.from_arrays(
                [batch["run"].filter(mask), batch["epoch"].filter(mask), pa.array(rates), pa.array(bads[is_row])],
                names=["run", "epoch", "lr", "bad_epochs"],
            )

    return rows.mapInArrow(
        replay, f"run {run_type}, epoch long, lr double, bad_epochs int"
    ).withColumnsRenamed({"run": run, "epoch": epoch})


def _entry_states(points: DataFrame, rule: Plateau) -> DataFrame:
    """(run, _block, best, bad, cuts): the state in which each block but the first of a long run is entered."""
    minima = _carried_minima(points, "run", "loss")
    runs = minima.select(F.col("run").alias("_run")).distinct()
    of_long = points.join(runs, F.col("run").eqNullSafe(F.col("_run")), "left_semi")
    run_type = points.schema["run"].dataType.simpleString()
    blocks = (
        of_long.withColumn("_row", F.lit(True))
        .unionByName(minima.withColumn("_row", F.lit(False)), allowMissingColumns=True)
        .repartition("run", "_block")
        .sortWithinPartitions("run", "_block", "_row", "epoch", "loss")
        .select("run", "_block", "_row", "loss", "_carried")
    )
    lists = {"loss": pa.float64(), "place": pa.int64(), "best": pa.float64(), "bad": pa.int64(), "cuts": pa.int64()}

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(name, least, parts):
            loss = np.concatenate(parts)
            found = rule.summary(loss, least)
            values = [pa.array([x], pa.list_(t)) for x, t in zip(found, lists.values())]
            head = [pa.array([name[0]], run_of), pa.array([name[1]]), pa.array([len(loss)])]
            return pa.RecordBatch.from_arrays([*head, *values], names=["run", "_block", "n", *lists])

        last, least, parts, run_of = None, None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            run_of = batch.schema.field("run").type
            loss = batch["loss"].to_numpy(zero_copy_only=False)
            for name, a, b in _groups(batch, ["run", "_block"]):
                if name != last:
                    if last is not None:
                        yield summed(last, least, parts)
                    last, parts = name, []
                    least = batch["_carried"][a].as_py()
                    a += 1  # the row of the minimum
                parts.append(loss[a:b])
        if last is not None:
            yield summed(last, least, parts)

    kinds = {"loss": "double", "place": "long", "best": "double", "bad": "long", "cuts": "long"}
    schema = f"run {run_type}, _block long, n long, " + ", ".join(f"{c} array<{t}>" for c, t in kinds.items())
    summaries = blocks.mapInArrow(summarise, schema).repartition("run").sortWithinPartitions("run", "_block")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, rule.START
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, entered = [], []
            for name, a, b in _groups(batch, ["run"]):
                for i in range(a, b):
                    if name != last:
                        last, state = name, rule.START
                    else:
                        rows.append(i)
                        entered.append(state)
                    summary = tuple(batch[c][i].values.to_numpy(zero_copy_only=False) for c in lists)
                    state = rule.enter(state, batch["n"][i].as_py(), summary)
            if rows:
                best, bad, cuts = zip(*entered)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch["run"].take(at), batch["_block"].take(at), pa.array(best), pa.array(bad), pa.array(cuts)],
                    names=["run", "_block", "best", "bad", "cuts"],
                )

    return summaries.mapInArrow(apply, f"run {run_type}, _block long, best double, bad long, cuts long")
