"""In-batch contrastive losses over tables of embedding pairs.

A batch of B pairs has 2 B^2 similarities. They are formed by matrix products
inside a task and reduced there; no pair of rows ever becomes a row. A batch is
cut into blocks of about ``BLOCK_ROWS``, and every pair of blocks is its own
group, so a task holds at most two blocks however large the batch is.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.functions import vectors

BLOCK_ROWS = 1024
TAU = 0.1
# Two hashes of its content name a row.
NAME = ("_h1", "_h2")


class Tile:
    """One block of students against one block of students and teachers."""

    def __init__(self, left: pa.Table, right: pa.Table, tau: float):
        self.tau = tau
        self.diagonal = left is right
        self._left, self._right = left, right

    @cached_property
    def _x(self) -> np.ndarray:
        return _unit(self._left["x"])

    @cached_property
    def xy(self) -> np.ndarray:
        return self._x @ _unit(self._right["y"], self._x.shape[1]).T

    @cached_property
    def xx(self) -> np.ndarray:
        return self._x @ (self._x if self.diagonal else _unit(self._right["x"])).T

    @cached_property
    def same_label(self) -> np.ndarray:
        """Labels as whole numbers; a null label equals none."""
        both = pa.chunked_array(self._left["label"].chunks + self._right["label"].chunks)
        codes = pc.fill_null(both.combine_chunks().dictionary_encode().indices, -1).to_numpy()
        rows, columns = codes[: self._left.num_rows], codes[self._left.num_rows :]
        return (rows[:, None] == columns[None, :]) & (rows >= 0)[:, None]

    @cached_property
    def off(self) -> np.ndarray:
        """1 off the diagonal, 0 on it. All ones when the blocks differ."""
        off = np.ones_like(self.xy)
        if self.diagonal:
            np.fill_diagonal(off, 0.0)
        return off

    @cached_property
    def positive(self) -> np.ndarray:
        """Similarity of each student to its own teacher, in the diagonal tile."""
        return np.diagonal(self.xy) if self.diagonal else np.zeros(len(self.xy))

    def heat(self, *parts: tuple[np.ndarray, np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
        """(top, sum of ``exp((s - top) / tau)``) per row over the similarities a mask allows.

        Relative to the row's largest, so that no row underflows however small tau is.
        """
        masked = [s if m is None else np.where(m, s, -np.inf) for s, m in parts]
        top = np.max([m.max(axis=1, initial=-np.inf) for m in masked], axis=0)
        base = np.where(np.isfinite(top), top, 0.0)[:, None]
        return top, sum(np.exp((m - base) / self.tau).sum(axis=1) for m in masked)


def _unit(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    widths = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(widths) > 1 or (width is not None and widths != [width]):
        raise ValueError(f"vectors of different widths: {widths}, {width}")
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("float64")
    rows = flat.reshape(len(column), -1)
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.maximum(norms, vectors.NORM_FLOOR)


Measure = Callable[[Tile], dict[str, np.ndarray]]


def per_student(
    pairs: DataFrame,
    measure: Measure,
    names: list[str],
    batch: str = "batch_id",
    tau: float = TAU,
    label: str | None = None,
    heats: tuple[str, ...] = (),
) -> DataFrame:
    """Sums over its batch for each student row: ``batch, row``, ``names`` and ``heats``.

    ``measure`` reduces a tile to one number per student and name; the numbers
    of a student's tiles are added up. For a name of ``heats`` it gives
    ``name_top`` and ``name_rest``, which are put together as the logarithm of
    the sum of ``exp(s / tau)``. A pair without ``x`` or ``y`` does not count.

    One lazy path: every batch is cut into as many blocks as its size asks for,
    mostly one. A row is named by two hashes of its content, so that its tiles
    agree on it after the loss of an executor without writing it anywhere;
    copies of a row share a block and come out as often as they went in.
    """
    extra = [F.col(label).alias("label")] if label else []
    content = [F.col(batch).alias("batch"), "x", "y", *extra]
    rows = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*content)
    rows = rows.withColumns({h: F.xxhash64(F.lit(h), *rows.columns) for h in NAME})
    sizes = rows.groupBy(F.col("batch").alias("_batch")).agg(
        F.ceil(F.count("*") / BLOCK_ROWS).alias("_blocks")
    )
    dealt = rows.join(sizes, F.col("batch").eqNullSafe(F.col("_batch"))).drop("_batch")
    partial = [*names, *(f"{h}_{part}" for h in heats for part in ("top", "rest"))]
    tiled = (
        _place(dealt)
        .groupBy("batch", "_p", "_q")
        .applyInArrow(_reducer(measure, partial, tau), _partial_schema(rows, partial))
    )
    tiles = [F.collect_list(F.struct(f"{h}_top", f"{h}_rest")).alias(h) for h in heats]
    sums = tiled.groupBy("batch", *NAME).agg(
        F.sum("copies").alias("copies"), *[F.sum(n).alias(n) for n in names], *tiles
    )
    each = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")
    return sums.select(
        "batch",
        F.struct(*NAME).alias("row"),
        *[(F.col(n) / F.col("copies")).alias(n) for n in names],
        *[_log_sum(h, tau).alias(h) for h in heats],
        each,
    ).drop("_copy")


def _log_sum(heat: str, tau: float) -> Column:
    """``ln sum exp(s / tau)`` from (top, rest) of a row's tiles: one per block of the batch."""
    top = F.array_max(F.transform(heat, lambda t: t[f"{heat}_top"]))

    def scaled(t: Column) -> Column:
        own = t[f"{heat}_top"]
        return F.when(own > float("-inf"), t[f"{heat}_rest"] * F.exp((own - top) / tau)).otherwise(0.0)

    total = F.aggregate(heat, F.lit(0.0), lambda a, t: a + scaled(t)) / F.col("copies")
    return F.when(top > float("-inf"), F.log(total) + top / tau).otherwise(F.lit(float("-inf")))


def _place(rows: DataFrame) -> DataFrame:
    """Copy each row to the tiles of its block: block p by every q, every p by q.

    Blocks are dealt by the row's name, so they are even whatever the order.
    The sums do not depend on which block a row is in. Off the diagonal a left
    copy needs no teacher.
    """
    last = F.col("_blocks") - 1
    mine = F.pmod(F.col(NAME[0]), F.col("_blocks"))
    others = F.sequence(F.lit(0).cast("long"), last)
    as_left = F.transform(
        others, lambda q: F.struct(F.col("_mine").alias("p"), q.alias("q"), F.lit(True).alias("left"))
    )
    as_right = F.transform(
        F.filter(others, lambda p: p != F.col("_mine")),
        lambda p: F.struct(p.alias("p"), F.col("_mine").alias("q"), F.lit(False).alias("left")),
    )
    dealt = (
        rows.withColumn("_mine", mine)
        .withColumn("_tile", F.explode(F.concat(as_left, as_right)))
        .withColumns({f"_{c}": F.col(f"_tile.{c}") for c in ("p", "q", "left")})
        .drop("_tile", "_mine", "_blocks")
    )
    return dealt.withColumn("y", F.when((F.col("_p") == F.col("_q")) | ~F.col("_left"), F.col("y")))


def _partial_schema(rows: DataFrame, names: list[str]) -> str:
    batch_type = rows.schema["batch"].dataType.simpleString()
    return (
        f"batch {batch_type}, {NAME[0]} bigint, {NAME[1]} bigint, copies bigint, "
        + ", ".join(f"{n} double" for n in names)
    )


def _reducer(measure: Measure, names: list[str], tau: float):
    def reduce_tile(table: pa.Table) -> pa.Table:
        left = right = table
        diagonal = table["_p"][0] == table["_q"][0]
        if not diagonal:
            left, right = table.filter(table["_left"]), table.filter(pc.invert(table["_left"]))
        sums = {}
        if left.num_rows and right.num_rows:
            sums = measure(Tile(left, right, tau))
        none = {n: np.full(left.num_rows, -np.inf if n.endswith("_top") else 0.0) for n in names}
        copies = np.full(left.num_rows, int(diagonal), dtype="int64")
        return pa.table(
            {
                "batch": left["batch"],
                **{h: left[h] for h in NAME},
                "copies": copies,
                **(none | sums),
            }
        )

    return reduce_tile




# --- what each loss needs of a tile -------------------------------------------------


def _similarity_sums(t: Tile) -> dict[str, np.ndarray]:
    return {"positive": t.positive, "total": t.xy.sum(axis=1)}


def _hinge_sums(t: Tile) -> dict[str, np.ndarray]:
    return {
        "positive": t.positive,
        "negative": (t.off * np.maximum(1.0 - t.xy, 0.0)).sum(axis=1),
    }


def _heat(name: str, parts: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}_top": parts[0], f"{name}_rest": parts[1]}


def _heat_sums(t: Tile) -> dict[str, np.ndarray]:
    return {
        "positive": t.positive,
        **_heat("rest", t.heat((t.xy, None), (t.xx, t.off > 0))),
    }


def _label_sums(t: Tile) -> dict[str, np.ndarray]:
    off = t.off > 0
    same, other = t.same_label & off, ~t.same_label & off
    return {
        "positive": t.positive,
        "mates": same.sum(axis=1).astype("float64"),
        "mate_sims": (same * t.xy).sum(axis=1),
        **_heat("strangers", t.heat((t.xy, other))),
        **_heat("others", t.heat((t.xy, off))),
    }


# --- losses, one row per batch ------------------------------------------------------


def similarity_sums(pairs: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Per batch: pairs, sum of the positive and of all student-teacher cosines."""
    rows = per_student(pairs, _similarity_sums, ["positive", "total"], batch)
    return rows.groupBy(F.col("batch").alias(batch)).agg(
        F.count("*").alias("pairs"),
        F.sum("positive").alias("positive"),
        F.sum("total").alias("total"),
    )


def cos_loss(pairs: DataFrame, batch: str = "batch_id") -> DataFrame:
    """``1 - mean(cos(x, y))``."""
    similarity = vectors.cosine(F.col("x"), F.col("y"))
    return pairs.groupBy(batch).agg((1 - F.avg(similarity)).alias("loss"))


def sim_clr(pairs: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Sum of the diagonal plus hinged distance off it, signs as published."""
    rows = per_student(pairs, _hinge_sums, ["positive", "negative"], batch)
    return rows.groupBy(F.col("batch").alias(batch)).agg(
        (F.sum("positive") + F.sum("negative")).alias("loss")
    )


def _pooled(rows: DataFrame, batch: str, loss, pooling: str) -> DataFrame:
    pool = {"sum": F.sum, "mean": F.avg}[pooling]
    return rows.groupBy(F.col("batch").alias(batch)).agg(pool(loss).alias("loss"))


def nce(
    pairs: DataFrame, batch: str = "batch_id", tau: float = TAU, pooling: str = "sum"
) -> DataFrame:
    """NT-Xent of each student against all other students and all teachers."""
    rows = per_student(pairs, _heat_sums, ["positive"], batch, tau, heats=("rest",))
    loss = F.col("rest") - F.col("positive") / tau
    return _pooled(rows, batch, loss, pooling)


def supervised(
    pairs: DataFrame, label: str = "label", batch: str = "batch_id", tau: float = TAU
) -> DataFrame:
    """Supervised contrastive loss; a student without label mates falls back to its own teacher.

    Opt-in. Without any stranger the ratio is infinite, as in the formula. A
    null label is nobody's mate.
    """
    names = ["positive", "mates", "mate_sims"]
    rows = per_student(
        pairs, _label_sums, names, batch, tau, label, heats=("strangers", "others")
    )
    mates = F.col("strangers") - F.col("mate_sims") / F.col("mates") / tau
    alone = F.col("others") - F.col("positive") / tau
    return _pooled(rows, batch, F.when(F.col("mates") > 0, mates).otherwise(alone), "sum")


LOSSES = {"CS": cos_loss, "NCE": nce}


def loss(pairs: DataFrame, name: str = "NCE", **options) -> DataFrame:
    """Loss by name: ``CS`` or ``NCE``."""
    return LOSSES[name](pairs, **options)
