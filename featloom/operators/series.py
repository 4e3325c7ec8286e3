"""Multi-channel series: downmix and resample."""

from __future__ import annotations

from math import ceil, gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom import fixed

# Windowed-sinc kernel: zero crossings on each side and band edge.
CROSSINGS = 6
ROLLOFF = 0.99
BLOCK = 1 << 14
# Entries of a table of kernels; rates that need more are computed output by output.
TABLE_CELLS = 1 << 22


def downmix(series: DataFrame, keys: list[str] = ["series_id"]) -> DataFrame:
    """Mean over channels at each sample; a single channel is unchanged."""
    return series.groupBy(*keys, "idx").agg(F.avg("value").alias("value"))


def resample(
    series: DataFrame,
    orig: int,
    new: int = fixed.SAMPLE_RATE,
    keys: list[str] = ["series_id"],
    block: int = BLOCK,
) -> DataFrame:
    """Resample ``keys, idx, value`` by a Hann-windowed sinc; equal rates pass through.

    A missing ``idx`` is a zero sample. A series is computed in blocks of
    ``block`` outputs: each sample goes to the blocks its kernel reaches, which
    is one, or two next to a border. So a task holds one block however long
    the series is, and each sample is shuffled about once.

    Outputs lie ``orig / new = p / q`` samples apart, so each at one of ``q`` phases
    between two samples. The kernels of all phases are one table, built once a task.
    """
    if orig == new:
        return series.select(*keys, "idx", "value")
    ratio = orig / new
    p, q = orig // gcd(orig, new), new // gcd(orig, new)
    cutoff = ROLLOFF * min(1.0, new / orig)
    reach = CROSSINGS / cutoff
    idx = F.col("idx").cast("long")

    def block_of(i):
        return F.greatest(F.floor(i / F.lit(ratio * block)), F.lit(0).cast("long"))

    samples = series.where(F.col("idx").isNotNull()).select(
        *keys,
        F.explode(F.sequence(block_of(idx - reach - ratio), block_of(idx + reach))).alias("_b"),
        idx.alias("idx"),
        F.col("value").cast("double").alias("value"),
        F.lit(None).cast("long").alias("_out"),
    )
    # One marker per block: it carries the output length and keeps silent blocks.
    outputs = F.ceil((F.max(idx) + 1) * F.lit(new) / F.lit(orig))
    markers = (
        series.groupBy(*keys)
        .agg(outputs.alias("_out"))
        .select(
            *keys,
            F.explode(
                F.sequence(F.lit(0).cast("long"), F.floor((F.col("_out") - 1) / block))
            ).alias("_b"),
            F.lit(None).cast("long").alias("idx"),
            F.lit(None).cast("double").alias("value"),
            "_out",
        )
        .where(F.col("_out") > 0)
    )
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in series.select(*keys).schema]
    schema = ", ".join([*fields, "idx bigint", "value double"])
    taps = np.arange(-ceil(reach), ceil(reach) + 1)
    held: list[np.ndarray] = []  # the table of this task

    def kernels(phases: np.ndarray) -> np.ndarray:
        """The kernel of each phase, in q-ths of a sample, over the taps."""
        u = cutoff * (phases[:, None] / q - taps[None, :])
        kernel = cutoff * np.sinc(u) * np.cos(np.pi * u / (2 * CROSSINGS)) ** 2
        kernel[np.abs(u) > CROSSINGS] = 0.0
        return kernel

    def kernels_of(phases: np.ndarray) -> np.ndarray:
        if q * len(taps) > TABLE_CELLS:
            return kernels(phases)
        if not held:
            held.append(kernels(np.arange(q)))
        return held[0][phases]

    def convolve(table: pa.Table) -> pa.Table:
        marker = table.filter(table["_out"].is_valid())
        if not marker.num_rows:  # samples whose kernel ends behind the last output
            return pa.table({**{k: table[k].slice(0, 0) for k in keys}, "idx": pa.array([], "int64"),
                             "value": pa.array([], "float64")})
        start = marker["_b"][0].as_py() * block
        j = np.arange(start, min(start + block, marker["_out"][0].as_py()))
        centre, phase = np.divmod(j * p, q)
        low = centre[0] + taps[0]
        x = np.zeros(centre[-1] + taps[-1] + 1 - low)
        rows = table.filter(table["idx"].is_valid())
        at = rows["idx"].to_numpy() - low
        inside = (at >= 0) & (at < len(x))
        np.add.at(x, at[inside], rows["value"].fill_null(0.0).to_numpy()[inside])
        reached = np.lib.stride_tricks.sliding_window_view(x, len(taps))[centre - centre[0]]
        y = np.einsum("jt,jt->j", reached, kernels_of(phase))
        ids = {k: pa.repeat(marker[k][0], len(j)) for k in keys}
        return pa.table({**ids, "idx": j, "value": y})

    return (
        samples.unionByName(markers).groupBy(*keys, "_b").applyInArrow(convolve, schema)
    )
