"""Preparation of outcome, token and sequence columns for training batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom import fixed
from featloom.functions import vectors
from featloom.operators import chunked, exact
from featloom.operators.reshape import nan_to_null
from featloom.operators.sizing import broadcast_if_small


def outcome_stats(
    segments: DataFrame,
    by: str = "dataset_name",
    cols: list[str] = fixed.OUTCOMES,
    reproducible: bool = False,
) -> DataFrame:
    """Mean and sample standard deviation of every outcome, one row per corpus.

    With ``reproducible`` equal to the last bit under any partitioning; a corpus without any value is left out.
    """
    if reproducible:
        moments = exact.exact_moments(segments, [by], cols)
        picked = [
            F.max(F.when(F.col("column") == c, F.col(m))).alias(f"{c}_{m}") for c in cols for m in ("mean", "std")
        ]
        return moments.groupBy(by).agg(*picked)
    aggregates = []
    for c in cols:
        x = nan_to_null(F.col(c).cast("double"))
        aggregates += [F.avg(x).alias(f"{c}_mean"), F.stddev_samp(x).alias(f"{c}_std")]
    return segments.groupBy(by).agg(*aggregates)


def embedding_distribution(feats: DataFrame, vec: str = "embedding", ddof: int = 0) -> DataFrame:
    """One row: the mean over dimensions of the per-dimension mean and std."""
    std = "stddev_pop" if ddof == 0 else "stddev_samp"
    per_entry = chunked.aggregate_chunks(
        feats.select(vec),
        [],
        F.col(vec),
        f"struct(avg({{x}}) AS mean, {std}({{x}}) AS std)",
        size=16,
    )
    return chunked.positions(per_entry, [], size=16).agg(
        F.avg("value.mean").alias("mean"), F.avg("value.std").alias("std")
    )


def zscore_rescale(
    segments: DataFrame,
    by: str = "dataset_name",
    target: DataFrame | tuple[float, float] = (0.0, 1.0),
    cols: list[str] = fixed.OUTCOMES,
    reproducible: bool = False,
) -> DataFrame:
    """z-score per corpus, then rescale to a target mean and std.

    ``target`` is two numbers or the one-row frame of
    :func:`embedding_distribution`. A corpus whose std is zero, or of a single
    row, gives null. ``reproducible`` as in :func:`outcome_stats`.
    """
    if isinstance(target, DataFrame):
        goal = target.select(F.struct("mean", "std")).scalar()
    else:
        goal = F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(target, ("mean", "std"))])
    # The target rides on the statistics, so its subquery is planned once.
    stats = broadcast_if_small(
        outcome_stats(segments, by, cols, reproducible).withColumn("_goal", goal),
        probe=segments.select(by).distinct(),
    )
    scaled = {
        c: F.expr(
            f"try_divide(cast(`{c}` AS double) - `{c}_mean`, `{c}_std`) * _goal.std + _goal.mean"
        )
        for c in cols
    }
    return segments.join(stats, by, "left").withColumns(scaled).select(*segments.columns)


def batch_widths(df: DataFrame, batch: str, arr: str) -> DataFrame:
    """Longest array of each batch."""
    return df.groupBy(batch).agg(F.max(F.size(arr)).alias("width"))


def _with_width(df: DataFrame, probe: DataFrame, batch: str, arr: str) -> DataFrame:
    widths = batch_widths(df, batch, arr).withColumnsRenamed({batch: "_same", "width": "_width"})
    widths = broadcast_if_small(widths, probe=probe.select(batch).distinct())
    return df.join(widths, F.col(batch).eqNullSafe(F.col("_same")))


def pad_to_batch(df: DataFrame, batch: str, arr: str, fill: float = 0.0) -> DataFrame:
    """Right-pad every sequence to the longest of its batch.

    The width comes from a grouped maximum, not a window: a window would hold
    every sequence of a batch in one task. Rows without a batch are one batch.
    """
    return (
        _with_width(df, df, batch, arr)
        .withColumn(arr, vectors.pad(F.col(arr), F.col("_width"), fill))
        .select(*df.columns)
    )


def words(message: Column) -> Column:
    """Default tokens: maximal runs of non-blank characters."""
    return F.filter(F.split(message, r"\s+"), lambda w: w != "")


def truncate_mask(
    df: DataFrame,
    tokens: str,
    max_length: int = fixed.MAX_TOKENS,
    batch: str | None = None,
    pad_token: str = "",
) -> DataFrame:
    """Truncate token lists to the encoder's length and add ``attention_mask``.

    With ``batch``, lists are padded to the longest truncated one of the batch
    and the mask is 0 over the padding. Rows without a batch are one batch.
    """
    cut = df.withColumn(tokens, F.slice(tokens, 1, max_length))
    real = F.array_repeat(F.lit(1), F.size(tokens))
    if batch is None:
        return cut.withColumn("attention_mask", real)
    missing = F.col("_width") - F.size(tokens)
    return (
        _with_width(cut, df, batch, tokens)
        .withColumns(
            {
                tokens: F.concat(tokens, F.array_repeat(F.lit(pad_token), missing)),
                "attention_mask": F.concat(real, F.array_repeat(F.lit(0), missing)),
            }
        )
        .select(*df.columns, "attention_mask")
    )


def training_view(segments: DataFrame, path: str = "path") -> DataFrame:
    """Columns a training batch needs: media, message, outcome vector."""
    outcomes = F.array(*[F.col(c).cast("float") for c in fixed.OUTCOMES]).alias("outcomes")
    return segments.select(path, "message", outcomes)


def inference_view(segments: DataFrame, path: str = "path") -> DataFrame:
    """Columns an inference batch needs: corpus, id, media, message."""
    return segments.select("dataset_name", "message_id", path, "message")


def row_counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("rows"))
