"""From corpora to training batches in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom import fixed
from featloom.operators import groupfeats, index, prep


def prepare_batches(
    corpora: dict[str, DataFrame],
    batch_size: int,
    fraction: float = 0.8,
    target: DataFrame | tuple[float, float] = (0.0, 1.0),
    cols: list[str] = fixed.OUTCOMES,
    message: str = "message",
    max_length: int = fixed.MAX_TOKENS,
    seed: int = 0,
    shuffle_key: Column | None = None,
) -> DataFrame:
    """Union of corpora, outcomes rescaled, split, dealt to batches, messages padded by batch.

    Adds ``dataset_name``, ``split``, ``batch_id`` (from 0 in each split),
    ``tokens`` and ``attention_mask``. Rows of a batch need not lie together:
    group or partition by ``split, batch_id`` to read them. The split's
    histograms are read when the plan is built.
    """
    rows = prep.zscore_rescale(groupfeats.tagged_union(corpora), target=target, cols=cols)
    halves = index.exact_split(rows, fraction, seed=seed, shuffle_key=shuffle_key)
    dealt = [
        index.assign_batches(halves.where(F.col("split") == part), batch_size, seed, shuffle_key)
        for part in ("train", "validation")
    ]
    batch = F.struct("split", "batch_id")
    batches = dealt[0].unionByName(dealt[1]).withColumns(
        {"tokens": prep.words(F.col(message)), "_batch_key": batch}
    )
    masked = prep.truncate_mask(batches, "tokens", max_length, batch="_batch_key")
    return masked.drop("_batch_key")
