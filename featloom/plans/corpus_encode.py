"""Encode corpora with a user's model and write the embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from featloom.operators import encode
from featloom.sinks import ledger, tables
from featloom.sources.media import manifest


def encode_corpora(
    segments: DataFrame,
    make_model: Callable[[], encode.Model],
    dims: int,
    inputs: list[str],
    target: str,
    quarantine: str,
    batch_size: int = 64,
) -> None:
    """Unit vectors per segment to ``target``, one folder per corpus; failures apart.

    An output that exists is an error before the model starts.
    """
    tables.refuse_existing(segments.sparkSession, target, quarantine)
    ids = ["dataset_name", "message_id"]
    good, bad = encode.batch_encode(
        segments, make_model, dims, ids, inputs, batch_size, normalize=True
    )
    tables.write_embeddings(good, target)
    bad.write.mode("errorifexists").parquet(quarantine)


def encode_corpora_in_waves(
    segments: DataFrame,
    make_model: Callable[[], encode.Model],
    dims: int,
    inputs: list[str],
    target: str,
    batch_size: int = 64,
    most_waves: int | None = None,
) -> tuple[DataFrame, DataFrame] | None:
    """The same as a job that may be stopped and called again: ``(good, quarantine)`` when all is there.

    ``target`` holds the waves and their ledger; None while rows are missing.
    """
    ids = ["dataset_name", "message_id"]
    whole = ledger.encode_resumable(
        segments, make_model, dims, ids, inputs, target, batch_size, normalize=True, most_waves=most_waves
    )
    if not whole:
        return None
    return encode.split_encoded(ledger.read_encoded(segments.sparkSession, target))


def encode_files(
    spark: SparkSession,
    path: str,
    make_model: Callable[[], encode.Model],
    dims: int,
    target: str,
    quarantine: str,
    batch_size: int = 64,
) -> None:
    """Vectors of the media files at ``path``; the model gets their paths."""
    tables.refuse_existing(spark, target, quarantine)
    files = manifest(spark, path).select("path")
    good, bad = encode.batch_encode(files, make_model, dims, ["path"], ["path"], batch_size)
    tables.write_by_path(good, target)
    bad.write.mode("errorifexists").parquet(quarantine)
