"""Apply a user's model to a table, row failures isolated."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom import fixed
from featloom.functions import vectors
from featloom.operators.groupfeats import last_per_key
from featloom.session import ensure_checkpoint_dir

Model = Callable[[pd.DataFrame], np.ndarray]

#: An input of more than one in so many rows is hot.
HOT_SHARE = 1000


def _held(token: str, make_model: Callable[[], Model]) -> Model:
    """The model of this job, built once per Python worker and kept between its tasks."""
    held = sys.modules.setdefault("featloom_model", ModuleType("featloom_model"))
    if getattr(held, "token", None) != token:
        held.model = None  # let go of another job's model before loading the next
        held.model, held.token = make_model(), token
    return held.model


def encode_rows(
    df: DataFrame,
    make_model: Callable[[], Model],
    dims: int,
    ids: list[str],
    inputs: list[str],
    batch_size: int = 64,
    normalize: bool = False,
) -> DataFrame:
    """``ids, embedding, error`` for every row.

    ``make_model`` runs once per Python worker and returns a function from a
    frame of ``inputs`` to one vector of ``dims`` entries per row. A batch that
    fails, or comes back in another shape, is halved and tried again; a row that
    fails alone has a null embedding and the message of its error. The ids pass
    by the model untouched. Lazy and row-local, so it also accepts a stream.
    """

    def run(model: Model, batch: pd.DataFrame) -> list[tuple]:
        """(vector, error) per row; a failing batch is halved until a row fails alone."""
        try:
            vecs = np.asarray(model(batch), dtype="float32")
            if vecs.shape != (len(batch), dims):
                raise ValueError(f"{len(batch)} rows of {dims} wanted, shape {vecs.shape} out")
            return [(v, None) for v in vecs]
        except Exception as failure:  # noqa: BLE001 - any model failure is data here
            if len(batch) == 1:
                return [(None, f"{type(failure).__name__}: {failure}")]
            half = len(batch) // 2
            return run(model, batch.iloc[:half]) + run(model, batch.iloc[half:])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch_size):
                batch = whole.slice(start, batch_size)
                frame = batch.select(inputs).to_pandas()
                vecs, errors = zip(*run(_held(token, make_model), frame))
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.select(ids).columns,
                        pa.array(list(vecs), pa.list_(pa.float32())),
                        pa.array(list(errors), pa.string()),
                    ],
                    names=[*ids, "embedding", "error"],
                )

    token = uuid4().hex
    rows = df.select(*dict.fromkeys([*ids, *inputs]))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*ids).schema]
    schema = ", ".join([*fields, "embedding array<float>", "error string"])
    out = rows.mapInArrow(task, schema)
    if normalize:
        unit = vectors.l2_normalize(F.col("embedding")).cast("array<float>")
        out = out.withColumn("embedding", unit)
    return out


def split_encoded(encoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows of ``encode_rows`` or of its written table."""
    good = encoded.where(F.col("error").isNull()).drop("error")
    return good, encoded.where(F.col("error").isNotNull()).drop("embedding")


def batch_encode(
    df: DataFrame,
    make_model: Callable[[], Model],
    dims: int,
    ids: list[str],
    inputs: list[str],
    batch_size: int = 64,
    normalize: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Encode once, then ``(good, quarantine)``.

    The result is checkpointed to the shared folder, so the model runs once
    for both and not again when an executor is lost.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return split_encoded(
        encode_rows(df, make_model, dims, ids, inputs, batch_size, normalize).checkpoint()
    )


def encode_distinct(
    df: DataFrame,
    make_model: Callable[[], Model],
    dims: int,
    ids: list[str],
    inputs: list[str],
    batch_size: int = 64,
    normalize: bool = False,
    encode: Callable[[DataFrame, list[str]], DataFrame] | None = None,
) -> DataFrame:
    """``ids, embedding, error`` for every row, the model run once for all rows of equal inputs.

    Different inputs are found by an aggregate over the inputs themselves, so equality is that of the
    values, with null equal to null. They are encoded into a table addressed by a 128-bit digest of the
    inputs and joined back to all rows by it. Should two of them share a digest, the join compares the
    inputs too. Inputs of more than one in ``HOT_SHARE`` rows, at most ``HOT_SHARE`` of them, are
    broadcast; the others are too rare to make a task of the join large.

    ``encode`` gets the different inputs and the names of the digest and returns what
    :func:`encode_rows` would, for instance from a resumable job.
    """
    ensure_checkpoint_dir(df.sparkSession)
    digest = ["_c0", "_c1"]
    halves = {name: F.xxhash64(F.lit(seed), *inputs) for seed, name in enumerate(digest)}
    rows = df.select(*dict.fromkeys([*ids, *inputs])).withColumns(halves)
    different = rows.groupBy(*digest, *inputs).agg(F.count("*").alias("_n")).checkpoint()
    n_rows, n_inputs, n_digests = different.agg(
        F.sum("_n"), F.count("*"), F.count_distinct(F.struct(*digest))
    ).first()
    by = digest if n_inputs == n_digests else [*digest, *[f"_in{i}" for i in range(len(inputs))]]
    if by is not digest:
        copies = {f"_in{i}": F.col(c) for i, c in enumerate(inputs)}
        rows, different = rows.withColumns(copies), different.withColumns(copies)
    todo = different.select(*dict.fromkeys([*by, *inputs]))
    if encode is None:
        made = encode_rows(todo, make_model, dims, by, inputs, batch_size, normalize).checkpoint()
    else:
        made = encode(todo, by)
    hot = F.broadcast(different.where(F.col("_n") * HOT_SHARE > (n_rows or 0)).select(*by))
    is_hot = [made[c].eqNullSafe(hot[c]) for c in by]
    out = []
    for table in (F.broadcast(made.join(hot, is_hot, "left_semi")), made.join(hot, is_hot, "left_anti")):
        named = table.select(*[F.col(c).alias(f"_of{c}") for c in by], "embedding", "error")
        same = [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in by]
        out.append(rows.join(named, same).select(*ids, "embedding", "error"))
    return out[0].unionByName(out[1])


def encoder_catalogue(spark: SparkSession) -> DataFrame:
    """The published encoders, a table of three rows."""
    return spark.createDataFrame(
        fixed.ENCODERS, "speech_model string, emb_dims int, text_model string"
    )


def resolve_encoder(df: DataFrame, model: str = "model_id") -> DataFrame:
    """Look every model id up in the catalogue; unknown ids get its first row."""
    default_model, default_dims, default_text = fixed.ENCODERS[0]
    known = encoder_catalogue(df.sparkSession)
    return (
        df.join(F.broadcast(known), F.col(model) == F.col("speech_model"), "left")
        .withColumns(
            {
                "speech_model": F.coalesce("speech_model", F.lit(default_model)),
                "emb_dims": F.coalesce("emb_dims", F.lit(default_dims)),
                "text_model": F.coalesce("text_model", F.lit(default_text)),
            }
        )
    )


def last_write_wins(encoded: DataFrame, stem: str = "stem", path: str = "path") -> DataFrame:
    """Of inputs with one stem keep the last in path order."""
    return last_per_key(encoded, stem, path)


def distinct_inputs(df: DataFrame, path: str = "path") -> DataFrame:
    return df.dropDuplicates([path])
