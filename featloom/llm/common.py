"""Shared pieces: Arrow batches as flat byte arrays, bounded blocks, shared checkpoints."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Hashable, Iterator
from types import ModuleType
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.session import ensure_checkpoint_dir

#: Bytes of text that a Python worker turns into arrays at a time; a longer text is a block alone.
BLOCK_BYTES = 1 << 19

#: ASCII white space that separates words in all word rules here.
WORD_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def held(name: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in a Python worker and kept between its tasks.

    Kept in a module of its own and not by a decorator: a function that keeps its results is known to
    the workers by its name only, and they may not have this package.
    """
    store = sys.modules.setdefault("featloom_held", ModuleType("featloom_held")).__dict__.setdefault("values", {})
    if name not in store:
        store[name] = make()
    return store[name]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as (bytes, offsets); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one longer row."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def frugal() -> None:
    """Lets a Python worker give large arrays back at once, so that idle workers stay small.

    Arrow allocates as numpy does. The C library maps blocks above 8 MB on their own and keeps
    smaller ones for the next use, up to a bound; what is free is given back between partitions.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
        libc.malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def map_arrow(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``fn`` over the Arrow batches of each partition; state lives for one partition at most."""

    def run(batches):
        frugal()
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
        frugal()

    return df.mapInArrow(run, schema)


def binary(parts: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from flat bytes and offsets."""
    offsets = np.ascontiguousarray(offsets, dtype=np.int64)
    data = np.ascontiguousarray(parts).view(np.uint8)
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    ).cast(pa.binary())


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == remainder, F.lit(False))


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows written to the folder all executors share, read back without their history."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(df: DataFrame) -> int:
    """The shuffle partitions of the session, which follow the size of the cluster and the data."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` different rows, the same ones on each run: those of the least hash of key and row.

    The rows are counted first, and a bound on the hash leaves about twice as many as are wanted, so
    that the tasks together send that many to the driver however many tasks there are. Where copies of
    rows take the room of others the bound is raised. The sample is written, as it is read more than once.
    """
    hashed = F.xxhash64(F.col(key).cast("string"), *df.columns)
    share = 2 * rows / max(df.count(), 1)
    while True:
        near = df if share >= 1 else df.where(hashed < -(1 << 63) + int(share * (1 << 64)))
        found = checkpoint(near.dropDuplicates().orderBy(hashed, *df.columns).limit(rows))
        if share >= 1 or found.count() >= rows:
            return found
        share *= 4
