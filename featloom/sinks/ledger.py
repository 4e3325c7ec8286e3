"""Encoding in waves with a ledger, so that a job that was stopped goes on where it stopped.

Rows fall into ranges by a digest of their ids and inputs. A wave encodes some ranges into a folder of
its own; then one ledger file, put in place by an atomic rename, makes the folder part of the table.
What a stopped job wrote without an entry is never read. A later job compares the number and the
digest sum of each range's rows with the ledger: ranges that agree are finished and not looked at again,
in the others rows that are there already are left out by an anti-join on the digest. So rows that came
to the input since are encoded too; a row whose input changed is a new row, and rows that left the input
stay in the table.

One job writes to a target at a time: a second one finds its ledger entry taken and fails.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.operators import encode

#: Ranges of a table; a ledger has at most so many numbers of each wave.
RANGES = 1024
#: Waves of a job. Each reads the ids and inputs of the whole table, and loses at most its own work.
WAVES = 8

_INTERNAL = ["_range", "_d0", "_d1"]


def with_digest(df: DataFrame, columns: list[str], ranges: int = RANGES) -> DataFrame:
    """The rows with a 128-bit digest of ``columns`` in two halves, and the range it falls in."""
    halves = {f"_d{seed}": F.xxhash64(F.lit(seed), *columns) for seed in (0, 1)}
    return df.withColumns(halves).withColumn("_range", F.pmod(F.col("_d1"), F.lit(ranges)).cast("int"))


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, folder: str) -> list[str]:
    at = _path(spark, folder)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(at))


def _commit(spark: SparkSession, target: str, number: int, entry: dict) -> None:
    """The entry as a file that is there whole or not at all; one that is taken is an error."""
    sc = spark.sparkContext
    hadoop, conf = sc._jvm.org.apache.hadoop.fs, sc._jsc.hadoopConfiguration()
    draft, final = _path(spark, f"{target}/drafts/{uuid4().hex}"), _path(spark, f"{target}/ledger/{number:08d}.json")
    system = draft.getFileSystem(conf)
    system.mkdirs(final.getParent())
    out = system.create(draft, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    options = sc._gateway.new_array(hadoop.Options.Rename, 0)
    hadoop.FileContext.getFileContext(draft.toUri(), conf).rename(draft, final, options)


def ledger(spark: SparkSession, target: str) -> list[dict]:
    """The entries of the waves that are finished, in order; each is as long as there are ranges at most."""
    names = [n for n in _files(spark, f"{target}/ledger") if n.endswith(".json")]
    if not names:
        return []
    rows = spark.read.text([f"{target}/ledger/{n}" for n in names], wholetext=True).collect()
    return sorted((json.loads(r.value) for r in rows), key=lambda e: e["number"])


def _sums(df: DataFrame) -> dict[int, tuple[int, int]]:
    """(rows, sum of digests) of each range: two numbers a range."""
    counted = df.groupBy("_range").agg(F.count("*").alias("n"), F.sum(F.col("_d0").cast("decimal(38,0)")).alias("sum"))
    return {r["_range"]: (r["n"], int(r["sum"])) for r in counted.collect()}


def read_encoded(spark: SparkSession, target: str) -> DataFrame:
    """``ids, embedding, error`` of all finished waves."""
    folders = [f"{target}/{e['folder']}" for e in ledger(spark, target)]
    if not folders:
        raise ValueError(f"nothing finished in {target}")
    return spark.read.parquet(*folders).drop(*_INTERNAL)


def encode_resumable(
    df: DataFrame,
    make_model: Callable[[], encode.Model],
    dims: int,
    ids: list[str],
    inputs: list[str],
    target: str,
    batch_size: int = 64,
    normalize: bool = False,
    ranges: int = RANGES,
    waves: int = WAVES,
    most_waves: int | None = None,
) -> bool:
    """Encode the rows that ``target`` lacks, wave by wave; whether all are there now.

    Rows are those of :func:`featloom.operators.encode.encode_rows`, failing ones with their error; read
    them with :func:`read_encoded`. ``most_waves`` ends the job early, to be called again. A target begun
    with other settings is an error. Repeated rows are encoded as often as they are in the input when
    they are first met. An empty table makes one wave without rows.
    """
    spark = df.sparkSession
    settings = {"dims": dims, "ids": ids, "inputs": inputs, "normalize": normalize, "ranges": ranges}
    entries = ledger(spark, target)
    if any(e["settings"] != settings for e in entries):
        raise ValueError(f"{target} was begun with other settings")
    rows = with_digest(df.select(*dict.fromkeys([*ids, *inputs])), list(dict.fromkeys([*ids, *inputs])), ranges)
    wanted, there = _sums(rows), _total(entries)
    open_ranges = [r for r in sorted(wanted) if there.get(r) != wanted[r]]
    if not open_ranges and entries:
        return True
    size = max(1, -(-len(open_ranges) // waves))
    parts = [open_ranges[i : i + size] for i in range(0, len(open_ranges), size)] or [[]]
    for part in parts[:most_waves]:
        todo = rows.where(F.col("_range").isin(part))
        if any(r in there for r in part):
            old = spark.read.parquet(*[f"{target}/{e['folder']}" for e in entries]).where(F.col("_range").isin(part))
            todo = todo.join(old.select("_range", "_d0", "_d1"), _INTERNAL, "left_anti")
        folder = f"waves/{uuid4().hex}"
        made = encode.encode_rows(todo, make_model, dims, [*ids, *_INTERNAL], inputs, batch_size, normalize)
        made.write.parquet(f"{target}/{folder}")
        written = _sums(spark.read.parquet(f"{target}/{folder}"))
        number = entries[-1]["number"] + 1 if entries else 0
        sums = {str(r): [n, str(s)] for r, (n, s) in written.items()}
        entry = {"number": number, "folder": folder, "settings": settings, "ranges": sums}
        _commit(spark, target, number, entry)
        entries.append(entry)
    return most_waves is None or most_waves >= len(parts)


def _total(entries: list[dict]) -> dict[int, tuple[int, int]]:
    out: dict[int, tuple[int, int]] = {}
    for e in entries:
        for r, (n, s) in e["ranges"].items():
            rows, total = out.get(int(r), (0, 0))
            out[int(r)] = (rows + n, total + int(s))
    return out
