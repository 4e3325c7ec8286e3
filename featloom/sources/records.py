"""Records of CSV files whose quoted values hold line breaks, read in parallel.

Whether a line break is inside quotes depends on all quotes before it in the file. So splits of a file
are read twice: once for their number of quotes, whose parity, carried over the splits before, says
whether a split begins inside a quoted value; and once to cut it into records. A record that reaches
over a split's end is put together from its parts; no other text leaves the task that reads it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from featloom.operators.sizing import has_at_most
from featloom.session import ensure_checkpoint_dir

_RECORDS = "path string, block long, part int, first boolean, record string"
#: Splits inside a quoted value that are broadcast at most.
OPEN_SPLITS = 20_000
#: A whole record, the end of one that an earlier split begins, the beginning of one that goes on.
WHOLE, END, BEGIN = 0, 1, 2


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their file and split; a partition has the lines of a split in order."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _open_splits(lines: DataFrame) -> DataFrame:
    """(path, block) of the splits that begin inside a quoted value: a row for each split at most."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy("path", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return odd.withColumn("open", F.sum("odd").over(before) % 2 == 1).where("open").select("path", "block", "open")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the lines of a partition: whole ones, and the parts at both ends of a split."""
    split, held, inside, ended, first = None, [], False, False, False

    def finish():
        """What is left at the end of a split: a part of a record that goes on in the next."""
        part = END if not ended and opened else BEGIN
        return [(*split, part, first, "\n".join(held))] if held else []

    opened = False
    for batch in batches:
        if not batch.num_rows:
            continue
        out: list[tuple] = []
        values = batch["value"]
        odd = pc.count_substring(values, '"').to_numpy() % 2 == 1
        paths, blocks = batch["path"].to_pylist(), batch["block"].to_numpy()
        begins = batch["open"].fill_null(False).to_numpy(zero_copy_only=False)
        texts = values.to_pylist()
        for i in range(len(texts)):
            here = (paths[i], int(blocks[i]))
            if here != split:
                if split is not None:
                    out += finish()
                split, held, inside, opened = here, [], bool(begins[i]), bool(begins[i])
                ended, first = False, here[1] == 0
            held.append(texts[i])
            inside ^= bool(odd[i])
            if not inside:
                part = END if opened and not ended else WHOLE
                out.append((*split, part, first, "\n".join(held)))
                held, ended, first = [], True, False
        if out:
            yield _batch(out)
    if split is not None and held:
        yield _batch(finish())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    path, block, part, first, record = zip(*rows)
    columns = [pa.array(path), pa.array(block, pa.int64()), pa.array(part, pa.int32()), pa.array(first), pa.array(record)]
    return pa.RecordBatch.from_arrays(columns, names=["path", "block", "part", "first", "record"])


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, first, record): the records of CSV files with ``\\n`` or ``\\r\\n`` line ends, the first of each file marked.

    Quotes stand around values, and doubled inside them; empty lines between records are left out.
    """
    lines = _lines(spark, path)
    ensure_checkpoint_dir(spark)
    opens = _open_splits(lines).checkpoint()
    if has_at_most(opens, OPEN_SPLITS):
        marked = lines.join(F.broadcast(opens), ["path", "block"], "left")
    else:  # a join that deals the lines anew: splits stay whole, their order is restored
        placed = lines.withColumn("at", F.monotonically_increasing_id())
        marked = placed.join(opens, ["path", "block"], "left").sortWithinPartitions("path", "block", "at")
    cut = marked.select("path", "block", "value", "open").mapInArrow(_cut, _RECORDS)
    # Parts of records, at most two a split, in the order of the file: each beginning starts a record.
    order = W.partitionBy("path").orderBy("block", "part")
    parts = cut.where(F.col("part") != WHOLE).withColumn("number", F.sum((F.col("part") == BEGIN).cast("int")).over(order))
    pieces = F.sort_array(F.collect_list(F.struct("block", "part", "record")))
    joined = parts.groupBy("path", "number").agg(
        F.max("first").alias("first"), F.array_join(F.transform(pieces, lambda p: p["record"]), "\n").alias("record")
    )
    whole = cut.where(F.col("part") == WHOLE).select("path", "first", "record")
    records = whole.unionByName(joined.select("path", "first", "record"))
    return records.withColumn("record", F.regexp_replace("record", r"\r$", "")).where("record <> ''")


def csv_texts(spark: SparkSession, path: str | list[str], names: list[str]) -> DataFrame:
    """All columns as text under ``names``; a file with another header fails the query."""
    cells = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {"quote": '"', "escape": '"', "nullValue": "", "maxCharsPerColumn": "-1"}
    parsed = csv_records(spark, path).select("path", "first", F.from_csv("record", cells, options).alias("cells"))
    header = F.lit(True)
    for i, name in enumerate(names):
        header = header & F.col(f"cells.c{i}").eqNullSafe(F.lit(name))
    other = F.raise_error(F.concat(F.lit("another header in "), F.col("path"))).cast("boolean")
    rows = parsed.where(F.when(F.col("first"), F.when(header, False).otherwise(other)).otherwise(True))
    return rows.select(*[F.col(f"cells.c{i}").alias(name) for i, name in enumerate(names)])
