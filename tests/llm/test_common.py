import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featloom.llm.common import blocks, bounded_sample, flat, held, held_out


def test_sample_is_the_rows_of_least_hash(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    hashed = F.xxhash64(F.col("k").cast("string"), "k")
    want = [r.k for r in df.orderBy(hashed).limit(300).collect()]
    assert sorted(r.k for r in bounded_sample(df, "k", 300).collect()) == sorted(want)
    assert bounded_sample(df, "k", 9000).count() == 5000
    assert bounded_sample(df.limit(0), "k", 10).count() == 0


@pytest.mark.parametrize("key", [None, 1, 2, 3, 4, 5, 6, 7])
def test_sample_of_rows_with_one_key(spark, key):
    df = spark.range(5000).select(F.lit(key).cast("long").alias("k"), F.col("id").alias("v")).repartition(3)
    assert bounded_sample(df, "k", 1000).count() == 1000


@pytest.mark.parametrize("v", range(6))
def test_copies_do_not_take_the_room_of_other_rows(spark, v):
    rows = [(v, "hot")] * 4000 + [(i, "rare") for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(5)
    sample = bounded_sample(df, "k", 600).collect()
    assert len(sample) == 600 == len(set(sample))


def test_held_values_are_made_once():
    made = []
    assert held("of this test", lambda: made.append(1) or "x") == held("of this test", list) == "x"
    assert made == [1]


def test_flat_columns():
    column = pa.array(["ab", None, "", "é"])
    for c in (column, column.slice(1), pa.chunked_array([column.slice(0, 2), column.slice(2)]), pa.array([], pa.string())):
        data, offsets = flat(c)
        texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert texts == [x or "" for x in c.to_pylist()]


def test_blocks_hold_whole_rows():
    offsets = np.array([0, 3, 3, 10, 11, 12, 40])
    assert list(blocks(offsets, 5)) == [(0, 2), (2, 3), (3, 5), (5, 6)]
    assert list(blocks(np.zeros(1, np.int64), 5)) == []


def test_held_out_by_checksum(spark):
    rows = spark.createDataFrame([(7,), (None,)], "k long").select(held_out(F.col("k"), 5, 0).alias("h")).collect()
    assert [r.h for r in rows][1] is False
