import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from featloom.operators import curve
from featloom.sinks import tables


def files_with(path, column, value):
    """Files whose statistics admit the value, and all files."""
    names = glob.glob(f"{path}/*.parquet")
    hit = 0
    for name in names:
        meta = pq.ParquetFile(name).metadata
        at = [meta.schema.column(i).name for i in range(len(meta.schema))].index(column)
        stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        hit += any(s.min <= value <= s.max for s in stats if s.has_min_max)
    return hit, len(names)


def long_table(spark, users=400, feats=60):
    return spark.range(users).crossJoin(spark.range(feats).withColumnRenamed("id", "f")).select(
        F.format_string("u%05d", F.col("id")).alias("group_id"),
        F.format_string("f%04d", F.col("f")).alias("feat"),
        (F.col("id") * 1.0 + F.col("f")).alias("value"),
        F.lit(0.0).alias("group_norm"),
    )


def test_lookups_by_either_key_read_few_files(spark, tmp_path):
    long = long_table(spark)
    tables.write_long(long, str(tmp_path / "curve"), files=64)
    by_feat = [files_with(tmp_path / "curve", "feat", f"f{i:04d}") for i in range(0, 60, 7)]
    by_group = [files_with(tmp_path / "curve", "group_id", f"u{i:05d}") for i in range(0, 400, 37)]
    assert all(n >= 60 for _, n in by_feat)
    assert max(hit for hit, _ in by_feat + by_group) <= 16
    # For comparison: sorted by feature alone, a group is in every file.
    by = ["feat", "group_id"]
    long.repartitionByRange(64, *by).sortWithinPartitions(*by).write.parquet(str(tmp_path / "sorted"))
    hit, n = files_with(tmp_path / "sorted", "group_id", "u00111")
    assert hit >= 0.9 * n
    back = spark.read.parquet(str(tmp_path / "curve"))
    assert back.count() == long.count() and back.exceptAll(long).count() == 0


def test_a_hot_feature_and_a_hot_group_span_files(spark, tmp_path):
    hot = spark.range(4000).select(
        F.format_string("u%05d", F.col("id") % 900).alias("group_id"), F.lit("f0001").alias("feat"),
        F.col("id").cast("double").alias("value"), F.lit(None).cast("double").alias("group_norm"),
    )
    one = hot.withColumn("group_id", F.lit("u00000")).withColumn("feat", F.format_string("f%04d", F.col("value").cast("int") % 50))
    rows = long_table(spark, 100, 20).unionByName(hot).unionByName(one)
    tables.write_long(rows, str(tmp_path / "t"), files=32)
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{tmp_path}/t/*.parquet")]
    assert sum(sizes) == rows.count() and max(sizes) < 3 * sum(sizes) / 32


def test_copies_of_one_row_and_nulls(spark, tmp_path):
    rows = spark.createDataFrame(
        [("u", "f", 1.0, 1.0)] * 300 + [(None, None, None, None), ("a", "b", None, None)],
        "group_id string, feat string, value double, group_norm double",
    )
    tables.write_long(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 302
    tables.write_long(rows.limit(0), str(tmp_path / "none"))
    assert spark.read.schema(rows.schema).parquet(str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("kind", ["string", "long"])
def test_codes_follow_the_order_of_keys(spark, kind):
    df = spark.range(5000).select(F.pmod(F.col("id") * 7919, F.lit(997)).cast(kind).alias("k"))
    bounds = curve.range_bounds(df, ["k"], bits=4)["k"]
    assert len(bounds) == 15 and bounds == sorted(bounds)
    rows = df.distinct().select("k", curve.rank_code(F.col("k"), bounds, 4).alias("c")).collect()
    for r in rows:
        assert r.c == sum(b < r.k for b in bounds)
    few = bounds[3:7]
    assert {r.c for r in df.select(curve.rank_code(F.col("k"), few, 4).alias("c")).distinct().collect()} == {0, 3, 6, 9, 12}
    sizes = df.groupBy(curve.rank_code(F.col("k"), bounds, 4)).count().collect()
    assert len(sizes) == 16 and max(r["count"] for r in sizes) < 2 * 5000 / 16


def test_a_sample_gives_bounds_near_those_of_all_rows(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"))
    bounds = curve.range_bounds(df, ["k"], bits=2, sample=2000)["k"]
    assert [abs(b - x) < 1000 for b, x in zip(bounds, (5000, 10_000, 15_000), strict=True)] == [True] * 3


def test_neighbours_on_the_curve_are_neighbours_in_the_plane(spark):
    pairs = [(a, b) for a in range(16) for b in range(16)]
    place = curve.curve_place(F.col("a"), F.col("b"), 4).alias("d")
    rows = spark.createDataFrame(pairs, "a int, b int").select("a", "b", place).orderBy("d").collect()
    assert [r.d for r in rows] == list(range(256))
    assert all(abs(r.a - s.a) + abs(r.b - s.b) == 1 for r, s in zip(rows, rows[1:]))
