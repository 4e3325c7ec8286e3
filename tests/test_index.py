import pytest
from pyspark.sql import functions as F

from featloom.operators import index


def table(spark, n, parts=4):
    return spark.range(n, numPartitions=parts).select("id", (F.col("id") * 3).alias("x"))


def split(df, **options):
    return {r.id: r.split for r in index.exact_split(df, 0.8, **options).collect()}


@pytest.mark.parametrize("n", [1, 2, 5, 7, 10, 999])
def test_split_is_exact_and_disjoint(spark, n):
    tags = split(table(spark, n), key=["id"], seed=1)
    assert len(tags) == n
    assert sum(t == "train" for t in tags.values()) == int(0.8 * n)


def test_split_of_nothing_and_extremes(spark):
    assert split(table(spark, 0)) == {}
    ten = table(spark, 10)
    for fraction, want in ((0.0, 0), (1.0, 10)):
        got = index.exact_split(ten, fraction).where("split = 'train'").count()
        assert got == want


def test_split_is_stable_and_seeded(spark):
    df = table(spark, 500)
    first = split(df, seed=3)
    assert first == split(df.repartition(13), seed=3)
    assert first == split(df.orderBy(F.desc("id")).coalesce(1), seed=3)
    assert first != split(df, seed=4)


def test_split_cuts_through_one_hot_key(spark):
    """A third of the rows, then all of them, share the key the cut falls on."""
    for hot in (3, 1):
        df = table(spark, 300).withColumn("k", F.when(F.col("id") % hot == 0, -1).otherwise(F.col("id")))
        out = index.exact_split(df, 0.5, key=["k"], seed=2)
        assert out.where("split = 'train'").count() == 150
        assert out.select("id").distinct().count() == 300


def test_split_of_identical_rows(spark):
    df = spark.range(90).select(F.lit(1).alias("a"))
    out = index.exact_split(df, 0.8)
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {
        "train": 72, "validation": 18
    }


def numbers(df, **options):
    return sorted(r.idx for r in index.dense_index(df, **options).collect())


def test_dense_index(spark):
    df = table(spark, 1000)
    assert numbers(df) == list(range(1000))
    a = {r.id: r.idx for r in index.dense_index(df, seed=5).collect()}
    b = {r.id: r.idx for r in index.dense_index(df.repartition(7), seed=5).collect()}
    assert a == b
    assert [k for k, _ in sorted(a.items(), key=lambda p: p[1])] != list(range(1000))


def test_dense_index_with_a_crowd_of_copies(spark, monkeypatch):
    monkeypatch.setattr(index, "COPY_BLOCK", 16)
    df = table(spark, 400).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("id"), F.lit("s").alias("t")
    )
    keyed = df.withColumn("_bucket", F.shiftright(index.hash_key(["id", "t"]), 16))
    assert not index._is_even(keyed)
    out = index.dense_index(df)
    assert out.columns == ["id", "t", "idx"]
    rows = out.collect()
    assert sorted(r.idx for r in rows) == list(range(400))
    copies = sorted(r.idx for r in rows if r.id == -1)
    assert copies == list(range(copies[0], copies[0] + 134))


def test_dense_index_follows_the_shuffle_key(spark):
    df = table(spark, 100)
    out = index.dense_index(df, F.expr("4294967295 - id * 40000000")).collect()
    assert all(r.idx == 99 - r.id for r in out)


def test_batches(spark):
    out = index.assign_batches(table(spark, 103), 10, seed=1)
    sizes = sorted(r["count"] for r in out.groupBy("batch_id").count().collect())
    assert sizes == [3] + [10] * 10
    assert {r.batch_id for r in out.collect()} == set(range(11))


def test_array_columns_and_shuffle(spark):
    df = table(spark, 50).withColumn("v", F.array("x", "id"))
    assert numbers(df) == list(range(50))
    a = [r.id for r in index.shuffled(df, ["id"], 1).collect()]
    assert a == [r.id for r in index.shuffled(df.repartition(3), ["id"], 1).collect()]
    assert sorted(a) == list(range(50)) and a != sorted(a)
