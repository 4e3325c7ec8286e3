"""What the plans must and must not contain, and the paths taken at size."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from featloom.operators import compare, contrastive, groupfeats, prep, sizing
from featloom.sinks import tables
from featloom.workload import REGISTRY
from featloom.workload.views import Views
from tests.oracle import DATA, spark_rows

QUERIES = entry.queries()
FOLDER = f"{DATA}/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_auto_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, no_auto_broadcast, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


BROADCASTS = {  # hinted: statistics, widths and offsets behind a size check, and constants
    "batch_numbers", "hashed_batch_sizes", "encoder_lookup", "padded_sequences",
    "rescaled_outcomes", "token_masks", "training_batches", "shuffled_segments",
    "encoded_distinct_inputs", "truth_wide", "model_comparison",  # hot inputs; column names
}


def test_only_checked_sides_are_broadcast(spark, no_auto_broadcast):
    own = {n: QUERIES[n] for n in REGISTRY}
    found = {n for n, q in own.items() if "BroadcastHashJoin" in plan(q(spark, FOLDER))}
    assert found == BROADCASTS


def test_flagship_reads_only_its_columns(spark, no_auto_broadcast):
    text = plan(QUERIES["user_features"](spark, FOLDER))
    schemas = set(re.findall(r"ReadSchema: (struct<[^ \n]*>)", text))
    assert schemas == {
        "struct<event_id:bigint,user_id:bigint>",
        "struct<user_id:bigint>",
        "struct<vec_id:bigint,embedding:array<float>>",
    }
    assert "partial_avg" in text


def test_comparison_shuffles_each_input_once(spark, no_auto_broadcast):
    df = spark.createDataFrame([(1, "a", 1.0)], "user_id int, feat string, value double")
    sides = [df.withColumn("value", F.col("value") * i) for i in (1, 2, 3)]
    assert plan(compare.align(*sides)).count("Exchange") == 1
    text = plan(compare.paired_ttest(*sides, nan_policy="omit"))
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 2
    text = plan(compare.paired_ttest(*sides))
    assert "Join" not in text and "collect_list" not in text and "Window" not in text
    # Single-row exchanges belong to the count of users, a scalar subquery.
    assert len(set(re.findall(r"Exchange hashpartitioning\((?:user_id|feat)[^)]*\)", text))) >= 2


def test_split_moves_no_rows(spark):
    assert "Exchange" not in plan(QUERIES["exact_split"](spark, FOLDER))


def test_joins_without_broadcast_give_the_same(spark, no_auto_broadcast, monkeypatch):
    names = ["rescaled_outcomes", "padded_sequences", "token_masks"]
    want = {n: spark_rows(QUERIES[n](spark, FOLDER)) for n in names}
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", 0)
    for n in names:
        df = QUERIES[n](spark, FOLDER)
        assert "BroadcastHashJoin" not in plan(df)
        assert spark_rows(df) == want[n]


def test_large_batches_without_broadcast(spark, no_auto_broadcast, monkeypatch):
    pairs = Views(spark, FOLDER).pairs
    want = spark_rows(contrastive.nce(pairs).select("batch_id", F.round("loss", 6).alias("l")))
    monkeypatch.setattr(contrastive, "BLOCK_ROWS", 10)
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", 0)
    df = contrastive.nce(pairs)
    assert "BroadcastHashJoin" not in plan(df) and "Scan ExistingRDD" not in plan(df)
    assert spark_rows(df.select("batch_id", F.round("loss", 6).alias("l"))) == want


def test_bucketed_tables_join_without_a_shuffle(spark, no_auto_broadcast):
    v = Views(spark, FOLDER)
    tables.save_bucketed(v.segments.select("user_id", "message_id"), "b_segments", "message_id", 4)
    tables.save_bucketed(v.feats, "b_feats", "message_id", 4)
    segments, feats = spark.table("b_segments"), spark.table("b_feats")
    joined = groupfeats.attach_features(segments, feats)
    assert "Exchange" not in plan(joined)
    means = groupfeats.group_mean(segments, feats)
    assert "hashpartitioning(message_id" not in plan(means)
    want = groupfeats.group_mean(v.segments, v.feats)
    assert means.exceptAll(want).count() == 0 and means.count() == want.count()


def test_results_do_not_depend_on_partitioning(spark):
    v = Views(spark, FOLDER)
    one = groupfeats.group_mean(v.segments.coalesce(1), v.feats)
    many = groupfeats.group_mean(v.segments.repartition(17), v.feats.repartition(5))
    rounded = [
        spark_rows(d.select("group_id", "feat", F.round("value", 9).alias("v"))) for d in (one, many)
    ]
    assert rounded[0] == rounded[1]
    a = prep.zscore_rescale(v.segments.repartition(9)).select("message_id", F.round("ope", 9).alias("o"))
    b = prep.zscore_rescale(v.segments.coalesce(1)).select("message_id", F.round("ope", 9).alias("o"))
    assert spark_rows(a) == spark_rows(b)


def test_a_hot_join_key_is_split(spark, no_auto_broadcast):
    """A third of the segments share one message: adaptive execution splits its partition."""
    segments = spark.range(300_000).select(
        (F.col("id") % 1000).alias("user_id"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("message_id"),
    ).repartition(16)
    feats = spark.range(5000).select(
        F.col("id").alias("message_id"), F.array(F.col("id") * 0.5, F.lit(1.0)).alias("embedding")
    )
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, value in settings.items():
            spark.conf.set(k, value)
        means = groupfeats.group_mean(segments, feats)
        rows = means.collect()
        assert "skew=true" in plan(means)
    finally:
        for k, value in old.items():
            spark.conf.set(k, value)
    assert len(rows) == 2000
    want = (
        segments.join(feats, "message_id").groupBy("user_id")
        .agg(F.avg(F.col("embedding")[0]).alias("m")).collect()
    )
    got = {r.group_id: r.value for r in rows if r.feat == "f0000"}
    assert all(abs(got[r.user_id] - r.m) < 1e-9 for r in want)
