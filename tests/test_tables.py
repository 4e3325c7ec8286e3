"""Reshape, joins, group means, set operations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featloom import fixed
from featloom.operators import groupfeats, reshape
from featloom.plans import feature_tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_long_then_wide_is_identity(spark):
    wide = spark.createDataFrame(
        [("u", 1.0, 2), ("v", None, 4), ("w", 5.5, None)], "id string, a double, b int"
    )
    long = reshape.to_long(wide, ["id"])
    assert long.count() == 6
    back = reshape.to_wide(long, "id")
    assert rows(back) == rows(wide.withColumn("b", F.col("b").cast("double")))
    assert rows(reshape.to_long(wide, ["id"], ["b"])) == rows(long.where("feat = 'b'"))


def test_duplicate_pair_is_an_error(spark):
    long = spark.createDataFrame(
        [("u", "a", 1.0), ("u", "a", 1.0)], "id string, feat string, value double"
    )
    with pytest.raises(Exception, match="duplicate key: u, a"):
        reshape.to_wide(long, "id", ["a"]).collect()


def test_hundreds_of_features_in_one_shuffle(spark):
    feats = [f"f{i:04d}" for i in range(1034)]
    rng = np.random.default_rng(0)
    keep = rng.random((7, 1034)) < 0.7
    cells = [(u, f, float(u * 10_000 + i)) for u in range(7) for i, f in enumerate(feats) if keep[u, i]]
    rng.shuffle(cells)
    long = spark.createDataFrame([(int(u), f, float(v)) for u, f, v in cells] + [(9, "other", 1.0)], "id long, feat string, value double")
    wide = reshape.to_wide(long.repartition(4), "id", feats)
    assert wide.columns == ["id", *feats]
    found = {r[0]: r[1:] for r in wide.collect()}
    for u in range(7):
        assert found[u] == tuple(u * 10_000.0 + i if keep[u, i] else None for i in range(1034))
    assert found[9] == (None,) * 1034
    text = reshape.to_wide(long, "id", feats)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    twice = long.unionByName(long.where("id = 3 and value = 30005"))
    if keep[3, 5]:
        with pytest.raises(Exception, match="duplicate key: 3, f0005"):
            reshape.to_wide(twice, "id", feats).collect()


def test_wide_of_null_keys_features_and_values(spark):
    long = spark.createDataFrame(
        [(None, "a", 1), ("u", None, 2), ("v", "b", None), ("v", "a", 3)], "id string, feat string, value int"
    )
    wide = reshape.to_wide(long, "id")
    assert wide.columns == ["id", "a", "b"] and wide.schema["a"].dataType.simpleString() == "int"
    assert rows(wide) == rows(spark.createDataFrame([(None, 1, None), ("u", None, None), ("v", 3, None)], "id string, a int, b int"))
    assert reshape.to_wide(long.limit(0), "id", ["a"]).count() == 0
    assert reshape.to_wide(long.limit(0), "id").columns == ["id"]


def test_positional_features_must_be_numeric(spark):
    df = spark.createDataFrame([("u", "m", 1.0, 2)], "user string, msg string, a double, b int")
    assert reshape.features_after(df, 2) == ["a", "b"]
    with pytest.raises(TypeError, match="msg"):
        reshape.features_after(df, 1)


def test_drop_incomplete_counts_nan(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "x"), (2, float("nan"), "x"), (3, 1.0, None)], "id int, a double, s string"
    )
    assert [r.id for r in reshape.drop_incomplete(df).collect()] == [1]


def test_vector_forms(spark):
    df = spark.createDataFrame([(1, [0.5, 1.5])], "id int, embedding array<float>")
    wide = reshape.vec_to_cols(df, ["id"], "embedding")
    assert wide.columns == ["id", "f0000", "f0001"]
    assert rows(reshape.cols_to_vec(wide, ["id"], ["f0000", "f0001"])) == rows(df)
    assert rows(reshape.vec_to_long(df, ["id"], "embedding")) == [
        (1, "f0000", 0.5), (1, "f0001", 1.5)
    ]
    assert reshape.longest_name(wide, ["id"]) == 5


def test_outcomes_are_taken_by_name(spark):
    names = list(reversed(fixed.OUTCOMES))
    df = spark.createDataFrame([(1, *range(10))], ["id", *names])
    assert reshape.outcome_vector(df, ["id"]).first().outcomes == list(range(9, -1, -1))


SEGMENTS = [("u", 1), ("u", 2), ("v", 3), ("w", None), ("x", 9)]
FEATS = [
    (1, [1.0, 10.0, float("nan")]),
    (2, [3.0, None, 5.0]),
    (2, [5.0, 30.0, 7.0]),
    (3, [7.0, 8.0, float("nan")]),
    (None, [100.0, 100.0, 100.0]),
]


def tables(spark):
    segments = spark.createDataFrame(SEGMENTS, "user_id string, message_id int")
    feats = spark.createDataFrame(FEATS, "message_id int, embedding array<double>")
    return segments, feats


def values(long):
    return {(r.group_id, r.feat): r.value for r in long.collect()}


def test_group_mean_edges(spark):
    long = groupfeats.group_mean(*tables(spark))
    assert long.columns == ["group_id", "feat", "value", "group_norm"]
    got = values(long)
    assert got == {
        # the feature row of message 2 is there twice, and counts twice
        ("u", "f0000"): 3.0, ("u", "f0001"): 20.0, ("u", "f0002"): 6.0,
        ("v", "f0000"): 7.0, ("v", "f0001"): 8.0, ("v", "f0002"): None,
        # unmatched users keep their rows; a null key matches nothing
        **{(g, f): None for g in "wx" for f in ("f0000", "f0001", "f0002")},
    }
    assert long.where("not (value <=> group_norm)").count() == 0


def test_group_mean_null_safe_and_selected(spark):
    segments, feats = tables(spark)
    got = values(groupfeats.group_mean(segments, feats, null_safe=True, feats_only=["f0001"]))
    assert got == {("u", "f0001"): 20.0, ("v", "f0001"): 8.0, ("w", "f0001"): 100.0,
                   ("x", "f0001"): None}
    with pytest.raises(ValueError, match="f0003"):
        groupfeats.group_mean(segments, feats, feats_only=["f0003"])


def test_group_mean_of_wide_table_and_int_ids(spark):
    segments = spark.createDataFrame([("7", "m1"), ("7", "m2")], "user_id string, message_id string")
    wide = spark.createDataFrame([("m1", 1.0, 2.0), ("m2", 3.0, None)],
                                 "message_id string, f0000 double, f0001 double")
    long = feature_tables.user_feature_table(segments, wide, id_type="int")
    assert dict(long.dtypes)["group_id"] == "int"
    assert values(long) == {(7, "f0000"): 2.0, (7, "f0001"): 2.0}


def test_group_mean_of_a_hot_user_and_ragged_chunks(spark):
    rng = np.random.default_rng(4)
    users = np.where(rng.random(900) < 0.4, 0, rng.integers(0, 30, 900))
    x = rng.normal(size=(900, 70))
    segments = spark.createDataFrame(
        [(int(u), i) for i, u in enumerate(users)], "user_id int, message_id int"
    )
    feats = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(x)], "message_id int, embedding array<double>"
    ).repartition(5)
    got = values(groupfeats.group_mean(segments, feats))
    assert len(got) == 70 * len(set(users))
    for u in set(users.tolist()):
        mean = x[users == u].mean(axis=0)
        assert np.allclose([got[(u, f"f{i:04d}")] for i in range(70)], mean, atol=1e-12)


def test_cohort_and_long_cohort_table(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "message_id int, f0000 double")
    b = spark.createDataFrame([(3, 0.3)], "message_id int, f0000 double")
    ids = spark.createDataFrame([(2,), (3,), (3,), (8,)], "message_id int")
    got = feature_tables.cohort_feature_table({"a": a, "b": b}, ids)
    assert rows(got) == [(2, "f0000", 0.2, 0.2), (3, "f0000", 0.3, 0.3)]


def test_common_ids(spark):
    def frame(ids):
        return spark.createDataFrame([(i,) for i in ids], "user_id int")

    frames = [frame([1, 2, 2, 3, None]), frame([2, 3, 3, 4, None]), frame([3, 2, 5, None])]
    assert rows(groupfeats.common_ids(frames)) == [(2,), (3,)]
    assert [f.count() for f in groupfeats.keep_common(frames)] == [3, 3, 2]


def test_tagged_union_aligns_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "id int, s string")
    b = spark.createDataFrame([("y", 2, 0.5)], "s string, id int, extra double")
    got = groupfeats.tagged_union({"a": a, "b": b})
    assert rows(got.select("dataset_name", "id", "s", "extra")) == [
        ("a", 1, "x", None), ("b", 2, "y", 0.5)
    ]


def test_last_per_key_keeps_the_whole_row(spark):
    df = spark.createDataFrame(
        [("a", "a.wav", [1.0]), ("a", "a.mp3", [2.0]), ("b", "b.WAV", None)],
        "stem string, path string, v array<double>",
    )
    assert rows(groupfeats.last_per_key(df, "stem", "path")) == [
        ("a", "a.wav", [1.0]), ("b", "b.WAV", None)
    ]


def test_frame_to_long_drops_incomplete_rows(spark):
    df = spark.createDataFrame([("04", 1, 2.5), ("05", None, 1.0)], "g string, a int, b double")
    got = feature_tables.frame_to_long(df, "g")
    assert rows(got) == [("04", "a", 1.0, 1.0), ("04", "b", 2.5, 2.5)]
