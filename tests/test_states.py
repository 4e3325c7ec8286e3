"""Group means from mergeable states."""

import pytest
from pyspark.sql import functions as F

from featloom.operators import groupfeats

SEGMENTS = "user_id string, message_id int"
FEATS = "message_id int, embedding array<float>"


def means(df):
    return sorted((repr(r.group_id), r.feat, r.value and round(r.value, 9)) for r in df.collect())


def inputs(spark, n=60):
    users = [None, "hot", "a", "b", "none"]
    rows = [("hot" if i % 3 == 0 else users[i % 4], i % 37) for i in range(n)]
    rows += [("none", 900), ("a", None), ("none", None)]
    feats = [(i, [float(i), None, float("nan") if i % 2 else 0.5] * 12) for i in range(37) if i % 5]
    feats += [(3, [9.0] * 36)]  # a second row of one message
    return spark.createDataFrame(rows, SEGMENTS).repartition(4), spark.createDataFrame(feats, FEATS)


def test_states_give_the_means(spark):
    segments, feats = inputs(spark)
    whole = means(groupfeats.group_mean(segments, feats))
    assert means(groupfeats.means_of_states(groupfeats.group_states(segments, feats))) == whole


@pytest.mark.parametrize("parts", [2, 5])
def test_merged_parts_equal_one_run(spark, parts):
    segments, feats = inputs(spark)
    part = F.pmod(F.hash("user_id", "message_id"), F.lit(parts))
    states = [groupfeats.group_states(segments.where(part == i), feats, dims=36) for i in range(parts)]
    merged = groupfeats.merge_states(states)
    assert means(groupfeats.means_of_states(merged)) == means(groupfeats.group_mean(segments, feats))
    again = groupfeats.merge_states([groupfeats.merge_states(states[:1]), groupfeats.merge_states(states[1:])])
    assert sorted(map(repr, again.collect())) == sorted(map(repr, merged.collect()))


def test_late_features_count_for_pending_segments_only(spark):
    segments = spark.createDataFrame([("u", 1), ("u", 2), ("v", 3)], SEGMENTS)
    first = spark.createDataFrame([(1, [1.0, 1.0])], FEATS)
    states, pending = groupfeats.advance_states(
        groupfeats.group_states(segments.limit(0), first, dims=2), segments.limit(0), segments, first, first.limit(0), dims=2
    )
    assert sorted(r.message_id for r in pending.collect()) == [2, 3]
    late = spark.createDataFrame([(2, [5.0, 7.0]), (1, [100.0, 100.0])], FEATS)
    more = spark.createDataFrame([("w", 1), (None, 4)], SEGMENTS)
    states, pending = groupfeats.advance_states(states, pending, more, first.unionByName(late), late, dims=2)
    found = {(r.group_id, r.feat): r.value for r in groupfeats.means_of_states(states).collect()}
    assert found == {
        ("u", "f0000"): 3.0, ("u", "f0001"): 4.0,  # 1 and the late 5; not the second row of message 1
        ("v", "f0000"): None, ("v", "f0001"): None,
        ("w", "f0000"): 50.5, ("w", "f0001"): 50.5,  # a new segment meets both rows of its message
        (None, "f0000"): None, (None, "f0001"): None,
    }
    assert sorted((str(r.user_id), r.message_id) for r in pending.collect()) == [("None", 4), ("v", 3)]


def test_states_of_other_widths_do_not_merge(spark):
    segments = spark.createDataFrame([("u", 1)], SEGMENTS)
    two, three = (spark.createDataFrame([(1, [1.0] * n)], FEATS) for n in (2, 3))
    states = [groupfeats.group_states(segments, f) for f in (two, three)]
    with pytest.raises(Exception, match="widths differ in group u"):
        groupfeats.means_of_states(groupfeats.merge_states(states)).collect()


def test_no_rows(spark):
    segments, feats = inputs(spark)
    states = groupfeats.group_states(segments.limit(0), feats)
    assert groupfeats.means_of_states(groupfeats.merge_states([states, states])).count() == 0
