"""Per-group features, cohort filters and corpus unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom import fixed
from featloom.functions import text, vectors
from featloom.operators import chunked
from featloom.operators.reshape import with_group_norm
from featloom.operators.sizing import width_of


def attach_features(
    segments: DataFrame,
    feats: DataFrame,
    key: str = "message_id",
    null_safe: bool = False,
    how: str = "left",
) -> DataFrame:
    """Join of segments to features, by default a left join.

    A duplicate feature row multiplies the segment, an unmatched segment keeps
    null features. Null keys match only with ``null_safe``.
    """
    if not null_safe:
        return segments.join(feats, key, how)
    right = feats.withColumnRenamed(key, "_key")
    return segments.join(right, F.col(key).eqNullSafe(F.col("_key")), how).drop("_key")


def group_mean(
    segments: DataFrame,
    feats: DataFrame,
    key: str = "message_id",
    group: str = "user_id",
    vec: str = "embedding",
    null_safe: bool = False,
    feats_only: list[str] | None = None,
    dims: int | None = None,
    id_type: str | None = None,
) -> DataFrame:
    """Mean of every feature over a group's segments, as a long feature table.

    Missing entries are skipped; a group without any match keeps its rows with
    a null value. Only matched segments are joined and aggregated; the distinct
    groups enter the aggregate beside them. ``feats_only`` prunes the vector
    before the join. A vector of another width than ``dims`` fails the query;
    without ``dims`` the sizes are read first.
    """
    dims = dims or width_of(feats, vec)
    vector = vectors.assert_width(F.col(vec), dims)
    name = text.feature_name(F.col("pos").cast("int"))
    if feats_only:
        index = [_position(f, dims) for f in feats_only]
        vector = F.array(*[F.get(vector, F.lit(i)) for i in index])
        name = F.element_at(F.array(*map(F.lit, feats_only)), F.col("pos").cast("int") + 1)
        dims = len(index)
    matched = attach_features(
        segments.select(group, key), feats.select(key, vector.alias(vec)), key, null_safe, "inner"
    ).select(group, vec)
    means = chunked.aggregate_chunks(
        matched,
        [group],
        F.col(vec),
        chunked.MEAN,
        groups=segments.select(group).distinct(),
        width=dims,
    )
    group_id = F.col(group) if id_type is None else F.col(group).cast(id_type)
    long = chunked.positions(means, [group]).select(
        group_id.alias("group_id"), name.alias("feat"), "value"
    )
    return with_group_norm(long)


# Sum and count of a position, NaN counted as missing; both add up over parts of the input.
STATE = (
    "struct(sum(CASE WHEN NOT isnan({x}) THEN cast({x} AS double) END) AS s, "
    "count(CASE WHEN NOT isnan({x}) THEN {x} END) AS n)"
)


def group_states(
    segments: DataFrame,
    feats: DataFrame,
    key: str = "message_id",
    group: str = "user_id",
    vec: str = "embedding",
    null_safe: bool = False,
    dims: int | None = None,
) -> DataFrame:
    """What :func:`group_mean` needs of a part of the segments: sums and counts by chunk of the vector.

    ``group, chunk, width, entries``. A group without a match has chunks of empty sums, so it is kept.
    """
    dims = dims or width_of(feats, vec)
    vector = vectors.assert_width(F.col(vec), dims).alias(vec)
    matched = attach_features(
        segments.select(group, key), feats.select(key, vector), key, null_safe, "inner"
    ).select(group, vec)
    return chunked.aggregate_chunks(
        matched, [group], F.col(vec), STATE, groups=segments.select(group).distinct(), width=dims
    )


def merge_states(states: list[DataFrame], group: str = "user_id") -> DataFrame:
    """The states of all parts together: one aggregate with as many rows as groups have chunks in the parts."""
    both = reduce(DataFrame.unionByName, states)
    cells = ", ".join(
        f"struct(sum(entries[{i}].s) AS s, sum(entries[{i}].n) AS n)" for i in range(chunked.CHUNK)
    )
    wrong = F.raise_error(F.concat(F.lit("widths differ in group "), F.coalesce(F.col(group).cast("string"), F.lit("null"))))
    merged = both.groupBy(group, "chunk").agg(
        F.expr(f"array({cells})").alias("entries"), F.min("width").alias("_least"), F.max("width").alias("width")
    )
    width = F.when(F.col("_least") == F.col("width"), F.col("width")).otherwise(wrong)
    return merged.select(group, "chunk", "entries", width.alias("width"))


def means_of_states(states: DataFrame, group: str = "user_id", id_type: str | None = None) -> DataFrame:
    """The long feature table of :func:`group_mean` from merged states."""
    means = F.transform("entries", lambda e: F.try_divide(e["s"], e["n"]))
    group_id = F.col(group) if id_type is None else F.col(group).cast(id_type)
    long = chunked.positions(states.withColumn("entries", means), [group]).select(
        group_id.alias("group_id"), text.feature_name(F.col("pos").cast("int")).alias("feat"), "value"
    )
    return with_group_norm(long)


def advance_states(
    states: DataFrame,
    pending: DataFrame,
    segments: DataFrame,
    feats: DataFrame,
    new_feats: DataFrame,
    key: str = "message_id",
    group: str = "user_id",
    vec: str = "embedding",
    dims: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(states, pending) after new ``segments`` and ``new_feats``; ``feats`` are all features, new ones among them.

    ``pending`` holds the segments that had no feature yet. A late feature counts for those and is not
    added to a segment that was matched before it came. So only new and pending segments are joined,
    however many there were; write both results, as the next step reads them.
    """
    dims = dims or width_of(feats, vec)
    waiting, fresh = pending.select(group, key), segments.select(group, key)
    parts = [
        states,
        group_states(fresh, feats, key, group, vec, dims=dims),
        group_states(waiting, new_feats, key, group, vec, dims=dims),
    ]
    still = fresh.join(feats.select(key), key, "left_anti").unionByName(
        waiting.join(new_feats.select(key), key, "left_anti")
    )
    return merge_states(parts, group), still.select(group, key)


def _position(feature: str, dims: int) -> int:
    position = int(feature[1:])
    if feature != fixed.FEATURE_FORMAT % position or position >= dims:
        raise ValueError(f"no feature {feature!r} among {dims}")
    return position


def cohort(df: DataFrame, ids: DataFrame, key: str = "message_id") -> DataFrame:
    """Rows whose key is in the id list.

    No hint: Spark broadcasts the list when its size allows and otherwise
    shuffles both sides, splitting a skewed key.
    """
    return df.join(ids.select(key), key, "left_semi")


def common_ids(frames: list[DataFrame], key: str = "user_id") -> DataFrame:
    """Ids present in every frame.

    One union and one map-side-combined aggregate of the frames of each id, at
    most one number per frame, in place of a chain of intersections with a
    shuffle each.
    """
    flagged = [f.select(key, F.lit(i).alias("_in")) for i, f in enumerate(frames)]
    return (
        reduce(DataFrame.unionByName, flagged)
        .where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.size(F.collect_set("_in")).alias("_in"))
        .where(F.col("_in") == len(frames))
        .select(key)
    )


def keep_common(frames: list[DataFrame], key: str = "user_id") -> list[DataFrame]:
    """Every frame filtered to the ids all of them share."""
    ids = common_ids(frames, key)
    return [f.join(ids, key, "left_semi") for f in frames]


def tagged_union(corpora: dict[str, DataFrame], tag: str = "dataset_name") -> DataFrame:
    """Union of corpora by column name, each row tagged with its corpus."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in corpora.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def group_keys(df: DataFrame, key: str) -> DataFrame:
    """Sorted distinct keys."""
    return df.select(key).distinct().orderBy(key)


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` for each key.

    An aggregate rather than a ranked window: it combines map-side, so a key
    with very many rows never gathers in one task.
    """
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(key, "_row.*").select(*df.columns)


def typed_group_id(group: Column, corpus: str) -> Column:
    """Group id in the type its corpus declares."""
    return group.cast(fixed.CORPUS_ID_TYPES[corpus])
