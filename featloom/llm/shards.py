"""Shards by balanced label propagation.

Documents start in shards by the hash of their id. In each round every linked document counts, by a join
of the links with the labels as they are now, how many of its neighbours are in each shard. One that has
more in another shard than in its own asks to move there. Of neighbours that ask, the one with the most to
gain may move, so that moves do not undo each other and every round cuts fewer links than the one before.
A shard admits as many as it has room for, largest gains first: its equal share of all documents, less
the linked ones it has. Full shards swap documents one for one. The rounds end when nothing moves.

Links are given as pairs, or by group: rows with the same non-null group value. A group is linked as a
star of stars: its members in up to ``SALTS`` parts, each around its first member, and these around the
first of all, so a group with a third of all rows has as many links as rows and no very large star.

Every two members of a group are alike, which its stars do not say. So at the end a group that lies in
several shards goes to the one most of its rows are in among those that have room for all of it: groups ask
with the votes that the propagation left, large ones first, until no group is left. A group that no shard
has room for fills shards one after another under the same quota; the pairs this cuts are logged. Unlinked
documents then fill the shards, so that the counts of two shards differ by one at most.

Votes of groups are sums by group and shard, ``shards`` numbers a group, so a group with a third of all
rows is summed before it is shuffled. What is open never exceeds the room left, so fewer than ``shards``
groups at a time find no room, and only these come to the driver. The labels of large groups, a bounded
number, are broadcast to the rows; the join that carries the others is an ordinary one. Ranks are row
numbers inside hash buckets plus bucket offsets: no shard is sorted in one task.

A null id counts as an id like any other, and repeated rows each get a slot. An empty table gives an
empty result. Columns of the input that are called like results are replaced.
"""

from __future__ import annotations

import logging
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint

SHARDS = 8
BUCKETS = 512
#: Stars of a group at most.
SALTS = 256
#: Links, both ways, for each task of a round.
TASK_LINKS = 20_000

_log = logging.getLogger(__name__)


def with_rank(df: DataFrame, part: str, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Rank from 0 within ``part`` by bucket, then order; ``bucket`` takes at most a few thousand values."""
    df = df.withColumn("__bucket", bucket)
    # At most parts x buckets rows.
    counts = df.groupBy(part, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(part).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(part), "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy(part, "__bucket").orderBy(*order)
    return (
        df.withColumn("__at", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), [part, "__bucket"])
        .withColumn(name, (F.col("__before") + F.col("__at")).cast("long"))
        .drop("__bucket", "__before", "__at")
    )


def _hash(*columns) -> Column:
    return F.xxhash64(*columns)


def _order() -> list[Column]:
    return [F.col("__group_hash"), F.col("__id_hash"), F.col("__size"), F.col("__crc")]


def _bucket() -> Column:
    """Unlinked rows first; a group's rows share a bucket unless the group is large."""
    spread = F.when(F.col("__big"), _hash("__id_hash")).otherwise(F.col("__group_hash"))
    return F.when(F.col("__linked"), BUCKETS).otherwise(0) + F.pmod(
        F.when(F.col("__linked"), spread).otherwise(F.col("__id_hash")), F.lit(BUCKETS)
    )


def star_links(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(a, b): the links of the rows (node, group), a star of stars for each group."""
    salted = rows.select("node", "group", F.pmod(_hash("node"), F.lit(salts)).alias("salt"))
    centres = checkpoint(salted.groupBy("group", "salt").agg(F.min("node").alias("centre")))
    hubs = centres.groupBy("group").agg(F.min("centre").alias("hub"))
    return (
        salted.join(centres, ["group", "salt"])
        .select(F.col("node").alias("a"), F.col("centre").alias("b"))
        .unionByName(centres.join(hubs, "group").select(F.col("centre").alias("a"), F.col("hub").alias("b")))
        .where("a <> b")
    )


def _wishes(links: DataFrame, labels: DataFrame, open_: list[bool]) -> DataFrame:
    """(node, label, degree, here, target, gain, h) of every linked node; ``here``: neighbours in its own shard.

    The target is the shard with the most neighbours among the open ones and its own, by a hash of node
    and shard among equal ones.
    """
    shards = len(open_)
    near = links.join(labels.select(F.col("node").alias("b"), F.col("label").alias("of")), "b")
    votes = near.groupBy("a").agg(F.array(*[F.count_if(F.col("of") == s) for s in range(shards)]).alias("votes"))
    known = labels.join(votes, F.col("node") == F.col("a")).withColumn("here", F.col("votes")[F.col("label")])
    choices = [
        F.when(
            F.lit(open_[s]) | (F.col("label") == s),
            F.struct(F.col("votes")[s], (F.col("label") == s).alias("own"), F.xxhash64("node", F.lit(s)), F.lit(s).alias("s")),
        )
        for s in range(shards)
    ]
    best = F.array_max(F.array(*choices))["s"]
    return known.select(
        "node", "label", F.aggregate("votes", F.lit(0).cast("long"), lambda x, y: x + y).alias("degree"), "here",
        best.alias("target"), (F.col("votes")[best] - F.col("here")).alias("gain"), F.xxhash64(F.lit(3), "node").alias("h"),
    )


def _admitted(asked: list[list[int]], free: list[int]) -> list[list[int]]:
    """How many may move from each shard to each other: swaps one for one, then what the room allows."""
    shards, room = len(free), [max(n, 0) for n in free]
    out = [[min(asked[i][j], asked[j][i]) for j in range(shards)] for i in range(shards)]
    for j in range(shards):
        for i in range(shards):
            more = min(asked[i][j] - out[i][j], room[j])
            out[i][j] += more
            room[j] -= more
    return out


def propagate_labels(labels: DataFrame, links: DataFrame, share: list[int]) -> tuple[DataFrame, list[int]]:
    """(labels of all nodes in the end, links cut before each round and in the end).

    ``labels``: node and label, of linked nodes at least; ``links``: pairs of nodes a and b; ``share``: the
    most nodes of each shard. A shard that has more to begin with admits none until it has fewer.
    """
    shards = len(share)
    both = links.where("a <> b")
    both = checkpoint(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    tasks = 1 + both.count() // TASK_LINKS

    def written(df: DataFrame) -> DataFrame:
        """Rows of a round, in as many files as the links are worth."""
        return checkpoint(df.coalesce(tasks))

    labels, cuts, swap, blocked = written(labels.select("node", "label")), [], False, None
    free = list(share)
    for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect():
        free[r["label"]] -= r["n"]
    while True:
        # In turns: to shards with room, then, if none of that is left to do, by swaps.
        wishes = written(_wishes(both, labels, [swap or n > 0 for n in free]))
        cut = wishes.agg(F.sum(F.col("degree") - F.col("here"))).first()[0] or 0
        cuts.append(cut // 2)
        wants = wishes.where("gain > 0")
        if blocked is not None:
            wants = wants.join(blocked, "node", "left_anti")
        rank = F.struct("gain", "h", "node")
        rivals = (
            both.join(wants.select(F.col("node").alias("b"), rank.alias("r")), "b")
            .groupBy("a")
            .agg(F.max("r").alias("rival"))
        )
        movers = written(
            wants.join(rivals, F.col("node") == F.col("a"), "left")
            .where(F.col("rival").isNull() | (rank > F.col("rival")))
            .select("node", "label", "target", "gain", "h", (F.col("label") * shards + F.col("target")).alias("pair"))
        )
        asked = [[0] * shards for _ in range(shards)]
        for r in movers.groupBy("label", "target").agg(F.count("*").alias("n")).collect():
            asked[r["label"]][r["target"]] = r["n"]
        may = _admitted(asked, free)
        moved = sum(map(sum, may))
        if not moved:
            if swap and not sum(map(sum, asked)):
                return labels, cuts
            if swap:  # those that nobody makes room for let their neighbours ask
                mine = movers.select("node")
                blocked = mine if blocked is None else written(blocked.unionByName(mine))
            swap, cuts = True, cuts[:-1]
            continue
        swap, blocked = False, None
        go = movers
        if may != asked:
            # Larger gains first, by powers of two.
            bucket = -BUCKETS * F.floor(F.log2("gain")) + F.pmod("h", F.lit(BUCKETS))
            order = [F.col("gain").desc(), F.col("h"), F.col("node")]
            limit = F.array(*[F.lit(n) for row in may for n in row])[F.col("pair")]
            go = with_rank(movers, "pair", bucket, order, "rank").where(F.col("rank") < limit)
        new = go.select("node", F.col("target").alias("new"))
        labels = written(labels.join(new, "node", "left").select("node", F.coalesce("new", "label").alias("label")))
        free = [n + sum(may[s]) - sum(row[s] for row in may) for s, n in enumerate(free)]
        _log.info("%d links cut, %d documents move", cuts[-1], moved)


def _round(groups: DataFrame, free: list[int]) -> DataFrame:
    """One round of open groups: ``__label`` is the shard that admits the whole group, or null."""
    # Most votes, then a hash, so that ties spread over the shards.
    choices = [
        F.when(
            F.col("__members") <= n,
            F.struct(F.col("__votes")[s], F.xxhash64("__group_hash", F.lit(s)), F.lit(s).alias("s")),
        )
        for s, n in enumerate(free)
    ]
    # Large groups first, by powers of two: an overfull shard loses a third of its room or more.
    asked = groups.withColumns({
        "__target": F.array_max(F.array(*choices))["s"],
        "__bucket": -BUCKETS * F.floor(F.log2("__members"))
        + F.pmod(_hash("__group_hash"), F.lit(BUCKETS)),
    })
    # At most shards x buckets x powers of two rows.
    sums = asked.groupBy("__target", "__bucket").agg(F.sum("__members").alias("__n"))
    before = Window.partitionBy("__target").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.where("__target IS NOT NULL").select(
        "__target", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy("__target", "__bucket").orderBy("__group_hash")
    upto = F.sum("__members").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    room = F.array(*map(F.lit, free))[F.col("__target")]
    return (
        asked.withColumn("__upto", upto)
        .join(F.broadcast(offsets), ["__target", "__bucket"], "left")
        .select(
            *groups.columns,
            F.when(F.col("__before") + F.col("__upto") <= room, F.col("__target")).alias("__label"),
        )
    )


def _fill(members: int, votes: list[int], free: list[int]) -> list[tuple[int, int]]:
    """(rows, shard) of a group that no shard can hold: the emptiest shards first, what is left of it
    where it fits best; ``free`` is lowered."""
    pieces = []
    while members:
        fits = [s for s, n in enumerate(free) if n >= members]
        if fits:
            s = min(fits, key=lambda s: (free[s], -votes[s], s))
        else:
            s = max(range(len(free)), key=lambda s: (free[s], votes[s], -s))
        n = min(members, free[s])
        pieces.append((n, s))
        free[s] -= n
        members -= n
    return pieces


def _labels(groups: DataFrame, free: list[int]) -> tuple[DataFrame, dict[int, list[tuple[int, int]]]]:
    """(labels of the groups that one shard holds, pieces of the others), once no group is open.

    ``free``: the rows each shard has room for, as many as the groups have at least.
    """
    whole, pieces, free = [], {}, list(free)
    while True:
        stuck = groups.where(F.col("__members") > max(free)).collect()  # fewer than shards
        for g in sorted(stuck, key=lambda g: (-g["__members"], g["__group_hash"])):
            pieces[g["__group_hash"]] = _fill(g["__members"], g["__votes"], free)
        if stuck:
            groups = groups.where(~F.col("__group_hash").isin([g["__group_hash"] for g in stuck]))
        judged = checkpoint(_round(groups, free))
        whole.append(judged.where("__label IS NOT NULL"))
        counts = judged.groupBy("__label").agg(F.sum("__members").alias("n")).collect()
        for c in counts:
            if c["__label"] is not None:
                free[c["__label"]] -= c.n
        if all(c["__label"] is not None for c in counts):
            return reduce(DataFrame.unionByName, whole), pieces
        groups = judged.where("__label IS NULL").drop("__label")


def cut_pairs(pieces: dict[int, list[tuple[int, int]]]) -> int:
    """Pairs of linked rows in different shards."""
    of = lambda n: n * (n - 1) // 2
    return sum(of(sum(n for n, _ in p)) - sum(of(n) for n, _ in p) for p in pieces.values())


def _place(base: DataFrame, total: int, shards: int) -> DataFrame:
    """The rows with their group's shard, and whether they are linked and their group is large."""
    votes = [F.count_if(F.col("__shard") == s) for s in range(shards)]
    groups = checkpoint(
        base.where("__group_hash IS NOT NULL")
        .groupBy("__group_hash")
        .agg(F.count("*").alias("__members"), F.array(*votes).alias("__votes"))
        .where("__members > 1")
    )
    free = [total // shards + (s < total % shards) for s in range(shards)]
    labels, pieces = _labels(groups, free)
    _log.info("%d groups split, %d pairs of linked rows cut", len(pieces), cut_pairs(pieces))
    # At most 4 x buckets groups are large.
    large = F.col("__members") > 64 + total // (4 * BUCKETS)
    some = labels.select("__group_hash", "__label", large.alias("__large"))
    hot = F.broadcast(some.where("__large").select("__group_hash", F.col("__label").alias("__hot")))
    rows = base.withColumn("__split", F.coalesce(F.col("__group_hash").isin(list(pieces)), F.lit(False)))
    rest = rows.where("NOT __split").join(hot, "__group_hash", "left")
    parts = [
        rest.where("__hot IS NOT NULL").withColumn("__label", F.col("__hot")).withColumn("__big", F.lit(True)),
        rest.where("__hot IS NULL")
        .join(some.where("NOT __large").drop("__large"), "__group_hash", "left")
        .withColumn("__big", F.lit(False)),
    ]
    if pieces:
        ranked = with_rank(
            rows.where("__split"), "__group_hash", F.pmod("__id_hash", F.lit(BUCKETS)),
            [F.col("__id_hash"), *_order()], "__rank",
        )
        cases = []
        for group, filled in pieces.items():
            ends = accumulate(n for n, _ in filled)
            cases += [
                F.when((F.col("__group_hash") == group) & (F.col("__rank") < end), F.lit(s))
                for end, (_, s) in zip(ends, filled, strict=True)
            ]
        place = F.coalesce(*cases)
        parts.append(ranked.withColumns({"__label": place, "__big": F.lit(True)}))
    return reduce(
        DataFrame.unionByName,
        [
            p.select(
                "__id", "__size", "__crc", "__id_hash", "__group_hash",
                F.col("__label").isNotNull().alias("__linked"),
                "__big",
                F.coalesce("__label", "__shard").alias("__shard"),
            )
            for p in parts
        ],
    )


def _settle(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """Rows past a shard's share, unlinked ones first to leave, fill the gaps of the others."""
    share = F.lit(total // shards) + (F.col("__shard") < total % shards).cast("int")
    counts = rows.groupBy("__shard").agg(F.count("*").alias("n"))
    # One row a shard.
    every = rows.sparkSession.range(shards).select(F.col("id").cast("int").alias("__shard"))
    state = every.join(counts, "__shard", "left").select(
        "__shard", (F.coalesce("n", F.lit(0)) - share).alias("over")
    )
    by_shard = Window.orderBy("__shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gaps = state.withColumn("room", F.greatest(-F.col("over"), F.lit(0))).select(
        F.col("__shard").alias("__new"),
        F.sum("room").over(by_shard).alias("upto"),
        "room",
    )
    gaps = gaps.where("room > 0").select("__new", "upto", (F.col("upto") - F.col("room")).alias("from"))
    spare = state.where("over > 0").withColumn("past", F.sum("over").over(by_shard) - F.col("over"))
    ranked = with_rank(rows, "__shard", _bucket(), _order(), "__rank").join(
        F.broadcast(spare), "__shard", "left"
    )
    place = F.when(F.col("__rank") < F.col("over"), F.col("past") + F.col("__rank"))
    all_gaps = gaps.agg(F.collect_list(F.struct("__new", "from", "upto"))).scalar()
    return (
        ranked.withColumns({"__place": place, "__gaps": all_gaps})
        .withColumn(
            "__gap",
            F.get(
                F.filter(
                    "__gaps", lambda g: (F.col("__place") >= g["from"]) & (F.col("__place") < g["upto"])
                ),
                F.lit(0),
            ),
        )
        .withColumn("__shard", F.coalesce("__gap.__new", "__shard"))
        .select(rows.columns)
    )


def propagate(
    df: DataFrame, id_col: str, size: Column, crc: Column, group: Column,
    shards: int = SHARDS,
) -> DataFrame:
    """Columns id, size, text_crc32, shard and slot (gapless from 0 in each shard).

    ``group``: a 64-bit number or null; rows that share it are linked.
    """
    start = checkpoint(
        df.select(
            F.col(id_col).alias("__id"),
            F.coalesce(size, F.lit(0)).cast("long").alias("__size"),
            crc.cast("long").alias("__crc"),
            _hash(F.lit(17), F.col(id_col)).alias("__id_hash"),
            group.alias("__group_hash"),
        ).withColumn(
            "__shard", F.pmod(_hash(F.lit(29), F.col("__id_hash")), F.lit(shards)).cast("int")
        )
    )
    total = start.count()
    # Named by content, so that no result depends on partitions; equal rows are one node.
    named = start.withColumn("node", _hash("__id_hash", "__group_hash", "__size", "__crc"))
    nodes = named.where("__group_hash IS NOT NULL").select("node", F.col("__group_hash").alias("group"), "__shard").distinct()
    links = checkpoint(star_links(nodes))
    linked = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = nodes.join(linked, "node", "left_semi").select("node", F.col("__shard").alias("label"))
    labels, cuts = propagate_labels(own, links, [total // shards + (s < total % shards) for s in range(shards)])
    _log.info("links cut by round: %s", cuts)
    base = checkpoint(
        named.join(labels, "node", "left")
        .withColumn("__shard", F.coalesce("label", "__shard"))
        .select(start.columns)
    )
    rows = checkpoint(_place(base, total, shards))
    rows = checkpoint(_settle(rows, total, shards))
    slotted = with_rank(rows, "__shard", F.pmod("__id_hash", F.lit(BUCKETS)), [F.col("__id_hash"), *_order()], "slot")
    return slotted.select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.col("__shard").alias("shard"),
        "slot",
    )
