import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from featloom.llm import shards
from tests.llm.helpers import ODD, documents, empty_docs, odd_docs, run
from tests.oracle import DATA


def even(rows, k=8):
    """Counts at most one apart, slots gapless from 0."""
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(k))
    sizes = [len(slots[s]) for s in range(k)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_query(spark):
    folder = f"{DATA}/sf0.01"
    rows = run(spark, "op7_sharding", folder).collect()
    docs = dict(documents(folder))
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    even(rows)
    shard_of = defaultdict(set)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert r.law == "rows" and r.grown_shard is None
        shard_of[docs[r.doc_id]].add(r.shard)
    seen = Counter(docs.values())
    groups = [t for t, n in seen.items() if n > 1]
    assert groups and all(len(shard_of[t]) == 1 for t in groups)


def test_a_group_with_most_rows_is_spread_and_small_ones_stay_whole(spark):
    texts = ["same"] * 500 + [f"t{i // 3}" for i in range(240)] + [f"u{i}" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = shards.propagate(df, "doc_id", F.lit(1), F.crc32("text"), F.xxhash64("text")).collect()
    even(rows)
    found = defaultdict(set)
    for r in rows:
        found[texts[r.doc_id]].add(r.shard)
    whole = [len(s) == 1 for t, s in found.items() if t.startswith("t")]
    assert sum(whole) >= 0.9 * len(whole)
    again = shards.propagate(df.repartition(7), "doc_id", F.lit(1), F.crc32("text"), F.xxhash64("text"))
    assert sorted((r.doc_id, r.shard, r.slot) for r in again.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in rows)


def shards_of(spark, texts):
    """Shards of each text's rows, by count."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = shards.propagate(df, "doc_id", F.lit(1), F.crc32("text"), F.xxhash64("text")).collect()
    even(rows)
    found = defaultdict(Counter)
    for r in rows:
        found[texts[r.doc_id]][r.shard] += 1
    return found


def test_a_group_larger_than_a_shard_fills_shards(spark):
    texts = ["hot"] * 400 + ["warm"] * 190 + [f"t{i // 2}" for i in range(200)] + [f"u{i}" for i in range(410)]
    found = shards_of(spark, texts)
    assert sorted(found["hot"].values()) == [100, 150, 150]
    assert sorted(found["warm"].values()) == [40, 150]
    assert all(len(s) == 1 for t, s in found.items() if t.startswith("t"))


def test_refused_groups_ask_until_they_find_room(spark):
    """All rows are linked: groups are split only where no shard has room for a whole one."""
    texts = [f"g{i}" for i in range(60) for _ in range(2 + i % 13)]
    found = shards_of(spark, texts)
    assert sum(len(s) > 1 for s in found.values()) < 8
    assert sum(len(s) == 1 for s in found.values()) > 52


def test_pieces_are_as_few_as_the_room_allows():
    free = [100, 100, 30, 100]
    assert shards._fill(220, [1, 5, 9, 2], free) == [(100, 1), (100, 3), (20, 2)]
    assert free == [100, 0, 10, 0]
    assert shards.cut_pairs({7: [(3, 0), (2, 1)], 8: [(4, 2)]}) == 6


def test_odd_rows(spark):
    text = F.coalesce("text", F.lit(""))
    rows = shards.propagate(odd_docs(spark), "doc_id", F.octet_length("text"), F.crc32(text), F.xxhash64("text")).collect()
    assert len(rows) == len(ODD)
    even(rows)
    empty = shards.propagate(empty_docs(spark), "doc_id", F.octet_length("text"), F.crc32(text), F.xxhash64("text"))
    assert empty.count() == 0


def hashes(spark, n, k):
    rows = spark.range(n).select(F.col("id").alias("node"), F.xxhash64(F.lit(3), F.col("id")).alias("h"), *[
        F.xxhash64(F.col("id"), F.lit(s)).alias(f"t{s}") for s in range(k)
    ]).collect()
    return {r.node: (r.h, [r[f"t{s}"] for s in range(k)]) for r in rows}


def plain_propagation(labels, links, share, h):
    """The rounds in the plainest way: dictionaries, no ranks, no joins."""
    k, labels = len(share), dict(labels)
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    cuts, swap, blocked = [], False, set()
    while True:
        free = [share[s] - sum(x == s for x in labels.values()) for s in range(k)]
        wants = {}
        for v in near:
            votes = Counter(labels[u] for u in near[v])
            own = labels[v]
            target = max(
                (s for s in range(k) if swap or free[s] > 0 or s == own),
                key=lambda s: (votes[s], s == own, h[v][1][s]),
            )
            if votes[target] > votes[own] and v not in blocked:
                wants[v] = (votes[target] - votes[own], h[v][0], v, target)
        cuts.append(sum(labels[a] != labels[b] for a in near for b in near[a]) // 2)
        movers = [w for v, w in wants.items() if all(wants[u][:3] < w[:3] for u in near[v] if u in wants)]
        asked = [[sum(labels[w[2]] == i and w[3] == j for w in movers) for j in range(k)] for i in range(k)]
        may = shards._admitted(asked, free)
        if not sum(map(sum, may)):
            if swap and not movers:
                return labels, cuts
            if swap:
                blocked |= {w[2] for w in movers}
            swap, cuts = True, cuts[:-1]
            continue
        swap, blocked = False, set()
        moves = {}
        for i in range(k):
            for j in range(k):
                pair = [w for w in movers if labels[w[2]] == i and w[3] == j]
                pair.sort(key=lambda w: (-(w[0].bit_length() - 1) * 512 + w[1] % 512, -w[0], w[1], w[2]))
                moves |= {w[2]: j for w in pair[: may[i][j]]}
        labels |= moves


def links_of(kind, n, rng):
    if kind == "stars":
        return [(i, i - i % 7) for i in range(n)]
    if kind == "chain":
        return [(i, i + 1) for i in range(n - 1)]
    if kind == "unequal":
        cuts = [0, 1, 3, 10, 12, 40, n // 2, n]
        return [(i, a) for a, b in zip(cuts, cuts[1:]) for i in range(a, b)]
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)]


@pytest.mark.parametrize(
    "kind, spare", [("stars", 15), ("chain", 15), ("unequal", 15), ("random", 15), ("unequal", 0), ("random", 0)]
)
def test_propagation_equals_the_plain_rounds(spark, kind, spare):
    rng = random.Random(kind + str(spare))
    n, k = 60, 3
    share = [n // k + spare] * k
    start = {i: i % k if spare else (i * 7) % k for i in range(n)}
    links = links_of(kind, n, rng)
    nodes = spark.createDataFrame(list(start.items()), "node long, label int").repartition(3)
    pairs = spark.createDataFrame(links, "a long, b long").repartition(2)
    found, cuts = shards.propagate_labels(nodes, pairs, share)
    found = {r.node: r.label for r in found.collect()}
    want, want_cuts = plain_propagation(start, links, share, hashes(spark, n, k))
    assert found == want and cuts == want_cuts
    assert all(a > b for a, b in zip(cuts, cuts[1:]))
    assert len(cuts) > 1 or not spare  # full shards may have nothing to swap
    counts = Counter(found.values())
    assert all(counts[s] <= share[s] for s in range(k))


def test_stars_of_a_group_hold_it_together(spark):
    rows = spark.range(700).select(F.col("id").alias("node"), F.when(F.col("id") < 500, F.lit(1)).otherwise(F.col("id") % 50).alias("group"))
    links = [(r.a, r.b) for r in shards.star_links(rows, 8).collect()]
    root = {i: i for i in range(700)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    group = {r.node: r.group for r in rows.collect()}
    assert len({find(i) for i in range(700)}) == len(set(group.values()))
    assert len(links) == 700 - len(set(group.values()))
    assert max(Counter(b for _, b in links).values()) < 150
