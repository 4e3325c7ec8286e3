"""Moments that do not depend on the order of rows."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from featloom.operators import compare, prep
from featloom.operators.exact import exact_moments


def values(n=3000):
    rng = random.Random(1)
    out = []
    for i in range(n):
        x = rng.choice([rng.gauss(0, 1), rng.gauss(5, 1e-3), rng.uniform(-1, 1) * 10.0 ** rng.randint(-30, 30)])
        out.append(("hot" if i % 3 else f"g{i % 5}", x, None if i % 7 == 0 else float(i), float("nan") if i % 2 else 0.1))
    return out + [("one", 2.5, None, None), (None, -0.0, 1.0, float("nan")), (None, 5e-324, 2.0**-1000, None)]


SCHEMA = "g string, a double, b double, c double"


def bits(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_the_same_bits_under_any_partitioning(spark):
    rows = values()
    made = set()
    for seed, parts in ((0, 1), (1, 3), (2, 8), (3, 40)):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        made.add(tuple(bits(exact_moments(df, ["g"], ["a", "b", "c"]))))
    assert len(made) == 1


def test_against_exact_fractions(spark):
    rows = values()
    found = {(r.g, r.column): r for r in exact_moments(spark.createDataFrame(rows, SCHEMA), ["g"], ["a", "b", "c"]).collect()}
    for g in {r[0] for r in rows}:
        for k, c in enumerate("abc", 1):
            x = [r[k] for r in rows if r[0] == g and r[k] is not None and not math.isnan(r[k])]
            if not x:
                assert (g, c) not in found
                continue
            r = found[g, c]
            assert r.n == len(x)
            assert r.mean == pytest.approx(float(sum(map(Fraction, x)) / len(x)), rel=1e-14, abs=1e-300)
            if len(x) == 1:
                assert r.std is None
            elif c != "a" or g != "hot":
                continue
            else:
                assert r.std == pytest.approx(np.std(x, ddof=1), rel=1e-9)
    moderate = [(None, float(x), None, None) for x in np.random.default_rng(0).normal(40, 3, 500)]
    r = exact_moments(spark.createDataFrame(moderate, SCHEMA), [], ["a"]).first()
    assert r.std == pytest.approx(np.std([m[1] for m in moderate], ddof=1), rel=1e-12)


def test_constant_values_have_no_spread_and_infinite_ones_fail(spark):
    df = spark.createDataFrame([("g", 0.1, 1e300, 0.0)] * 9, SCHEMA)
    found = {r.column: r for r in exact_moments(df, ["g"], ["a", "c"]).collect()}
    assert found["a"].std == pytest.approx(0, abs=1e-8) and found["c"].std == 0 and found["c"].mean == 0
    with pytest.raises(Exception, match="infinite sum in column b"):
        exact_moments(df, ["g"], ["b"]).collect()
    assert exact_moments(df.limit(0), ["g"], ["a"]).count() == 0


def test_statistics_and_tests_have_the_same_bits(spark):
    rng = np.random.default_rng(2)
    segments = [("ab"[i % 2], float(rng.normal(3, 2)), float(rng.integers(0, 9))) for i in range(500)]
    sides = [
        [(i, f, float(rng.normal(i % 7, 1))) for i in range(120) for f in ("x", "y")] for _ in range(3)
    ]
    made = set()
    for parts in (1, 4, 13):
        order = rng.permutation(500)
        df = spark.createDataFrame([segments[i] for i in order], "dataset_name string, ope double, agr double").repartition(parts)
        stats = bits(prep.outcome_stats(df, cols=["ope", "agr"], reproducible=True))
        scaled = bits(prep.zscore_rescale(df, cols=["ope", "agr"], reproducible=True))
        frames = [
            spark.createDataFrame([s[i] for i in rng.permutation(240)], "user_id int, feat string, value double").repartition(parts)
            for s in sides
        ]
        tests = bits(compare.paired_ttest(*frames, reproducible=True))
        made.add((tuple(stats), tuple(scaled), tuple(tests)))
    assert len(made) == 1
    plain = {r.feat: r for r in compare.paired_ttest(*frames).collect()}
    for r in compare.paired_ttest(*frames, reproducible=True).collect():
        assert (r.n, r.t_statistic, r.p_value) == (plain[r.feat].n, pytest.approx(plain[r.feat].t_statistic), pytest.approx(plain[r.feat].p_value))
