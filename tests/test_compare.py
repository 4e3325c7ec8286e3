import numpy as np
import pytest

from featloom.operators import compare
from featloom.plans.model_comparison import compare_files, compare_models
from tests.test_vectors import _p_by_integration

LONG = "user_id int, feat string, value double"


def frames(spark, truth, baseline, pred):
    def long(values):
        return spark.createDataFrame(
            [(u, f, v) for f, column in values.items() for u, v in column.items()], LONG
        )

    return long(truth), long(baseline), long(pred)


def make(rng, n, feats=("a", "b")):
    return [{f: dict(enumerate(rng.normal(size=n).tolist())) for f in feats} for _ in range(3)]


def brute(truth, baseline, pred, f):
    users = sorted(set(truth[f]) & set(baseline[f]) & set(pred[f]))
    d = np.array(
        [abs(truth[f][u] - baseline[f][u]) - abs(truth[f][u] - pred[f][u]) for u in users]
    )
    t = d.mean() / (d.std(ddof=1) / np.sqrt(len(d)))
    return len(d), t, _p_by_integration(t, len(d) - 1)


@pytest.mark.parametrize("n", [2, 3, 4, 5, 60])
def test_t_and_p(spark, n):
    parts = make(np.random.default_rng(n), n)
    got = compare.paired_ttest(*frames(spark, *parts)).collect()
    assert [r.p_value for r in got] == sorted(r.p_value for r in got)
    for r in got:
        k, t, p = brute(*parts, r.feat)
        assert (r.n, r.t_statistic, r.p_value) == (k, pytest.approx(t), pytest.approx(p, abs=1e-9))


def test_better_prediction_has_positive_t(spark):
    rng = np.random.default_rng(1)
    truth, noise, _ = make(rng, 50, ("a",))
    near = {"a": {u: v + 0.01 * noise["a"][u] for u, v in truth["a"].items()}}
    row = compare.paired_ttest(*frames(spark, truth, noise, near)).first()
    assert row.t_statistic > 0 and row.p_value < 1e-6


def test_only_common_users_count(spark):
    parts = make(np.random.default_rng(2), 12)
    for i, part in enumerate(parts):
        for column in part.values():
            del column[i]
    got = {r.feat: r for r in compare.paired_ttest(*frames(spark, *parts)).collect()}
    for f in "ab":
        k, t, _ = brute(*parts, f)
        assert (got[f].n, got[f].t_statistic) == (k, pytest.approx(t)) and k == 9


@pytest.mark.parametrize("missing", [None, float("nan"), "row"])
def test_a_missing_value_voids_its_outcome_only(spark, missing):
    parts = make(np.random.default_rng(3), 8)
    if missing == "row":
        del parts[2]["a"][5]
    else:
        parts[1]["a"][5] = missing
    tests = frames(spark, *parts)
    rows = compare.paired_ttest(*tests).collect()
    assert [r.feat for r in rows] == ["b", "a"]
    assert rows[1].t_statistic is None and rows[1].p_value is None and rows[1].n == 7
    assert rows[0].t_statistic == pytest.approx(brute(*parts, "b")[1])
    omitted = {r.feat: r for r in compare.paired_ttest(*tests, nan_policy="omit").collect()}
    kept = [{"a": {u: v for u, v in p["a"].items() if u != 5}} for p in parts]
    assert omitted["a"].t_statistic == pytest.approx(brute(*kept, "a")[1])


def test_no_spread_gives_null(spark):
    same = {"a": {0: 1.0, 1: 2.0, 2: 3.0}}
    row = compare.paired_ttest(*frames(spark, same, same, same)).first()
    assert (row.n, row.t_statistic, row.p_value) == (3, None, None)


def test_duplicates_fail(spark):
    t, b, p = frames(spark, *make(np.random.default_rng(4), 4))
    with pytest.raises(Exception, match="duplicate key"):
        compare.paired_ttest(t, b.unionByName(b.limit(1)), p).collect()
    with pytest.raises(Exception, match="duplicate key"):
        compare.align(t.unionByName(t.limit(1)), b, p).collect()
    unpredicted = spark.createDataFrame([(0, "z", 1.0)] * 2, LONG)
    for policy in ("propagate", "omit"):
        with pytest.raises(Exception, match="duplicate key: 0, z"):
            compare.paired_ttest(t, b.unionByName(unpredicted), p, policy).collect()
    everything = [d.unionByName(d) for d in (t, b, p)]
    with pytest.raises(Exception, match="duplicate key"):
        compare.align(*everything).collect()
    with pytest.raises(ValueError, match="nan_policy"):
        compare.paired_ttest(t, b, p, nan_policy="raise")


def test_whole_job_from_csv(spark, tmp_path):
    rng = np.random.default_rng(5)
    parts = make(rng, 20)
    truth, baseline, pred = frames(spark, *parts)
    (tmp_path / "t.csv").write_text(
        "user_id,a,b\n" + "".join(f"{u},{parts[0]['a'][u]},{parts[0]['b'][u]}\n" for u in range(20))
    )
    for name, part in (("b", parts[1]), ("p", parts[2])):
        body = "".join(f"0,{u},{f},{v}\n" for f in "ab" for u, v in part[f].items())
        (tmp_path / f"{name}.csv").write_text("id,group_id,feat,value\n" + body)
    got = compare_files(spark, *[str(tmp_path / f"{n}.csv") for n in "tbp"]).collect()
    want = compare.paired_ttest(truth, baseline, pred).collect()
    for g, w in zip(got, want):
        assert (g.feat, g.n, g.t_statistic) == (w.feat, w.n, pytest.approx(w.t_statistic))
    assert compare_models is not None


def test_null_keys_match_nothing(spark):
    t, b, p = frames(spark, *make(np.random.default_rng(6), 6))
    hole = spark.createDataFrame([(None, "a", 5.0), (None, "a", 6.0), (1, None, 2.0)], LONG)
    want = compare.paired_ttest(t, b, p).collect()
    got = compare.paired_ttest(*[d.unionByName(hole) for d in (t, b, p)]).collect()
    assert [(r.feat, r.n) for r in got] == [(r.feat, r.n) for r in want]
    for g, w in zip(got, want):
        assert (g.t_statistic, g.p_value) == pytest.approx((w.t_statistic, w.p_value))
