"""Left-out folds, isolation forest, agreement, time-ordered scores, messages near laps, profiles over years, against single fits and loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceforge.operators import models as M
from paceforge.operators import race as R
from paceforge.operators import tracks as K

# ---- left-out folds


def single_fit(x, y, penalty):
    """One penalised fit by plain gradient descent with Newton steps, the intercept free."""
    x = np.column_stack([np.ones(len(x)), x])
    b, cost = np.zeros(x.shape[1]), penalty * np.diag([0.0, *np.ones(x.shape[1] - 1)])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ b))
        b = b - 0.7 * np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + cost, x.T @ (p - y) + cost @ b)
    return b


@pytest.mark.parametrize("folds", [12, 60])
def test_each_fold_equals_a_single_fit(spark, folds):
    rng = np.random.default_rng(3)
    x = rng.normal(0, [1, 30], (60, 2)) + [0, 200]
    y = (x[:, 0] + (x[:, 1] - 200) / 40 + rng.normal(0, 1, 60) > 0).astype(int)
    d = spark.createDataFrame([(i, i % folds, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "i int, fold int, a double, b double, y int")
    got = {r.i: r for r in M.leave_out_logistic(d, ["a", "b"], "y", "fold").collect()}
    for f in range(folds):
        inside = np.arange(60) % folds == f
        b = single_fit(x[~inside], y[~inside], 1.0)
        for i in np.flatnonzero(inside):
            want = 1 / (1 + np.exp(-(b[0] + x[i] @ b[1:])))
            assert got[i].chance == pytest.approx(want, abs=1e-6) and got[i].predicted == (got[i].chance >= 0.5)
    table = {(r.label, r.predicted): r.n for r in M.confusion(M.leave_out_logistic(d, ["a", "b"], "y", "fold"), "y", "predicted").collect()}
    assert table == Counter((int(y[i]), got[i].predicted) for i in range(60))


def test_odd_left_out_data(spark):
    kind = "i int, a double, y int"
    apart = spark.createDataFrame([(i, float(i), int(i >= 5)) for i in range(10)], kind)  # separable: finite by the penalty
    got = M.leave_out_logistic(apart, ["a"], "y", "i").collect()
    assert all(0 < r.chance < 1 for r in got) and sum(r.predicted == r.y for r in got) >= 8
    one = M.leave_out_logistic(spark.createDataFrame([(i, float(i), 1) for i in range(4)] + [(9, None, 0), (None, 1.0, 0)], kind), ["a"], "y", "i").collect()
    assert len(one) == 4 and all(r.predicted == 1 and math.isfinite(r.chance) for r in one)
    assert M.leave_out_logistic(spark.createDataFrame([], kind), ["a"], "y", "i").collect() == []
    flat = M.leave_out_logistic(spark.createDataFrame([(i, 2.0, i % 2) for i in range(6)], kind), ["a"], "y", "i").collect()
    assert all(math.isfinite(r.chance) for r in flat)
    with pytest.raises(ValueError):
        M.leave_out_logistic(apart, ["a"], "y", "i", max_folds=9)


# ---- isolation forest


@pytest.mark.parametrize("n", [300, 4000])
def test_planted_outliers_rank_first(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, *map(float, rng.uniform(-1, 1, 3))) for i in range(n)] + [(10_000 + i, 9.0 + i, -9.0 - i, 8.0) for i in range(5)]
    d = spark.createDataFrame([*rows, (-1, None, 1.0, 1.0), (-2, float("nan"), 1.0, 1.0)], "i int, a double, b double, c double")
    got = {r.i: r for r in M.isolation_forest(d, ["a", "b", "c"], contamination=0.04, trees=50, sample=64).collect()}
    known = sorted((r for r in got.values() if r.score is not None), key=lambda r: -r.score)
    first = 5 if n == 300 else 40  # with many rows a tree learns from its own share of them
    assert {r.i for r in known[:first]} >= {10_000 + i for i in range(5)} and all(got[10_000 + i].anomaly for i in range(5))
    assert abs(sum(r.anomaly for r in known) - 0.04 * (n + 5)) <= 1.5
    assert got[-1].score is None and got[-2].anomaly is None and len(got) == n + 7 and all(0 < r.score < 1 for r in known)
    again = {r.i: r.score for r in M.isolation_forest(d, ["a", "b", "c"], trees=50, sample=64).collect()}
    assert again == {i: r.score for i, r in got.items()}  # seeds by tree: a repeated task gives the same forest


def test_isolation_forest_of_few_rows(spark):
    kind = "i int, a double"
    assert M.isolation_forest(spark.createDataFrame([], kind), ["a"]).collect() == []
    assert len(M.isolation_forest(spark.createDataFrame([(1, 5.0), (2, 5.0)], kind), ["a"]).collect()) == 2


# ---- agreement


@pytest.mark.parametrize(("rows", "want"), [([(1, "x"), (1, "x"), (2, "y"), (2, "y")], 1.0), ([(1, 1), (1, 2), (2, 1), (2, 2)], -0.5), ([(1, 1), (1, 1), (1, 2), (2, 2), (2, 2), (2, 2)], 0.324324), ([(1, 1), (2, 1), (3, 1)], 0.0), ([(1, 1), (1, 1)], 1.0)])
def test_adjusted_rand(spark, rows, want):
    d = spark.createDataFrame([(str(a), str(b)) for a, b in rows], "a string, b string")
    assert M.adjusted_rand(d, "a", "b").first().rand == pytest.approx(want, abs=1e-6)


# ---- time-ordered scores


def test_permuted_is_a_permutation(spark):
    d = spark.range(5000).select("id", (F.col("id") * 3).alias("v"))
    got = M.permuted(d, "v", ["id"], rows_each=100, total=5000).collect()
    assert sorted(r.v for r in got) == [3 * i for i in range(5000)] and sum(r.v == 3 * r.id for r in got) < 100


def test_time_ordered_scores(spark):
    assert M.expanding_splits([3, 1, 2, 4], 3) == [([1], [2]), ([1, 2], [3]), ([1, 2, 3], [4])]
    assert M.expanding_splits(list(range(12)), 2) == [(list(range(4)), [4, 5, 6, 7]), (list(range(8)), [8, 9, 10, 11])]
    rng = np.random.default_rng(5)
    rows = [(s, i, float(x), float(z), float(10 * (x > 0) + rng.normal(0, 0.1))) for s in range(3) for i, (x, z) in enumerate(rng.normal(0, 1, (60, 2)))]
    d = spark.createDataFrame(rows, "season int, i int, x double, unused double, y double").withColumn("unused", F.lit(1.0))
    got = {(r.split, r.measure): r.mae for r in M.time_ordered_scores(d, ["x", "unused"], "y", "season", "x", ["season", "i"], splits=2).collect()}
    for s in (1, 2):
        assert got[s, "without unused"] == got[s, "model"] and got[s, "without x"] > got[s, "model"] + 2
        assert got[s, "model"] < got[s, "mean"] and got[s, "model"] < got[s, "x"]
    past, now = [r[4] for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
    assert got[1, "mean"] == pytest.approx(np.mean([abs(r[4] - np.mean(past)) for r in now]), abs=1e-5)
    assert got[1, "x"] == pytest.approx(np.mean([abs(r[4] - r[2]) for r in now]), abs=1e-5)


# ---- messages and retirements


def test_messages_near_and_lead(spark):
    rng = random.Random(3)
    events = [(s, d, f"D{d}", n) for s in (1, 2) for d in (1, 11, 3) for n in rng.sample(range(1, 30), 6)] + [(1, 4, "D4", 2)]
    messages = [(rng.choice([1, 2]), rng.randint(1, 30), i, f"CAR (D{rng.choice([1, 11, 3])}) {rng.choice(['SLOW', 'STOPPED'])}") for i in range(60)] + [(1, 3, 99, None), (1, 4, 3, "TIE D4"), (1, 2, 5, "D4 LATER ID"), (1, 1, 7, "D4")]
    want = {}
    for s, d, code, n in events:
        near = sorted((i, m) for ms, lap, i, m in messages if ms == s and abs(lap - n) <= 2 and m and code in m)
        want[s, d, n] = near[0][1] if near else ""
    got = R.messages_near(spark.createDataFrame(events, "season int, driver int, code string, lap_number int"), spark.createDataFrame(messages, "season int, lap int, msg_id int, message string"), ["season"])
    assert {(r.season, r.driver, r.lap_number): r.message for r in got.collect()} == want and want[1, 4, 2] == "TIE D4" and "" in want.values()

    laps = [(s, d, n) for s in (1, 2) for d in range(4) for n in range(1, 20 + d)]
    odd = [(s, d, n, rng.random() < 0.4) for s, d, n in laps if rng.random() < 0.15 and d != 3] + [(1, 0, 19, False)]
    retired = [(1, 0), (1, 3), (2, 2)]
    got = R.retirement_lead(*(spark.createDataFrame(x, c) for x, c in ((laps, "season int, driver int, lap_number int"), (odd, "season int, driver int, lap_number int, box_lap boolean"), (retired, "season int, driver int"))), ["season"])
    for r in got.collect():
        last = max(n for s, d, n in laps if (s, d) == (r.season, r.driver))
        own = [(n, b) for s, d, n, b in odd if (s, d) == (r.season, r.driver) and n < last]
        track = [n for n, b in own if not b]
        assert (r.last_lap, r.n_box, r.n_track, r.lead_laps) == (last, len(own) - len(track), len(track), last - max(track) if track else None)
    assert got.count() == 3


# ---- profiles and corners


def test_profile_places(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for track in (1, 2):
        for year in (2020, 2021, 2023):
            x = np.sort(rng.uniform(0, 4000 + year, 150)).round(3)
            v = 200 + 50 * np.sin(x / 300) + (year - 2020) * (np.abs(x - 1000 * track) < 200) * 30
            rows += [(track, year, float(a), float(b)) for a, b in zip(x, v, strict=True)]
            want[track, year] = np.interp(np.arange(101) / 100, (x - x[0]) / (x[-1] - x[0]), v)
    d = spark.createDataFrame([*rows, (1, 2020, None, 1.0), (1, 2020, 5.0, None), (3, 2020, 1.0, 1.0)], "track int, year int, x double, v double")
    profiles = K.relative_profiles(d, ["track", "year"], "x", "v", 101).persist()
    got = {(r.track, r.year, r.place): r.v for r in profiles.collect()}
    assert len(got) == 6 * 101 and all(got[t, y, i] == pytest.approx(v, abs=1e-6) for (t, y), p in want.items() for i, v in enumerate(p))
    for r in K.profile_differences(profiles, ["track"], "year", "v").collect():
        delta = want[r.track, 2023] - want[r.track, 2020]
        assert (r.old, r.new, r.peak_place) == (2020, 2023, int(np.argmax(np.abs(delta)))) and r.peak_delta == pytest.approx(delta[r.peak_place], abs=1e-3) and r.mean_delta == pytest.approx(delta.mean(), abs=1e-3)


def test_corner_matrix(spark):
    v = np.array([[100.0, 190, 300], [90, 200, 299], [99, 180, 270]])
    d = spark.createDataFrame([(1, c, i, float(v[i, c])) for i in range(3) for c in range(3)] + [(1, 0, 9, None), (2, 0, 0, 50.0)], "track int, corner int, driver int, v_min double")
    rel = v - v.max(0)
    for r in K.corner_matrix(d, ["track"]).where("track = 1").collect():
        rest = rel[r.driver] - rel[r.driver].mean()
        assert r.rel == rel[r.driver, r.corner] and r.mean_rel == pytest.approx(rel[r.driver].mean(), abs=1e-3)
        assert r.profile_corr == pytest.approx(np.corrcoef(rest, np.median(v, 0))[0, 1], abs=1e-3)
    assert K.corner_matrix(d, ["track"]).where("track = 2").first().profile_corr is None
