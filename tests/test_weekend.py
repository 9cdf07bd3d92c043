"""Operators of a weekend against loops."""

import json
import random
from collections import defaultdict

from pyspark.sql import functions as F

from paceforge.operators import weekend as E


def test_qualifying(spark):
    rows = [(1, 1, "q1", 90.0), (1, 1, "q1", 89.5), (1, 1, "q2", 89.0), (1, 1, "q3", 89.25), (1, 2, "q1", 91.0), (1, 2, "q3", 90.0), (1, 3, "q1", None), (1, 3, None, 80.0), (2, 1, "q1", 70.0), (2, 1, "q2", 71.0)]
    d = spark.createDataFrame(rows, "round int, driver int, segment string, lap_time_s double")
    got = {(r.round, r.driver, r.segment): r.delta_s for r in E.qualifying_evolution(d, ["round"]).collect()}
    assert got == {(1, 1, "q1-q2"): 0.5, (1, 1, "q2-q3"): -0.25, (2, 1, "q1-q2"): -1.0}
    times = {(r.round, r.driver): r.quali_s for r in E.last_segment_time(E.segment_times(d, ["round"])).collect()}
    assert times == {(1, 1): 89.25, (1, 2): 90.0, (1, 3): None, (2, 1): 71.0}  # the last segment, not the fastest lap


def test_sprint_rates(spark):
    laps = [(y, g, s, n, c) for y, g, c in ((1, "a", "SOFT"), (1, "b", "WET"), (2, "a", None)) for s, k in (("S", 4), ("R", 10)) for n in range(1, k + 1)] + [(3, "only", "R", 5, "SOFT")]
    events = [(1, "a", "S")] * 2 + [(1, "a", "R")] * 5 + [(1, "b", "R")] * 9
    got = E.sprint_rates(spark.createDataFrame(events, "year int, gp string, session string"), spark.createDataFrame(laps, "year int, gp string, session string, lap_number int, compound string"), ["year", "gp"], "session", ["WET", "INTERMEDIATE"])
    assert {(r.year, r.gp): (r.n_sprint, r.n_race, r.rate_sprint, r.rate_race) for r in got.collect()} == {(1, "a"): (2, 5, 0.5, 0.5), (2, "a"): (0, 0, 0.0, 0.0)}


def test_launch_ranking(spark):
    rows = [(1, 1, "x", 50.0), (1, 1, "y", 40.0), (1, 2, "x", 30.0), (1, 2, "y", 40.0), (1, 2, "z", None), (2, 1, "x", 10.0)]
    got = {(r.season, r.driver): (r.mean_m, r.n, r.mean_rel_m, r.rank) for r in E.launch_ranking(spark.createDataFrame(rows, "season int, round int, driver string, m double").withColumnRenamed("m", "distance_m"), ["season", "round"], ["season"]).collect()}
    assert got == {(1, "x"): (40.0, 2, 0.0, 1), (1, "y"): (40.0, 2, 0.0, 1), (2, "x"): (10.0, 1, 0.0, 1)}


def test_compare_braking(spark):
    rng = random.Random(4)
    zones = {(t, d): sorted(rng.sample(range(0, 5000, 7), 12)) for t in (1, 2) for d in (1, 2, 3)}
    want = set()
    for t in (1, 2):
        for a, b in ((1, 2), (2, 3), (1, 9)):
            taken = set()
            other = zones.get((t, b), [])
            for s in zones[t, a]:
                j = min(range(len(other)), key=lambda k: (abs(other[k] - s), k), default=None)  # noqa: B023
                if j is not None and j not in taken and abs(other[j] - s) <= 150:
                    taken.add(j)
                    want.add((t, a, b, float(s), float(other[j]), float(other[j] - s)))
    z = spark.createDataFrame([(t, d, float(s)) for (t, d), v in zones.items() for s in v], "track int, driver int, start_m double")
    p = spark.createDataFrame([(t, a, b) for t in (1, 2) for a, b in ((1, 2), (2, 3), (1, 9))], "track int, driver_a int, driver_b int")
    assert {tuple(r) for r in E.compare_braking(z, p, ["track"]).collect()} == want and len(want) > 20


def test_figures_as_json(spark, tmp_path):
    stints = [(1, 1, 1, "HARD", 20), (1, 1, 2, "SOFT", 9), (1, 2, 1, "HARD", 31), (1, 2, 2, None, 4), (2, 1, 1, "SOFT", 5)]
    d = E.stint_figures(spark.createDataFrame(stints, "round int, driver int, stint int, compound string, n_laps int"), ["round"])
    got = {r.round: json.loads(r.json) for r in E.json_rows(d, ["round"]).collect()}
    assert got[1] == {"n_stints": 4, "stints_per_driver": 2.0, "mean_length": {"HARD": 25.5, "SOFT": 9.0}} and got[2]["mean_length"] == {"SOFT": 5.0}
    assert json.loads(E.json_rows(spark.createDataFrame([(1, None)], "a int, b string"), ["a"]).first().json) == {"b": None}
    E.write_figures(d, str(tmp_path / "kpi"))
    assert spark.read.json(str(tmp_path / "kpi")).count() == 2


def test_elo_history(spark):
    rng = random.Random(1)
    duels = [(s, r, o, *rng.sample(range(6), 2)) for s in (1, 2) for r in range(1, 8) for o in range(3)]
    want = {}
    for s in (1, 2):
        rating = defaultdict(lambda: 1500.0)
        for r in range(1, 8):
            for _, _, _, w, l in sorted(d for d in duels if d[:2] == (s, r)):
                a, b = rating[w], rating[l]
                gain = 24 * (1 - 1 / (1 + 10 ** ((b - a) / 400)))
                rating[w], rating[l] = a + gain, b - gain
            want |= {(s, r, d): v for d, v in rating.items()}
    got = E.elo_history(spark.createDataFrame(duels, "season int, round int, ord int, winner bigint, loser bigint"), ["season"])
    got = {(r.season, r.round, r.driver): r.rating for r in got.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-3 for k, v in want.items())
