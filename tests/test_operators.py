"""Operators on small inputs with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceforge.operators import laps as L
from paceforge.operators import race as R
from paceforge.operators import statistics as S
from paceforge.operators import strategy as G
from paceforge.operators import timeseries as T
from paceforge.sources import storage
from paceforge.streaming.rolling import rolling_pace_stream


def one(df):
    return [tuple(r) for r in df.collect()]


def test_fuel_laps_become_flat(spark):
    d = spark.createDataFrame([(k, 90 + (50 - k) * 1.8 * 0.03, 50) for k in range(1, 51)], "lap_number int, lap_time_s double, total_laps int")
    low, high = d.select(F.min(L.fuel_corrected()), F.max(L.fuel_corrected())).first()
    assert high - low < 1e-9 and abs(low - 90) < 1e-9


def test_unknown_deletion_is_valid(spark):
    d = spark.createDataFrame([(None,), (True,), (False,)], "deleted boolean")
    assert [r[0] for r in d.select(L.valid()).collect()] == [True, False, True]


def stint(spark, ys):
    return spark.createDataFrame([(1, 1, 1, i + 1, float(i + 1), float(y)) for i, y in enumerate(ys)], "round int, driver int, stint int, lap_number int, tyre_life double, lap_time_s double")


def test_cliff_found_and_not_found(spark):
    rng = np.random.default_rng(1)
    noise = rng.normal(0, 0.02, 20)
    bend = [90 + 0.05 * k + max(0, k - 12) * 0.6 + noise[k] for k in range(20)]
    assert one(L.stint_cliff(stint(spark, bend)))[0][-1] in (12, 13, 14, 15)
    assert one(L.stint_cliff(stint(spark, [90 + 0.08 * k for k in range(20)]))) == []
    assert one(L.stint_cliff(stint(spark, bend[:7]))) == []


def test_mad_of_zero_marks_nothing(spark):
    d = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 5.0), (1, 9.0), (2, 1.0), (2, 1.1), (2, 0.9), (2, 50.0)], "g int, v double")
    got = {(r.g, r.v): r.mad_outlier for r in L.with_mad(d, "v", "g").collect()}
    assert not got[(1, 9.0)] and got[(2, 50.0)] and not got[(2, 1.1)]


def test_elo_is_zero_sum_and_symmetric(spark):
    d = spark.createDataFrame([(1, 1, 7, 8), (1, 2, 8, 7), (1, 3, 7, 9)], "grp int, ord int, winner bigint, loser bigint")
    got = dict((r.driver, r.rating) for r in R.elo(d).collect())
    assert abs(sum(got.values()) - 4500) < 1e-3
    first = dict((r.driver, r.rating) for r in R.elo(d.where("ord = 1")).collect())
    assert first == {7: 1512.0, 8: 1488.0}


def naive_match(a, b, tolerance):
    used, out = set(), []
    for i, x in a:
        d, j = min((abs(x - y), j) for j, y in b)
        if d <= tolerance and j not in used:
            used.add(j)
            out.append((1, i, j, round(d, 4)))
    return out


def test_matching_like_a_loop(spark):
    rng = np.random.default_rng(3)
    for _ in range(3):
        a = [(i, float(x)) for i, x in enumerate(rng.integers(0, 300, 12))]
        b = [(j, float(x)) for j, x in enumerate(rng.integers(0, 300, 9))]
        da = spark.createDataFrame([(1, i, x) for i, x in a], "grp int, i int, pos double")
        db = spark.createDataFrame([(1, j, x) for j, x in b], "grp int, j int, pos double")
        assert {r[:2] + (r[3],) for r in one(T.match_by_distance(da, db, 20))} == {r[:2] + (r[3],) for r in naive_match(a, b, 20)}


def test_islands_keep_runs_at_the_edges(spark):
    d = spark.createDataFrame([(1, i, float(10 * i), i < 3 or i > 6) for i in range(10)], "k int, ord int, distance_m double, on boolean")
    assert sorted((r.start_m, r.end_m) for r in T.active_zones(d, ["k"], "on", 15.0).collect()) == [(0.0, 20.0), (70.0, 90.0)]
    assert T.active_zones(d, ["k"], "on", 100.0).count() == 0


def test_status_repeats_merge_and_last_stays_open(spark):
    d = spark.createDataFrame([(1, 0, "1"), (1, 100, "4"), (1, 200, "4"), (1, 500, "1")], "session int, t_us bigint, status string")
    assert sorted((r.start_us, r.end_us) for r in T.status_intervals(d).collect()) == [(0, 100), (100, 500), (500, None)]


def test_asof_takes_equal_times_and_none_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 9, "b")], "k int, t int, v string")
    assert {(r.k, r.t): r.v for r in T.asof_join(left, right, ["k"], "t", ["v"]).collect()} == {(1, 5): "a", (1, 10): "b", (2, 1): None}
    assert {(r.k, r.t): r.v for r in T.asof_join(left, right, ["k"], "t", ["v"], forward=True).collect()} == {(1, 5): "a", (1, 10): None, (2, 1): None}


def test_interpolation_clamps(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 100.0)], "k int, x double, y double")
    g = spark.createDataFrame([(1, -5.0), (1, 2.5), (1, 10.0), (1, 20.0)], "k int, x double")
    assert {r.x: r.y for r in T.interpolate(s, g, ["k"], "x", "y").collect()} == {-5.0: 0.0, 2.5: 25.0, 10.0: 100.0, 20.0: 100.0}


def test_zone_ends_count_as_inside(spark):
    z = spark.createDataFrame([(1, 100.0, 250.0)], "key int, start_m double, end_m double")
    p = spark.createDataFrame([(1, i, x) for i, x in enumerate((99.0, 100.0, 250.0, 251.0))], "key int, id int, pos double")
    assert [r.inside for r in T.zone_membership(p, z).orderBy("id").collect()] == [False, True, True, False]


def test_square_and_elevation(spark):
    d = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 1, 0), (1, 2, 1, 1), (1, 3, 0, 1)], "k int, ord int, x int, y int")
    assert one(T.path_length(d, ["k"]))[0][1] == 4 and one(T.path_length(d, ["k"], closed=False))[0][1] == 3
    up = spark.createDataFrame([(1, i, z) for i, z in enumerate([*range(31), *range(29, -1, -1)])], "k int, ord int, z int")
    assert one(T.elevation(up, ["k"]))[0][1:] == (30.0, 30.0, 30.0)
    flat = spark.createDataFrame([(1, i, 0.3 * (i % 2)) for i in range(40)], "k int, ord int, z double")
    assert one(T.elevation(flat, ["k"]))[0][1:3] == (0.0, 0.0)


def test_strategy_against_all_plans(spark):
    tyres = spark.createDataFrame([("S", 90.0, 1.0, 0.0, 9), ("H", 91.0, 0.1, 0.0, 9)], "compound string, base double, lin double, quad double, max_age int")
    arcs = G.stint_arcs(tyres, 9, 5.0, 2).withColumn("s", F.lit(1))
    rows = [(r.compound, r["first"], r["last"], r.cost) for r in arcs.collect()]

    def plans(lap, used):
        if lap == 10:
            return [0.0] if len(used) > 1 else []
        return [c + more for k, a, b, c in rows if a == lap for more in plans(b + 1, used | {k})]

    best = G.best_strategies(arcs, ["s"], 9).first()
    assert abs(best.total_s - min(plans(1, frozenset()))) < 1e-6


def test_bootstrap_is_repeatable_and_brackets(spark):
    d = spark.createDataFrame([(1, float(x)) for x in range(40)] + [(2, 1.0)], "g int, v double")
    a, b = (S.bootstrap_median(d, ["g"], "v", 200).collect() for _ in range(2))
    assert a == b and len(a) == 1 and a[0].low <= a[0].median <= a[0].high


def test_rolling_stream_equals_batch(spark, sf_dir, tmp_path):
    from paceforge.sources.tables import read

    laps = read(spark, sf_dir, "laps").select("driver", "lap_number", "lap_time_s")
    laps.repartition(1).sortWithinPartitions("lap_number").write.parquet(str(tmp_path / "in"))
    out = rolling_pace_stream(spark.readStream.schema(laps.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("rolling").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.driver, r.lap_number): r.rolling_s for r in spark.sql("SELECT * FROM rolling").collect()}
    assert got == {(r.driver, r.lap_number): r.rolling_s for r in L.rolling_pace(laps).collect()}


def test_manifest_loads_each_session_once(spark, tmp_path):
    d = spark.createDataFrame([(2024, 1, "R", 5), (2024, 2, "R", 6)], "season int, round int, session string, v int")
    root = str(tmp_path)
    assert storage.load_new(d, root, "fact_lap") == 2 and storage.load_new(d, root, "fact_lap") == 0
    more = d.unionByName(spark.createDataFrame([(2025, 1, "Q", 7)], d.schema))
    assert storage.load_new(more, root, "fact_lap") == 1
    assert sorted(r.v for r in storage.scan(spark, root, "fact_lap").collect()) == [5, 6, 7]


def test_cache_inventory(spark, tmp_path):
    for p in ("2024/2024-03-02_Bahrain_Grand_Prix/2024-03-02_Race/_extended_timing_data.ff1pkl", "2024/2024-03-02_Bahrain_Grand_Prix/2024-03-02_Race/car_data.ff1pkl", "2024/2024-03-02_Bahrain_Grand_Prix/2024-03-01_Qualifying/other.txt", "x.txt"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("-")
    got = [(r.season, r.event, r.ident, r.timing, r.telemetry) for r in storage.cache_inventory(spark, str(tmp_path)).collect()]
    assert got == [(2024, "Bahrain Grand Prix", "R", True, True)]


@pytest.mark.parametrize("n", [1, 60])
def test_safety_car_marginals_are_chances(spark, n):
    """As the chain taken lap by lap."""
    rates = spark.createDataFrame([(1, n, 0.025, 0.25), (2, n, 1.0, 1.0)], "round int, n_laps bigint, p_deploy double, p_end double")
    got = {(r.round, r.lap): r.q for r in G.safety_car_marginals(rates, ["round"]).collect()}
    for k, p, e in ((1, 0.025, 0.25), (2, 1.0, 1.0)):
        q = 0.0
        for lap in range(1, n + 1):
            assert abs(got[k, lap] - q) < 1e-8
            q = q * (1 - e) + (1 - q) * p
    assert len(got) == 2 * n


def test_mini_sectors(spark):
    """The faster of two cars wins every stretch of a lap; a car with one sample changes nothing."""
    rows = [(1, d, 10.0 * i, i * (1.0 if d == 1 else 2.0)) for d in (1, 2) for i in range(11)] + [(1, 3, 5.0, 0.0)]
    got = T.mini_sectors(spark.createDataFrame(rows, "lap_number bigint, driver bigint, distance_m double, t_s double"), 5).collect()
    assert sorted((r.edge, r.winner, r.best_s) for r in got) == [(k, 1, 2.0) for k in range(1, 6)]


def test_penalties_of_every_kind(spark):
    texts = ["5 SECOND TIME PENALTY FOR CAR 14 (ALO) - SPEEDING", "10 SECOND STOP/GO PENALTY FOR CAR 1 (VER)", "DRIVE THROUGH PENALTY FOR CAR 2 (SAR) - JUMP START", "REPRIMAND FOR CAR 4 (NOR)", "CAR 4 (NOR) UNDER INVESTIGATION"]
    d = spark.createDataFrame([(2024, i, t) for i, t in enumerate(texts)], "season bigint, msg_id bigint, message string")
    want = [(0, 5, "TIME PENALTY", 14, "ALO", "SPEEDING"), (1, 10, "STOP/GO PENALTY", 1, "VER", None), (2, None, "DRIVE THROUGH PENALTY", 2, "SAR", "JUMP START"), (3, None, "REPRIMAND", 4, "NOR", None)]
    assert [t[1:] for t in one(R.penalties(d).orderBy("msg_id"))] == want
