"""Two sessions in one table give what each gives alone; following and track maps against loops."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from paceforge.operators import following as W
from paceforge.operators import laps as L
from paceforge.operators import race as R
from paceforge.operators import timeseries as T
from paceforge.operators import tracks as K
from paceforge.sources.tables import read

KEYS = ("season", "round")


@pytest.fixture(scope="module")
def seasons(spark, sf_dir, tmp_path_factory):
    """The laps at hand as season 1, and slower ones with the field turned round as season 2."""
    path = str(tmp_path_factory.mktemp("keys") / "laps")
    one = read(spark, sf_dir, "laps").withColumns({"season": F.lit(1), "team": F.floor(F.col("driver") / 8)})
    slower = F.col("lap_ms") * 2 + F.col("driver") * 1000
    two = one.withColumns({"season": F.lit(2), "lap_ms": slower, "lap_time_s": slower / 1000, "position": 21 - F.col("position"), "end_ms": F.col("end_ms") * 2, "tyre_life": F.col("tyre_life") + F.col("lap_number") % 3})
    one.unionByName(two).write.parquet(path)
    return spark.read.parquet(path)


def _phases(laps):
    return laps.select(*KEYS).distinct().select(*KEYS, F.lit(1).alias("phase_id"), F.lit(5).cast("bigint").alias("lap_start"), F.lit(8).cast("bigint").alias("lap_end"))


CASES = {
    "clean_laps": lambda d: L.clean_laps(d, 4.0, KEYS),
    "quality_funnel": lambda d: L.quality_funnel(d, 4.0, KEYS),
    "outlier_classes": lambda d: L.outlier_classes(d, 4.0, KEYS),
    "pace_table": lambda d: L.pace_table(d, KEYS, threshold=4.0),
    "stints": lambda d: L.stints(d, KEYS),
    "stint_positions": lambda d: L.stint_positions(d, KEYS),
    "degradation": lambda d: L.degradation(d, 100.0, 4, KEYS),
    "stint_cliff": lambda d: L.stint_cliff(d, keys=KEYS),
    "pit_loss": lambda d: L.pit_loss(d, keys=KEYS),
    "pit_stops": lambda d: L.pit_stops(d, KEYS),
    "pit_window_pressure": lambda d: L.pit_window_pressure(L.pit_stops(d, KEYS), 2, KEYS),
    "best_sectors": lambda d: L.best_sectors(d, KEYS),
    "speed_traps": lambda d: L.speed_traps(d, KEYS),
    "teammate_duels": lambda d: L.teammate_duels(d, KEYS),
    "field_spread": lambda d: L.field_spread(d, KEYS),
    "common_compound": lambda d: L.common_compound(d, KEYS),
    "rolling_pace": lambda d: L.rolling_pace(d, keys=KEYS),
    "current_board": lambda d: L.current_board(L.rolling_pace(d, keys=KEYS), KEYS),
    "stint_offsets": lambda d: L.stint_offsets(d, KEYS),
    "neutral_stops": lambda d: L.neutral_stops(L.pit_stops(d, KEYS), d, KEYS),
    "session_evolution": lambda d: L.session_evolution(d, KEYS),
    "lap_features": lambda d: L.lap_features(d, KEYS),
    "lap_histogram": lambda d: L.lap_histogram(d, 5000, KEYS),
    "close_following": lambda d: K.close_following(d, keys=KEYS, by=KEYS),
    "dirty_air": lambda d: K.dirty_air(d, keys=KEYS, by=KEYS),
    "neutral_compaction": lambda d: K.neutral_compaction(L.field_spread(d, KEYS), _phases(d), KEYS),
    "sector_at": lambda d: K.sector_at(d.where("pit_in").select(*KEYS, "driver", (F.col("end_ms") - 1000).alias("t_ms")), d, KEYS),
    "position_progression": lambda d: R.position_progression(d, keys=KEYS),
    "overtakes_matrix": lambda d: R.overtakes_matrix(R.overtake_events(d, KEYS), KEYS),
    "undercut_duels": lambda d: R.undercut_duels(d, keys=KEYS),
}


def _rows(df):
    tidy = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    cols = sorted(df.columns)
    return sorted((tuple(tidy(r[c]) for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(CASES))
def test_seasons_stay_apart(seasons, name):
    both = CASES[name](seasons)
    alone = [_rows(CASES[name](seasons.where(F.col("season") == s))) for s in (1, 2)]
    assert set(KEYS) & set(both.columns)
    assert _rows(both) == sorted(alone[0] + alone[1], key=repr)
    assert alone[0]


def test_following_laps_and_cost(spark):
    """Against a loop: zero gaps, laps without samples, box laps, a lone tyre age and too few laps."""
    laps, gaps = [], []
    for driver in (1, 2, 3):
        for lap in range(1, 9 if driver < 3 else 4):
            age = 5.0 if driver == 2 else float(lap % 4)
            laps.append((1, driver, lap, 90.0 + 0.3 * age + 0.01 * lap * driver, 8, "1" if lap != 6 else "4", True, lap == 7, False, "S", age))
            gaps += [(1, driver, lap, float((lap * 37 + k * 29 + driver) % 120) * (k > 0)) for k in range(5) if lap != 5]
    lap_df = spark.createDataFrame(laps, "round int, driver int, lap_number int, lap_time_s double, total_laps int, track_status string, is_accurate boolean, pit_in boolean, pit_out boolean, compound string, tyre_life double")
    gap_df = spark.createDataFrame(gaps, "round int, driver int, lap_number int, gap_m double")
    report = W.following_laps(gap_df, lap_df, ["round"], 50.0)
    got = {(r["driver"], r["lap_number"]): r for r in report.collect()}
    want = {}
    for rnd, driver, lap, t, total, status, _, box, *_rest in laps:
        own = [g[3] for g in gaps if g[1:3] == (driver, lap)]
        known = [g for g in own if g != 0]
        if status == "1" and not box and own:
            want[driver, lap] = (t - (total - lap) * 0.054, statistics.median(known), min(known), 100 * sum(0 < g < 50 for g in own) / len(own))
    assert set(got) == set(want)
    for k, (sec, mid, low, near) in want.items():
        r = got[k]
        assert (r["sec_fuel"], r["median_m"], r["least_m"], r["near_pct"]) == pytest.approx((sec, mid, low, near), abs=1e-4)

    cost = {r["driver"]: r for r in W.following_cost(report, ["round"]).collect()}
    assert cost[2]["slope"] is None and cost[3]["slope"] is None and cost[3]["n"] == 3

    def line(x, y):
        mx, my = statistics.mean(x), statistics.mean(y)
        slope = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / sum((a - mx) ** 2 for a in x)
        return slope, my - slope * mx

    age = {(d, n): a for _, d, n, *_x, a in laps}
    mine = sorted(k for k in want if k[0] == 1)
    x, y = [age[k] for k in mine], [got[k]["sec_fuel"] for k in mine]
    rest = [b - line(x, y)[0] * a for a, b in zip(x, y, strict=True)]
    slope, intercept = line([got[k]["near_pct"] for k in mine], rest)
    assert cost[1]["slope"] == pytest.approx(slope, abs=1e-4) and cost[1]["intercept"] == pytest.approx(intercept, abs=1e-3)


def test_track_winners(spark):
    """Middles of stretches by loop; the winner is that of the mini sector; a lone driver's lap has no row."""
    rows = []
    for driver, pace in ((1, 1.0), (2, 1.3)):
        for i in range(41):
            rows.append((1, driver, i, i * 10.0, i * pace + (driver == 1) * max(0, i - 20) * 0.9, float(i), float(driver)))
    rows += [(2, 1, i, i * 10.0, float(i), 0.0, 0.0) for i in range(5)]
    tele = spark.createDataFrame(rows, "lap_number int, driver int, ord int, distance_m double, t_s double, x double, y double")
    winners = {(r["lap_number"], r["edge"]): r["winner"] for r in T.mini_sectors(tele, 8).collect()}
    got = {(r["driver"], r["ord"]): r for r in T.track_winners(tele, 8).collect()}
    assert set(got) == {(d, i) for d in (1, 2) for i in range(40)}
    for (_, i), r in got.items():
        assert r["edge"] == min(8, math.floor((i * 10 + 5) / 400 * 8) + 1)
        assert r["winner"] == winners[1, r["edge"]] and r["to_x"] == i + 1
    assert winners[1, 1] == 1 and winners[1, 8] == 2
