"""Marts and dimensions against numpy and by hand."""

import numpy as np
import pytest

from paceforge.operators import marts as D


def test_driver_pace_and_names(spark):
    laps = [(1, d, 80.0 + d + k / 10) for d in (1, 2) for k in range(5)] + [(1, 3, 70.0)] * 4 + [(2, d, 90.0 * d) for d in (1, 2) for _ in range(6)]
    mart = D.driver_pace(spark.createDataFrame(laps, "round int, driver int, lap_time_s double"), ["round"])
    got = {(r.round, r.driver): (r.n_laps, r.median_s, round(r.rel_pace, 9)) for r in mart.collect()}
    assert got == {(1, 1): (5, 81.2, 1.0), (1, 2): (5, 82.2, round(82.2 / 81.2, 9)), (2, 1): (6, 90.0, 1.0), (2, 2): (6, 180.0, 2.0)}  # four laps are too few
    names = spark.createDataFrame([(1, "a"), (2, "b")], "driver int, name string")
    assert [tuple(r) for r in D.pace_by_name(mart, names, ["driver"], least=2, top=1).collect()] == [("a", 2, 1.0)]


def test_race_configs(spark):
    fits = [(1, "SOFT", 0.1, 90.0, 8, True), (1, "SOFT", 0.3, 91.0, 12, True), (1, "HARD", 0.05, 92.0, 20, True), (1, "HARD", 9.0, 1.0, 30, False), (2, "SOFT", 0.1, 80.0, 6, True), (1, None, 5.0, 5.0, 50, True)]
    f = spark.createDataFrame(fits, "round int, compound string, slope double, intercept double, n int, reliable boolean")
    laps, loss = spark.createDataFrame([(1, 57), (1, 3), (2, 50)], "round int, lap_number int"), spark.createDataFrame([(1, 21.5)], "round int, pit_loss_s double")
    got = {r.compound: (r.round, r.slope, r.base_s, r.max_age, r.n_laps, r.pit_loss_s) for r in D.race_configs(f, laps, loss, ["round"]).collect()}
    assert got == {"SOFT": (1, 0.2, 90.7, 12, 57, 21.5), "HARD": (1, 0.05, 92.05, 20, 57, 21.5)}
    assert D.race_configs(f, laps, loss, ["round"], two_compounds=False).where("round = 2").first().pit_loss_s is None


def test_circuits_keep_what_is_missing(spark):
    square = [(1, i, x, y, z) for i, (x, y, z) in enumerate([(0, 0, 0), (1000, 0, 50), (1000, 1000, 120), (0, 1000, 20)])]
    points = spark.createDataFrame([*square, (9, 0, 5, 5, 5)], "gp int, ord int, x int, y int, z int")
    corners = spark.createDataFrame([(1,)] * 4 + [(2,)] * 3, "gp int")
    got = {r.gp: (r.corners, r.length_m, r.elev_gain_m, r.elev_span_m, r.error) for r in D.circuit_dimension(spark.createDataFrame([(1,), (2,), (3,)], "gp int"), points, corners, ["gp"]).collect()}
    assert got == {1: (4, 400.0, 12.0, 12.0, None), 2: (3, None, None, None, "no position"), 3: (None, None, None, None, "no position")}


def test_temperature_effect(spark):
    rng = np.random.default_rng(6)
    rows, kept = [], []
    for d in range(4):
        temp, age = rng.uniform(25, 45, 40), rng.integers(1, 25, 40).astype(float)
        t = 90 + d + 0.04 * temp + 0.08 * age + rng.normal(0, 0.3, 40)
        t[:2] += 30
        rows += [(1, d, float(a), float(b), float(c), bool(i == 5)) for i, (a, b, c) in enumerate(zip(temp, age, t, strict=True))]
    rows += [(1, 0, None, 3.0, 90.0, False), (2, 1, 30.0, 1.0, 90.0, False)]
    dry = [r for r in rows if r[0] == 1 and not r[5] and r[2] is not None]
    middle = {d: np.median([r[4] for r in dry if r[1] == d]) for d in range(4)}
    kept = np.array([(r[2], r[3], r[4] - middle[r[1]]) for r in dry if abs(r[4] - middle[r[1]]) < 3])
    x = np.column_stack([kept[:, 0], kept[:, 1], np.ones(len(kept))])
    c, *_ = np.linalg.lstsq(x, kept[:, 2], rcond=None)
    rest = kept[:, 2] - x @ c
    se = np.sqrt(np.linalg.inv(x.T @ x)[0, 0] * (rest**2).sum() / (len(kept) - 3))
    naive = np.polyfit([r[2] for r in dry], [r[4] for r in dry], 1)
    got = D.temperature_effect(spark.createDataFrame(rows, "round int, driver int, track_temp double, tyre_life double, corrected_s double, rainfall boolean"), ["round"]).collect()
    assert len(got) == 1 and got[0].n == len(kept) < len(dry)
    r = got[0]
    assert (r.coef_temp, r.coef_tyre, r.se_temp, r.naive_slope) == pytest.approx((c[0], c[1], se, naive[0]), abs=2e-6) and r.intercept == pytest.approx(c[2], abs=1e-4)
    assert r.r2_full == pytest.approx(1 - (rest**2).sum() / ((kept[:, 2] - kept[:, 2].mean()) ** 2).sum(), abs=2e-6) and r.r2_tyre == pytest.approx(np.corrcoef(kept[:, 1], kept[:, 2])[0, 1] ** 2, abs=2e-6)
