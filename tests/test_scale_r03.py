"""Work and plans that have to stay small on larger tables, with the results of the plain forms."""

import re

import numpy as np
import pytest

from paceforge.operators import laps as L
from paceforge.operators import models as M
from paceforge.operators import statistics as S
from paceforge.operators import timeseries as T
from paceforge.plans import catalogue
from paceforge.sources import tables


def test_bootstrap_draws_once_for_each_size(monkeypatch):
    """The figures of a draw for every group, though groups of one size share one."""
    rng, drawn = np.random.default_rng(3), []
    make = np.random.default_rng
    monkeypatch.setattr(np.random, "default_rng", lambda seed: drawn.append(seed) or make(seed))
    S.median_places.cache_clear()
    for n in (2, 3, 10, 11, 3, 10):
        x = np.sort(rng.normal(90, 1, n))
        plain = make(5)
        want = np.array([np.median(x[plain.integers(0, n, n)]) for _ in range(50)])
        left, right = S.median_places(n, 50, 5)
        assert ((x[left] + x[right]) / 2 == want).all()
    assert drawn == [5] * 4


def test_left_out_folds_make_their_rows_once(spark):
    """The rows' shuffle ran again in every Newton pass."""
    spark.catalog.clearCache()
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    raw = spark.range(40).selectExpr("id % 4 AS fold", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 3 = 0 AS INT) AS y")
    d = raw.mapInPandas(count, raw.schema)
    assert M.leave_out_logistic(d, ["a"], "y", "fold").count() == 40
    assert seen.value == 40


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", ["position_progression", "stint_cliff", "race_configs", "undercut_success", "phase_laps", "nearest_sample", "nearest_match"])
def test_dealt_by_rows(spark, sf_dir, monkeypatch, name):
    """Tables of more rows are dealt to more tasks, which changes no result."""
    query = catalogue.queries()[name]
    want = rows_of(query(spark, sf_dir))
    monkeypatch.setattr(tables, "DEALT", {k: (t, c, 300) for k, (t, c, _) in tables.DEALT.items()})
    many = query(spark, sf_dir)
    assert "REPARTITION_BY_NUM" in plan(many)
    assert rows_of(many) == want


def test_one_exchange_for_the_windows_of_a_driver(spark, sf_dir, monkeypatch):
    """There were two by driver and one by lap, whose tasks grew with the table."""
    monkeypatch.setattr(tables, "DEALT", {k: (t, c, 300) for k, (t, c, _) in tables.DEALT.items()})
    shuffles = re.findall(r"Exchange hashpartitioning\((\w+)#.*?, (\d+)\)", plan(catalogue.queries()["position_progression"](spark, sf_dir)))
    assert [k for k, _ in shuffles] == ["round", "l_suppkey"]
    assert all(int(n) >= 20 for _, n in shuffles)


def test_best_laps_go_to_the_laps(spark):
    """No shuffle of whole laps by session for a session's best; an unknown round is a session too."""
    data = [(r, d, 1, False, False, True, "1", None, ms) for r in (1, None) for d, ms in ((1, 100), (2, 106), (3, 150))]
    laps = spark.createDataFrame(data, "round int, driver int, lap_number int, pit_in boolean, pit_out boolean, is_accurate boolean, track_status string, deleted boolean, lap_ms int")
    clean = L.clean_laps(laps)
    assert "Window" not in plan(clean) and clean.columns == laps.columns
    assert {(r.round, r.driver) for r in clean.collect()} == {(1, 1), (1, 2), (None, 1), (None, 2)}


def test_sides_of_an_asof_join_meet_by_key(spark):
    """Sides whose tasks were joined in different ways met task by task: the map then had other winners than the sectors."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "12")
    tele = tables.read(session, "/root/testdata/sf0.1", "telemetry")
    sectors = {(r.lap_number, r.edge): r.winner for r in T.mini_sectors(tele).collect()}
    seen = {(r.lap_number, r.edge): r.winner for r in T.track_winners(tele).select("lap_number", "edge", "winner").distinct().collect()}
    assert seen == {k: sectors[k] for k in seen}


def test_intervals_of_a_rate_are_dealt_out(spark):
    d = spark.range(400).selectExpr("id % 40 AS g", "id % 3 = 0 AS s")
    assert S.success_test(d, ["g"], "s").rdd.getNumPartitions() > 4
