"""Cars ahead, phases, tails of distributions, storage and the live feed, against brute force."""

import json
import math
import os
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceforge.functions import tails
from paceforge.operators import following as W
from paceforge.operators import phases as P
from paceforge.operators import statistics as S
from paceforge.sources import storage
from paceforge.streaming import feed

LAP_COLS = "season int, round int, driver bigint, lap_number bigint, position bigint, track_status string, pit_in boolean, end_ms bigint, lap_ms bigint"


def field(seed, seasons=(2023, 2024), rounds=2, cars=6, laps=12):
    """Two seasons of the same drivers with stops, retirements and status codes."""
    rng, rows = random.Random(seed), []
    for season in seasons:
        for r in range(1, rounds + 1):
            clock = {d: rng.randint(0, 900) for d in range(cars)}
            for n in range(1, laps + 1):
                took = {d: rng.randint(88_000, 95_000) for d in clock}
                for d in clock:
                    clock[d] += took[d]
                order = sorted(clock, key=lambda d: (clock[d], d))
                rows += [(season, r, d, n, order.index(d) + 1, rng.choice("1114"), rng.random() < 0.12, clock[d], took[d]) for d in clock]
                if n == 7 and len(clock) > 4:
                    clock.pop(order[-1])
    return rows


# ---- cars ahead, attempts, places


def brute_following(samples, length, bucket):
    at = {}
    for *key, d, lap, t, dist in samples:
        b = (*key, t // bucket)
        if d not in at.setdefault(b, {}) or (t, lap, dist) > at[b][d]:
            at[b][d] = (t, lap, dist)
    out = {}
    for b, cars in at.items():
        if len(cars) < 2:
            continue
        order = sorted((s[2] % length, d) for d, s in cars.items())
        for i, (m, d) in enumerate(order):
            nm, nd = order[(i + 1) % len(order)]
            out[(*b[:-1], d, b[-1])] = (cars[d][1], nd, round(nm - m if i + 1 < len(order) else nm + length - m, 4))
    return out


@pytest.fixture(scope="module")
def track(spark):
    rng = random.Random(1)
    laps = field(3)
    samples = []
    for season, r, d, n, *_ in laps:
        for k in range(8):
            if rng.random() < 0.8:
                samples.append((season, r, d, n, n * 1000 + k * 125 + rng.randint(0, 124), round(n * 700 + k * 90 + rng.random() * 60, 1)))
    samples += [s for s in samples if rng.random() < 0.05]
    s = spark.createDataFrame(samples, "season int, round int, driver bigint, lap_number bigint, t_us bigint, distance_m double")
    return laps, samples, spark.createDataFrame(laps, LAP_COLS), s, W.driver_ahead(s, ["season", "round"], 700.0, 100).persist()


def test_driver_ahead(track):
    _, samples, _, _, got = track
    want = brute_following(samples, 700.0, 100)
    assert {(r.season, r.round, r.driver, r.bucket): (r.lap_number, r.ahead, r.gap_m) for r in got.collect()} == want and len(want) > 300


def test_attempts(track):
    laps, samples, laps_df, _, following = track
    place = {(s, r, d, n): p for s, r, d, n, p, *_ in laps}
    green = {(s, r, d, n) for s, r, d, n, _, st, *_ in laps if st == "1"}
    least = defaultdict(lambda: math.inf)
    for (s, r, d, _), (n, ahead, gap) in brute_following(samples, 700.0, 100).items():
        if (s, r, d, n) in green and place.get((s, r, ahead, n - 1), -9) == place.get((s, r, d, n - 1), 0) - 1:
            least[s, r, d, ahead, n] = min(least[s, r, d, ahead, n], gap)
    approach = W.closest_approach(following, laps_df, ["season", "round"])
    assert {(x.season, x.round, x.driver, x.rival, x.lap_number): x.least_m for x in approach.collect()} == dict(least) and least
    want = {k: place.get((*k[:3], k[4]), 99) < place.get((k[0], k[1], k[3], k[4]), -1) for k, v in least.items() if v < 60}
    got = W.attempts(approach, laps_df, ["season", "round"], 60.0).collect()
    assert {(x.season, x.round, x.driver, x.rival, x.lap_number): x.success for x in got} == want and want


def test_overtake_places(spark, track):
    laps, samples, _, _, following = track
    rng = random.Random(5)
    events = sorted({(s, r, n, d, rng.randrange(6)) for s, r, d, n, *_ in laps})
    zones = [(2023, 1, 100.0, 180.0), (2023, 1, 150.0, 420.0), (2024, 2, 0.0, 99.9)]
    want = {}
    for (s, r, d, b), (n, ahead, gap) in sorted(brute_following(samples, 700.0, 100).items(), key=lambda x: x[0][3]):
        if gap < 200 and (s, r, n, d, ahead) in events:
            t, _, dist = max((t, n2, dist) for s2, r2, d2, n2, t, dist in samples if (s2, r2, d2) == (s, r, d) and t // 100 == b)
            at = round(dist % 700.0, 1)
            want[s, r, n, d, ahead] = (at, any(z[:2] == (s, r) and z[2] <= at <= z[3] for z in zones))
    e = spark.createDataFrame(events, "season int, round int, lap_number bigint, gainer bigint, loser bigint")
    z = spark.createDataFrame(zones, "season int, round int, start_m double, end_m double")
    got = W.locate_overtakes(e, following, z, ["season", "round"], ["season", "round"], 200.0)
    assert {(x.season, x.round, x.lap_number, x.gainer, x.loser): (x.place_m, x.in_zone) for x in got.collect()} == want and len(want) > 20
    assert {x[1] for x in want.values()} == {True, False}


def test_two_sessions_are_the_sum_of_both(track):
    """Nothing of one season or round reaches another."""
    _, samples, _, df, both = track
    each = [W.driver_ahead(df.where(f"season = {s} and round = {r}"), ["season", "round"], 700.0, 100) for s in (2023, 2024) for r in (1, 2)]
    assert Counter(map(tuple, both.collect())) == Counter(tuple(x) for d in each for x in d.collect())


# ---- phases


def test_phases_and_stop_classes(spark):
    laps, rng = field(11, laps=40), random.Random(2)
    log = sorted({(s, r, rng.randrange(0, 3_700_000)) for s in (2023, 2024) for r in (1, 2) for _ in range(25)})
    log = [(*x, rng.choice("1124469")) for x in log]
    df = spark.createDataFrame(laps, LAP_COLS)
    got = P.phases_with_laps(spark.createDataFrame(log, "season int, round int, t_ms bigint, status string"), df, ["season", "round"]).persist()
    want, classes = set(), set()
    place = {(s, r, d, n): p for s, r, d, n, p, *_ in laps}
    for key in {x[:2] for x in log}:
        mine = [x for x in laps if x[:2] == key]
        leads = [(x[7] - x[8], x[3]) for x in mine if x[4] == 1]
        lap_at = lambda t: max((n for a, n in leads if a <= t), default=0)  # noqa: E731, B023
        merged = []
        for *_, t, code in sorted(x for x in log if x[:2] == key):
            label = P.LABELS.get(code, code)
            if not merged or merged[-1][1] != label:
                merged.append((t, label))
        for i, (t, label) in enumerate(merged):
            end = merged[i + 1][0] if i + 1 < len(merged) else max(x[7] for x in mine)
            want.add((*key, label, t, end, end - t, lap_at(t), lap_at(end)))
            if label in P.NEUTRAL:
                a, b = lap_at(t), lap_at(end)
                for d in {x[2] for x in mine}:
                    stops = sorted(x[3] for x in mine if x[2] == d and x[6])
                    early, inside = [n for n in stops if a - 3 <= n < a], [n for n in stops if a <= n <= b]
                    if early or inside:
                        stop = (early or inside)[0]
                        p0, p1 = place.get((*key, d, stop - 1)), place.get((*key, d, b))
                        if p0 and p1:
                            classes.add((*key, t, d, "before" if early else "during", stop, p0 - p1))
    assert {tuple(r) for r in got.collect()} == want
    assert {tuple(r) for r in P.stop_classes(got, df, ["season", "round"]).collect()} == classes and {c[4] for c in classes} == {"before", "during"}


def test_lap_before_the_first_start_is_zero(spark):
    laps = spark.createDataFrame([(1, 1, 1, 100, 90), (1, 1, 2, 200, 100), (1, 2, 3, 260, 60), (1, 1, None, None, None)], "round int, position int, lap_number bigint, end_ms bigint, lap_ms bigint")
    times = spark.createDataFrame([(1, 5), (1, 10), (1, 99), (1, 100), (1, 500), (2, 7)], "round int, t_ms bigint")
    assert {(r.round, r.t_ms): r.lap for r in P.lap_at(times, laps, ["round"]).collect()} == {(1, 5): 0, (1, 10): 1, (1, 99): 1, (1, 100): 2, (1, 500): 2, (2, 7): 0}


# ---- tails


def exact_two_sided(k, n):
    total = sum(comb(n, i) for i in range(n + 1) if comb(n, i) <= comb(n, k))
    return float(Fraction(total, 2**n))


def test_binomial_against_fractions(spark):
    rows = [(k, n) for n in (1, 2, 3, 7, 20, 49, 50) for k in range(n + 1)]
    d = spark.createDataFrame(rows, "k int, n int")
    low, high = tails.binomial_interval(F.col("k"), F.col("n"))
    for r in d.select("k", "n", tails.binomial_two_sided(F.col("k"), F.col("n")).alias("p"), low.alias("low"), high.alias("high")).collect():
        assert r.p == pytest.approx(exact_two_sided(r.k, r.n), rel=1e-9)
        tail = lambda q, ks, n=r.n: sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in ks)
        assert (r.low == 0) == (r.k == 0) and (r.high == 1) == (r.k == r.n)
        if r.k:
            assert tail(r.low, range(r.k, r.n + 1)) == pytest.approx(0.025, rel=1e-7)
        if r.k < r.n:
            assert tail(r.high, range(r.k + 1)) == pytest.approx(0.025, rel=1e-7)


def test_log_gamma_normal_and_t(spark):
    xs = [1e-3, 0.5, 1.0, 2.0, 3.7, 12.0, 170.0, 1e5]
    got = [r.g for r in spark.createDataFrame([(x,) for x in xs], "x double").select(tails.log_gamma(F.col("x")).alias("g")).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-11, abs=1e-11)
    zs = [0.0, 0.3, -1.0, 1.96, 2.8284, 3.5, 6.0, 20.0]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(tails.normal_two_sided(F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([math.erfc(abs(z) / math.sqrt(2)) for z in zs], rel=1e-9)
    for dof in (1, 2.5, 9, 60, 5000):
        for t in (0.0, 0.4, 2.1, -5.0):
            grid = np.linspace(0, abs(t), 200_001)
            pdf = np.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi) * (1 + grid**2 / dof) ** (-(dof + 1) / 2)
            want = 1 - 2 * np.trapezoid(pdf, grid)
            assert spark.range(1).select(tails.t_two_sided(F.lit(t), F.lit(dof)).alias("p")).first().p == pytest.approx(want, abs=1e-8)


def test_p_values_of_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(np.round(v, 1)), bool(b)) for g in (1, 2) for v, b in zip(rng.normal(0, 1, 40) + np.arange(40) % 2 * (g - 1), np.arange(40) % 2, strict=True)]
    d = spark.createDataFrame(rows, "g int, v double, b boolean")
    for r in S.mann_whitney_test(d, ["g"], "v", "b").collect():
        x, y = ([v for g, v, b in rows if g == r.g and b == k] for k in (True, False))
        u = sum((a > c) + 0.5 * (a == c) for a in x for c in y)
        ties = sum(n**3 - n for n in Counter([*x, *y]).values())
        sd = math.sqrt(20 * 20 / 12 * (41 - ties / (40 * 39)))
        assert r.u == u and r.p == pytest.approx(math.erfc(max(abs(u - 200) - 0.5, 0) / sd / math.sqrt(2)), rel=1e-9)
    for r in S.wilcoxon_test(d, ["g"], "v").collect():
        v = [x for g, x, _ in rows if g == r.g and x]
        ties = sum(n**3 - n for n in Counter(map(abs, v)).values())
        n = len(v)
        z = (min(r.w_plus, r.w_minus) - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
        assert r.p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-9)
    t = S.welch_test(d, ["g"], "v", "b", tests=40).collect()
    assert all(0 <= r.p <= r.p_adjusted <= 1 and r.p_adjusted == min(1.0, r.p * 40) for r in t) and min(r.p for r in t) < 0.05
    assert [(r.n, r.k, r.p) for r in S.success_test(spark.createDataFrame([(1, None)], "g int, s boolean"), ["g"], "s").collect()] == []


# ---- storage


def session_rows(spark, more=()):
    rows = [(2023 + i % 2, 1 + i % 3, "RQ"[i % 2], i) for i in range(60)] + list(more)
    return spark.createDataFrame(rows, "season int, round int, session string, v int")


def test_a_load_that_dies_between_fact_and_manifest(spark, tmp_path, monkeypatch):
    root, d = str(tmp_path), session_rows(spark)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(storage, "list_loaded", dies)
        with pytest.raises(RuntimeError):
            storage.load_new(d, root, "fact_lap")
    assert storage.scan(spark, root, "fact_lap").count() == 60  # rows without an entry
    sessions = d.select(*storage.KEYS).distinct().count()
    assert storage.load_new(d, root, "fact_lap") == sessions
    assert sorted(r.v for r in storage.scan(spark, root, "fact_lap").collect()) == list(range(60))
    assert storage.load_new(session_rows(spark, [(2025, 1, "R", 99)]), root, "fact_lap") == 1
    assert storage.scan(spark, root, "fact_lap").count() == 61 and storage.load_new(d, root, "fact_lap") == 0


def test_missing_facts_are_filled_in(spark, tmp_path):
    root, d = str(tmp_path), session_rows(spark)
    n = d.select(*storage.KEYS).distinct().count()
    assert storage.missing_loads(d, root, ["fact_lap", "fact_pitstop"]).count() == 2 * n
    storage.load_new(d, root, "fact_lap")
    storage.load_new(d.where("season = 2023"), root, "fact_pitstop")
    missing = storage.missing_loads(d, root, ["fact_lap", "fact_pitstop"]).collect()
    assert {r.fact for r in missing} == {"fact_pitstop"} and {r.season for r in missing} == {2024}
    storage.load_new(d, root, "fact_pitstop")
    assert storage.missing_loads(d, root, ["fact_lap", "fact_pitstop"]).count() == 0
    assert storage.scan(spark, root, "fact_lap").count() == storage.scan(spark, root, "fact_pitstop").count() == 60


def test_a_session_is_read_alone(spark, tmp_path):
    root, d = str(tmp_path), session_rows(spark)
    storage.load_new(d, root, "fact_lap")
    one = storage.load(spark, root, "fact_lap", 2023, 1, "R")
    assert sorted(r.v for r in one.collect()) == [i for i in range(60) if i % 2 == 0 and i % 3 == 0]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan and "session" in plan.split("PartitionFilters")[1].split("]")[0]
    assert storage.load(spark, root, "fact_lap", season=2024).count() == 30


# ---- the live feed


def line(driver, lap, at, seconds, **more):
    t = datetime(2024, 5, 5, 13, tzinfo=timezone.utc) + timedelta(seconds=at)
    return json.dumps({"season": 2024, "round": 7, "session": "R", "driver": driver, "lap_number": lap, "compound": "SOFT", "tyre_life": float(lap), "lap_time_s": seconds, "ts": t.isoformat(timespec="milliseconds")} | more)


def feed_files(folder, seed=6):
    """Batches of a feed: laps out of order, late, repeated, without a time, and lines that are none. Returns (batch, driver, lap, at, seconds)."""
    rng, rows = random.Random(seed), []
    for d in range(3):
        for n in range(1, 26):
            at = 90 * n + 7 * d
            late = rng.choice([0, 0, 0, 40, 400])
            rows.append(((at + late) // 200, d, n, at, None if rng.random() < 0.05 else round(85 + rng.random() * 10, 3)))
            if rng.random() < 0.15:
                rows.append(((at + late) // 200 + 1, d, n, at + 1, 50.0))
    rows.append((40, 9, 1, 100_000, 90.0))  # lets the watermark pass all the others
    for b in sorted({r[0] for r in rows}):
        own = [line(d, n, at, s) for k, d, n, at, s in rows if k == b]
        rng.shuffle(own)
        f = folder / f"feed-{b:03d}.txt"
        f.write_text("\n".join([*own, "not json", '{"driver": 1}', ""]))
        os.utime(f, (1_700_000_000 + b, 1_700_000_000 + b))  # files are read in the order of their times
    return rows


def run_feed(spark, tmp_path, available_now=True):
    snaps = feed.pace_snapshots(feed.read_feed(spark, str(tmp_path / "in"), files_per_batch=1))
    q = feed.write_snapshots(snaps, str(tmp_path / "out"), str(tmp_path / "ck"), available_now)
    assert q.awaitTermination(300)
    return feed.read_snapshots(spark, str(tmp_path / "out")).collect()


def test_feed_equals_batch_less_the_late_laps(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = feed_files(tmp_path / "in")
    got = run_feed(spark, tmp_path)
    df = spark.createDataFrame(rows, "batch bigint, driver bigint, lap_number bigint, at bigint, lap_time_s double").withColumn("session", F.lit("R"))
    kept = feed.on_time(df, ["session"], "batch", "at", 60)
    assert 0 < kept.count() < df.count()
    want = {(r.driver, r.lap_number): r.rolling_s for r in feed.batch_snapshots(kept, ["session"], "at").collect()}
    assert {(r.driver, r.lap_number): r.rolling_s for r in got} == want and len(got) == len(want) > 20
    board = {r.driver: r.lap_number for r in feed.live_board(feed.read_snapshots(spark, str(tmp_path / "out"))).collect()}
    assert board == {d: max(n for e, n in want if e == d) for d in {d for d, _ in want}}
    # the replay reads the same laps as a batch
    assert feed.replay_feed(spark, str(tmp_path / "in")).count() == len(rows)
    # a restart, and one that lost the mark of its last batch, write nothing twice
    before = sorted(map(tuple, got), key=str)
    assert sorted(map(tuple, run_feed(spark, tmp_path)), key=str) == before
    last = max((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert sorted(map(tuple, run_feed(spark, tmp_path)), key=str) == before
