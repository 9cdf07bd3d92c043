"""Query catalogue: each query builds its DataFrame from the operators; its twin says the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceforge.operators import following as W
from paceforge.operators import laps as L
from paceforge.operators import marts as D
from paceforge.operators import models as M
from paceforge.operators import phases as P
from paceforge.operators import race as R
from paceforge.operators import statistics as S
from paceforge.operators import strategy as G
from paceforge.operators import timeseries as T
from paceforge.operators import tracks as K
from paceforge.operators import weekend as E
from paceforge.sources.tables import oracle, read
from paceforge.streaming import feed

Read = Callable[[str], DataFrame]
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *tables: str):
    """Registers a builder that gets a reader of tables; ``sql`` is its twin over the logical ``tables``."""

    def add(build: Callable[[Read], DataFrame]):
        name = build.__name__
        _QUERIES[name] = lambda spark, sf_dir: build(lambda table: read(spark, sf_dir, table))
        if sql:
            _ORACLES[name] = oracle(sql, *tables) if tables else sql
        return build

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracles() -> dict:
    return dict(_ORACLES)


def clean(threshold: float) -> str:
    return f"""(SELECT * FROM (SELECT *, min(lap_ms) OVER (PARTITION BY round) AS best FROM laps)
      WHERE NOT pit_in AND NOT pit_out AND is_accurate AND track_status = '1' AND NOT coalesce(deleted, false) AND lap_ms < {threshold} * best)"""


FUEL = "lap_time_s - (total_laps - lap_number) * (1.8e0 * 0.03e0)"
PACE = f"(SELECT round, driver, count(*) AS n_laps, min(team) AS team, median({FUEL}) AS pace FROM {clean(4.0)} GROUP BY ALL HAVING count(*) >= 8)"
FITS = f"""(SELECT *, n >= 6 AND r2 >= 0.3 AS reliable FROM (
  SELECT round, driver, stint, compound, regr_slope(t, tyre_life) AS slope, regr_intercept(t, tyre_life) AS intercept,
         CASE WHEN var_pop(t) = 0 THEN 0 ELSE regr_r2(t, tyre_life) END AS r2, count(*) AS n, min_by(fresh_tyre, lap_number) AS fresh
  FROM (SELECT *, {FUEL} AS t FROM {clean(100.0)}) GROUP BY ALL HAVING count(*) >= 4 AND min(tyre_life) < max(tyre_life)))"""
STOPS = """(SELECT round, driver, team, lap_number AS in_lap, stint, compound AS compound_before, CASE WHEN nl = lap_number + 1 AND npo THEN nc END AS compound_after,
   CASE WHEN nl = lap_number + 1 AND npo THEN (lap_ms + nm) / 1000e0 END AS duration_s FROM (
   SELECT *, lead(lap_number) OVER w AS nl, lead(pit_out) OVER w AS npo, lead(compound) OVER w AS nc, lead(lap_ms) OVER w AS nm FROM laps WINDOW w AS (PARTITION BY driver ORDER BY lap_number)) WHERE pit_in)"""
EVENTS = """(SELECT a.round, a.lap_number, a.driver AS gainer, b.driver AS loser FROM prv a JOIN prv b ON a.round = b.round AND a.lap_number = b.lap_number
   AND a.prev > b.prev AND a.position < b.position WHERE a.track_status = '1' AND b.track_status = '1' AND NOT coalesce(a.prev_pit, false) AND NOT b.pit_in)"""
PREV = """prv AS (SELECT *, CASE WHEN lag(lap_number) OVER w = lap_number - 1 THEN lag(position) OVER w END AS prev,
   CASE WHEN lag(lap_number) OVER w = lap_number - 1 THEN lag(pit_in) OVER w END AS prev_pit FROM laps WINDOW w AS (PARTITION BY driver ORDER BY lap_number))"""


# The price-like lap times at hand spread far wider than a field of cars, so the thresholds here are wide.
@query(f"SELECT * EXCLUDE (best) FROM {clean(4.0)}", "laps")
def clean_laps(t):
    return L.clean_laps(t("laps"), 4.0)


@query(
    """WITH f AS (SELECT *, lap_ms < 4.0 * min(lap_ms) OVER (PARTITION BY round) AS q, NOT pit_in AND NOT pit_out AS c1 FROM laps),
    s AS (SELECT round, count(*) AS n0, count(*) FILTER (c1) AS n1, count(*) FILTER (c1 AND is_accurate) AS n2, count(*) FILTER (c1 AND is_accurate AND track_status = '1') AS n3,
      count(*) FILTER (c1 AND is_accurate AND track_status = '1' AND NOT coalesce(deleted, false)) AS n4,
      count(*) FILTER (c1 AND is_accurate AND track_status = '1' AND NOT coalesce(deleted, false) AND q) AS n5 FROM f GROUP BY round)
    SELECT round, 0 AS step, 'all' AS filter, n0 AS n_laps FROM s UNION ALL SELECT round, 1, 'no_box', n1 FROM s UNION ALL SELECT round, 2, 'accurate', n2 FROM s
    UNION ALL SELECT round, 3, 'green', n3 FROM s UNION ALL SELECT round, 4, 'valid', n4 FROM s UNION ALL SELECT round, 5, 'quick', n5 FROM s""",
    "laps",
)
def lap_quality_funnel(t):
    return L.quality_funnel(t("laps"), 4.0)


@query(
    """WITH a AS (SELECT *, lap_ms >= 4.0 * min(lap_ms) OVER (PARTITION BY round) AS slow, abs(lap_time_s - median(lap_time_s) OVER (PARTITION BY driver)) AS d FROM laps),
    b AS (SELECT *, median(d) OVER (PARTITION BY driver) AS mad FROM a), c AS (SELECT *, coalesce(0.6745e0 * d / nullif(mad, 0) > 3.5, false) AS o FROM b)
    SELECT round, CASE WHEN slow AND o THEN 'both' WHEN slow THEN 'threshold_only' WHEN o THEN 'mad_only' ELSE 'kept' END AS category, count(*) AS n_laps FROM c GROUP BY ALL""",
    "laps",
)
def outlier_classes(t):
    return L.outlier_classes(t("laps"), 4.0)


@query(f"SELECT round, driver, n_laps, team, round(pace, 4) AS pace FROM {PACE}", "laps")
def race_pace(t):
    return L.race_pace(t("laps"), 4.0).withColumn("pace", F.round("pace", 4))


@query(f"SELECT round, driver, team, n_laps, round(pace, 4) AS pace_s, round(pace - min(pace) OVER (PARTITION BY round), 4) AS delta_s FROM {PACE}", "laps")
def pace_table(t):
    return L.pace_table(t("laps"), threshold=4.0)


@query("SELECT round, driver, stint, compound, min(lap_number) AS first_lap, max(lap_number) AS last_lap, count(lap_number) AS n_laps FROM laps GROUP BY ALL", "laps")
def stints(t):
    return L.stints(t("laps"))


@query("SELECT *, start_position - end_position AS gained FROM (SELECT round, driver, stint, arg_min(position, lap_number) AS start_position, arg_max(position, lap_number) AS end_position FROM laps GROUP BY ALL)", "laps")
def stint_position_change(t):
    return L.stint_positions(t("laps"))


@query(f"SELECT round, driver, stint, compound, round(slope + 1e-7, 4) AS slope, round(intercept + 1e-7, 3) AS intercept, round(r2 + 1e-7, 4) AS r2, n, fresh, reliable FROM {FITS}", "laps")
def degradation(t):
    d = L.degradation(t("laps"), 100.0, 4)
    # times are whole milliseconds, so that many results end in a 5; a little more keeps both engines on one side
    return d.withColumns({c: F.round(F.col(c) + 1e-7, k) for c, k in (("slope", 4), ("intercept", 3), ("r2", 4))})


@query(f"SELECT compound, round(avg(slope), 4) AS mean_slope, round(stddev_samp(slope), 4) AS std_slope, count(*) AS n_stints FROM {FITS} WHERE reliable GROUP BY 1", "laps")
def degradation_by_compound(t):
    return L.degradation_by(L.degradation(t("laps"), 100.0, 4).where("reliable"), "compound")


@query(f"SELECT compound, fresh, round(avg(slope), 4) AS mean_slope, round(stddev_samp(slope), 4) AS std_slope, count(*) AS n_stints FROM {FITS} GROUP BY 1, 2", "laps")
def fresh_vs_used(t):
    return L.degradation_by(L.degradation(t("laps"), 100.0, 4), "compound", "fresh")


@query(f"SELECT compound, round(median(slope), 4) AS slope, round(median(intercept), 4) AS base, count(*) AS n_stints FROM {FITS} GROUP BY 1", "laps")
def tyre_models(t):
    return L.tyre_models(L.degradation(t("laps"), 100.0, 4))


@query()
def stint_cliff(t):
    return L.stint_cliff(t("laps"))


@query(
    f"""WITH base AS (SELECT driver, median(lap_time_s) AS base FROM {clean(100.0)} GROUP BY 1),
    m AS (SELECT round, round(median(lap_time_s - base) FILTER (pit_in), 6) AS in_loss_s, round(median(lap_time_s - base) FILTER (pit_out), 6) AS out_loss_s
      FROM laps JOIN base USING (driver) WHERE NOT contains(track_status, '5') GROUP BY 1) SELECT *, round(in_loss_s + out_loss_s, 6) AS pit_loss_s FROM m""",
    "laps",
)
def pit_loss(t):
    laps = t("laps")
    base = L.clean_laps(laps, 100.0).groupBy("driver").agg(F.median("lap_time_s").alias("base"))
    return L.pit_loss(laps, base=base)


@query(f"SELECT * FROM {STOPS}", "laps")
def pit_stops(t):
    return L.pit_stops(t("laps"))


@query(
    f"SELECT team, round(median(duration_s), 4) AS median_s, min(duration_s) AS best_s, round(quantile_cont(duration_s, 0.75) - quantile_cont(duration_s, 0.25), 6) AS iqr_s, count(*) AS n_stops FROM {STOPS} WHERE duration_s BETWEEN 40 AND 90 GROUP BY 1",
    "laps",
)
def team_pit_ranking(t):
    return L.team_pit_ranking(L.pit_stops(t("laps")), 40, 90)


@query(
    f"""WITH p AS (SELECT *, count(*) OVER (PARTITION BY round, in_lap) AS n FROM {STOPS} WHERE duration_s IS NOT NULL)
    SELECT round, round(median(duration_s) FILTER (n = 1), 4) AS alone_s, round(median(duration_s) FILTER (n >= 4), 4) AS crowd_s, count(*) FILTER (n = 1) AS n_alone, count(*) FILTER (n >= 4) AS n_crowd FROM p GROUP BY 1""",
    "laps",
)
def pit_window_pressure(t):
    return L.pit_window_pressure(L.pit_stops(t("laps")))


@query("SELECT *, s1_ms + s2_ms + s3_ms AS ideal_ms, best_ms - (s1_ms + s2_ms + s3_ms) AS unused_ms FROM (SELECT round, driver, min(s1_ms) AS s1_ms, min(s2_ms) AS s2_ms, min(s3_ms) AS s3_ms, min(lap_ms) AS best_ms FROM laps GROUP BY ALL)", "laps")
def best_sectors(t):
    return L.best_sectors(t("laps"))


@query("SELECT *, greatest(speed_i1, speed_i2, speed_fl, speed_st) AS top FROM (SELECT driver, round(max(speed_i1), 3) AS speed_i1, round(max(speed_i2), 3) AS speed_i2, round(max(speed_fl), 3) AS speed_fl, round(max(speed_st), 3) AS speed_st FROM laps GROUP BY 1)", "laps")
def speed_traps(t):
    return L.speed_traps(t("laps"))


@query(
    """WITH b AS (SELECT round, team, driver, min(lap_ms) AS ms FROM laps GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY round, team ORDER BY ms, driver) AS k, count(*) OVER (PARTITION BY round, team) AS n FROM b)
    SELECT round, team, max(driver) FILTER (k = 1) AS faster, max(driver) FILTER (k = 2) AS slower, max(ms) FILTER (k = 2) - max(ms) FILTER (k = 1) AS gap_ms,
    round((max(ms) FILTER (k = 2) - max(ms) FILTER (k = 1)) / max(ms) FILTER (k = 1) * 100, 4) AS gap_pct FROM k WHERE n = 2 GROUP BY 1, 2""",
    "laps",
)
def teammate_duels(t):
    return L.teammate_duels(t("laps"))


@query()
def elo_history(t):
    d = L.teammate_duels(t("laps")).select(F.lit(1).alias("grp"), F.struct("round", "team").alias("ord"), F.col("faster").alias("winner"), F.col("slower").alias("loser"))
    return R.elo(d)


@query("SELECT round, lap_number, max(end_ms) - min(end_ms) AS spread_ms, count(*) AS n_cars FROM laps GROUP BY ALL", "laps")
def field_spread(t):
    return L.field_spread(t("laps"))


@query("SELECT round, lap_number, compound, round(n / sum(n) OVER w, 4) AS share FROM (SELECT round, lap_number, compound, count(*) AS n FROM laps GROUP BY ALL) WINDOW w AS (PARTITION BY round, lap_number) QUALIFY row_number() OVER (PARTITION BY round, lap_number ORDER BY n DESC, compound) = 1", "laps")
def common_compound(t):
    return L.common_compound(t("laps"))


ROLLING = "(SELECT driver, lap_number, round(m, 4) AS rolling_s FROM (SELECT driver, lap_number, median(lap_time_s) OVER w AS m, count(*) OVER w AS n FROM laps WINDOW w AS (PARTITION BY driver ORDER BY lap_number ROWS 4 PRECEDING)) WHERE n >= 3)"


@query(f"SELECT * FROM {ROLLING}", "laps")
def rolling_pace(t):
    return L.rolling_pace(t("laps"))


@query(f"SELECT * FROM {ROLLING} QUALIFY row_number() OVER (PARTITION BY driver ORDER BY lap_number DESC) = 1", "laps")
def current_board(t):
    return L.current_board(L.rolling_pace(t("laps")))


@query("SELECT round, lap_number, driver, min(position) AS position FROM laps GROUP BY ALL", "laps")
def position_progression(t):
    return R.position_progression(t("placed_laps"))


TEAMS = range(25)  # the stand-in's teams are the 25 nations


@query("SELECT round, lap_number, " + ", ".join(f'min(position) FILTER (team = {k}) AS "{k}"' for k in TEAMS) + " FROM laps GROUP BY 1, 2", "laps")
def team_positions(t):
    return R.position_table(t("laps"), "team", list(TEAMS))


@query(f"WITH {PREV} SELECT * FROM {EVENTS}", "laps")
def overtake_events(t):
    return R.overtake_events(t("laps"))


@query(f"WITH {PREV} SELECT round, gainer, loser, count(*) AS n FROM {EVENTS} GROUP BY ALL", "laps")
def overtakes_matrix(t):
    return R.overtakes_matrix(R.overtake_events(t("laps")))


@query(
    """WITH st AS (SELECT round, driver, lap_number AS stop FROM laps WHERE pit_in),
    duel AS (SELECT s.round, s.driver AS chaser, r.driver AS rival, s.stop FROM st s JOIN laps c ON c.driver = s.driver AND c.lap_number = s.stop - 1
      JOIN laps r ON r.round = s.round AND r.lap_number = s.stop - 1 AND r.position = c.position - 1),
    met AS (SELECT d.*, min(x.stop) AS rival_stop FROM duel d JOIN st x ON x.driver = d.rival AND x.stop BETWEEN d.stop AND d.stop + 3 GROUP BY ALL HAVING min(x.stop) > d.stop)
    SELECT m.*, a.position < b.position AS success FROM met m JOIN laps a ON a.driver = m.chaser AND a.lap_number = m.rival_stop + 2 JOIN laps b ON b.driver = m.rival AND b.lap_number = m.rival_stop + 2""",
    "laps",
)
def undercut_duels(t):
    return R.undercut_duels(t("laps"))


@query("SELECT season, msg_id, CAST(nullif(regexp_extract(message, '(\\d+) SECOND', 1), '') AS BIGINT) AS seconds, regexp_extract(message, '(TIME PENALTY|STOP/GO PENALTY|DRIVE THROUGH PENALTY|REPRIMAND)', 1) AS kind, CAST(regexp_extract(message, 'FOR CAR (\\d+)', 1) AS BIGINT) AS car, regexp_extract(message, '\\((\\w+)\\)', 1) AS code, nullif(regexp_extract(message, ' - (.*)', 1), '') AS reason FROM race_control WHERE regexp_matches(message, '(PENALTY|REPRIMAND) FOR CAR')", "race_control")
def penalties_parsed(t):
    return R.penalties(t("race_control"))


LIMITS = "(SELECT season, msg_id, CAST(regexp_extract(message, 'CAR (\\d+)', 1) AS BIGINT) AS car, regexp_extract(message, '\\((\\w+)\\)', 1) AS code, CAST(regexp_extract(message, 'AT TURN (\\d+)', 1) AS BIGINT) AS turn, CAST(regexp_extract(message, 'LAP (\\d+)$', 1) AS BIGINT) AS lap FROM race_control WHERE contains(message, 'TRACK LIMITS AT TURN'))"


@query(f"SELECT * FROM {LIMITS}", "race_control")
def track_limits_parsed(t):
    return R.track_limits(t("race_control"))


GONE = "(SELECT DISTINCT driver AS car, lap_number AS lap FROM laps WHERE coalesce(deleted, false))"


def _deleted(t):
    return t("laps").where(F.coalesce("deleted", F.lit(False))).select(F.col("driver").alias("car"), F.col("lap_number").alias("lap")).distinct()


@query(f"SELECT * FROM {LIMITS} l WHERE NOT EXISTS (SELECT 1 FROM {GONE} g WHERE g.car = l.car AND g.lap = l.lap)", "race_control", "laps")
def track_limit_crosscheck(t):
    return R.limits_without_deletion(R.track_limits(t("race_control")), _deleted(t))


@query(f"SELECT * FROM {GONE} g WHERE NOT EXISTS (SELECT 1 FROM {LIMITS} l WHERE g.car = l.car AND g.lap = l.lap)", "race_control", "laps")
def deleted_reason_crosscheck(t):
    return R.deletions_without_limits(R.track_limits(t("race_control")), _deleted(t))


@query("SELECT m.car, season, msg_id, lap, min(team) AS team FROM race_control m LEFT JOIN (SELECT DISTINCT driver AS car, team FROM laps) c ON m.car = c.car WHERE flag = 'BLUE' GROUP BY m.car, season, msg_id, lap", "race_control", "laps")
def blue_flags(t):
    return R.blue_flags(t("race_control"), t("laps").groupBy(F.col("driver").alias("car")).agg(F.min("team").alias("team")))


@query("SELECT season, round, driver, round(avg(points) OVER (PARTITION BY driver ORDER BY season, round ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS form FROM results", "results")
def team_form_shifted(t):
    return R.shifted_form(t("results"))


@query("SELECT a.season, a.round, a.driver, a.position, b.position AS last_position FROM results a LEFT JOIN results b ON a.season = b.season + 1 AND a.round = b.round AND a.driver = b.driver", "results")
def previous_season_position(t):
    return R.previous_season(t("results"))


@query("SELECT season, driver AS champion, points, round(points / sum(points) OVER (PARTITION BY season), 4) AS share FROM (SELECT season, driver, CAST(sum(points) AS BIGINT) AS points FROM results GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY season ORDER BY points DESC, driver) = 1", "results")
def season_dominance(t):
    return R.season_dominance(t("results"))


@query("SELECT season, round(1 - avg(CASE WHEN regexp_matches(status, '^(Finished|\\+\\d+ Lap)') THEN 1.0e0 ELSE 0 END), 4) AS dnf_rate, count(*) AS n_entries FROM results GROUP BY 1", "results")
def dnf_rate(t):
    return R.retirement_rate(t("results"))


@query("SELECT season, count(DISTINCT round) AS n_rounds, count(DISTINCT team) AS n_teams FROM results GROUP BY 1", "results")
def calendar_size(t):
    return R.calendar_size(t("results"))


@query("SELECT season, round, driver, points, points + (12 - round) * 25 >= max(points) OVER (PARTITION BY season, round) AS alive FROM (SELECT season, round, driver, CAST(sum(points) OVER (PARTITION BY season, driver ORDER BY round) AS BIGINT) AS points FROM results)", "results")
def title_chances(t):
    return R.title_chances(t("results"), 12)


@query("SELECT grid, round(avg(grid - position), 4) AS mean_gain, count(*) FILTER (position = 1) AS wins, count(*) AS n FROM results GROUP BY 1", "results")
def grid_to_finish(t):
    return R.grid_to_finish(t("results"))


PURCHASES = "(SELECT driver, t_us, speed FROM telemetry WHERE source = 'purchase')"


@query(f"SELECT c.driver, c.t_us, p.t_us AS matched_t_us, p.speed AS speed FROM (SELECT driver, t_us FROM telemetry WHERE source = 'click') c ASOF LEFT JOIN {PURCHASES} p ON c.driver = p.driver AND c.t_us >= p.t_us", "telemetry")
def asof_lap(t):
    d = t("telemetry")
    return T.asof_join(d.where("source = 'click'").select("driver", "t_us"), d.where("source = 'purchase'").select("driver", "t_us", "speed"), ["driver"], "t_us", ["speed"])


@query("SELECT s.session, s.t_us, s.status, w.t_us AS matched_t_us, w.track_temp, w.rainfall FROM status_log s ASOF LEFT JOIN weather w ON s.session = w.session AND s.t_us >= w.t_us", "status_log", "weather")
def weather_join(t):
    return T.asof_join(t("status_log"), t("weather"), ["session"], "t_us", ["track_temp", "rainfall"])


@query("SELECT session, island, bool_or(rainfall) AS rainfall, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS n FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY session ORDER BY t_us) AS BIGINT) AS island FROM (SELECT *, CASE WHEN rainfall = lag(rainfall) OVER (PARTITION BY session ORDER BY t_us) THEN 0 ELSE 1 END AS c FROM weather)) GROUP BY ALL", "weather")
def weather_phases(t):
    d = T.with_islands(t("weather"), ["session"], "t_us", "rainfall")
    return d.groupBy("session", "island").agg(F.bool_or("rainfall").alias("rainfall"), F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count(F.lit(1)).alias("n"))


ISLANDS = "(SELECT *, CAST(sum(c) OVER (PARTITION BY driver ORDER BY ord) AS BIGINT) AS island FROM (SELECT *, CASE WHEN brake = lag(brake) OVER (PARTITION BY driver ORDER BY ord) THEN 0 ELSE 1 END AS c FROM telemetry))"


@query(f"SELECT driver, island, start_m, end_m, n, end_m - start_m AS length_m FROM (SELECT driver, island, arg_min(distance_m, ord) AS start_m, arg_max(distance_m, ord) AS end_m, count(*) AS n FROM {ISLANDS} WHERE brake GROUP BY 1, 2) WHERE end_m - start_m >= 20", "telemetry")
def active_zones(t):
    return T.active_zones(t("telemetry"), ["driver"], "brake", 20.0)


@query(
    f"""SELECT driver, island, round(d0, 2) AS start_m, round(d1, 2) AS end_m, round(d1 - d0, 2) AS length_m, round(v0, 2) AS v_start, round(v1, 2) AS v_min, round((v0 - v1) / 3.6e0 / greatest(t1 - t0, 1e-3) / 9.81e0, 4) AS decel_g FROM (
    SELECT driver, island, arg_min(distance_m, ord) AS d0, arg_max(distance_m, ord) AS d1, arg_min(speed, ord) AS v0, arg_max(speed, ord) AS v1, arg_min(t_s, ord) AS t0, arg_max(t_s, ord) AS t1 FROM {ISLANDS} WHERE brake GROUP BY 1, 2) WHERE d1 - d0 >= 20""",
    "telemetry",
)
def braking_zones(t):
    return T.braking_zones(t("telemetry"), ["driver"])


STATUS = "(SELECT session, t_us AS start_us, status, lead(t_us) OVER (PARTITION BY session ORDER BY t_us) AS end_us FROM (SELECT *, lag(status) OVER (PARTITION BY session ORDER BY t_us) AS b FROM status_log) WHERE b IS NULL OR b <> status)"


@query(f"SELECT * FROM {STATUS}", "status_log")
def status_intervals(t):
    return T.status_intervals(t("status_log"))


@query(
    f"""SELECT i.session, CASE status WHEN '1' THEN 'green' WHEN '2' THEN 'yellow' WHEN '4' THEN 'safety car' WHEN '5' THEN 'red' WHEN '6' THEN 'virtual safety car' ELSE status END AS phase,
    start_us, coalesce(end_us, last_us) AS end_us, coalesce(end_us, last_us) - start_us AS duration_us FROM {STATUS} i JOIN (SELECT session, max(t_us) AS last_us FROM status_log GROUP BY 1) l ON i.session = l.session""",
    "status_log",
)
def track_status_phases(t):
    log = t("status_log")
    return T.status_phases(T.status_intervals(log), log.groupBy("session").agg(F.max("t_us").alias("last_us")))


ZONES = "(SELECT driver AS key, distance_m AS start_m, distance_m + 30 AS end_m FROM telemetry WHERE drs = 10)"


def _zones(t):
    return t("telemetry").where("drs = 10").select(F.col("driver").alias("key"), F.col("distance_m").alias("start_m"), (F.col("distance_m") + 30).alias("end_m"))


@query(f"SELECT driver AS key, ord AS id, distance_m AS pos, EXISTS (SELECT 1 FROM {ZONES} z WHERE z.key = t.driver AND t.distance_m BETWEEN z.start_m AND z.end_m) AS inside FROM telemetry t", "telemetry")
def zone_membership(t):
    return T.zone_membership(t("telemetry").select(F.col("driver").alias("key"), F.col("ord").alias("id"), F.col("distance_m").alias("pos")), _zones(t))


@query(
    f"""WITH z AS {ZONES}, f AS (SELECT key, min(start_m) AS first_m FROM z GROUP BY 1), l AS (SELECT driver, max(distance_m) AS length FROM telemetry GROUP BY 1)
    SELECT t.driver AS key, t.ord AS id, round(coalesce(z.start_m, f.first_m + l.length) - t.distance_m, 4) AS lead_m FROM telemetry t ASOF LEFT JOIN z ON t.driver = z.key AND t.distance_m <= z.start_m
    LEFT JOIN f ON f.key = t.driver JOIN l ON l.driver = t.driver""",
    "telemetry",
)
def lead_distance_to_zone(t):
    p = t("telemetry").select(F.col("driver").alias("key"), F.col("ord").alias("id"), F.col("distance_m").alias("pos"))
    p = p.withColumn("length", F.max("pos").over(Window.partitionBy("key")))
    return T.lead_to_zone(p, _zones(t))


@query(
    """WITH a AS (SELECT driver AS grp, ord AS i, distance_m AS pos FROM telemetry WHERE source = 'click'), b AS (SELECT driver AS grp, ord AS j, distance_m AS pos FROM telemetry WHERE source = 'view'),
    n AS (SELECT a.grp, a.i, b.j, abs(a.pos - b.pos) AS d FROM a JOIN b ON a.grp = b.grp QUALIFY row_number() OVER (PARTITION BY a.grp, a.i ORDER BY abs(a.pos - b.pos), b.j) = 1)
    SELECT grp, i, j, round(d, 4) AS distance FROM n WHERE d <= 150 QUALIFY row_number() OVER (PARTITION BY grp, j ORDER BY i) = 1""",
    "telemetry",
)
def nearest_match(t):
    d = t("telemetry")
    pick = lambda s, n: d.where(F.col("source") == s).select(F.col("driver").alias("grp"), F.col("ord").alias(n), F.col("distance_m").alias("pos"))
    return T.match_by_distance(pick("click", "i"), pick("view", "j"), 150.0)


@query(
    """WITH d AS (SELECT *, coalesce(t_us - lag(t_us) OVER (PARTITION BY driver ORDER BY t_us), 0) AS dt, drs IN (10, 12, 14) AS o FROM telemetry),
    g AS (SELECT driver, CAST(sum(CASE WHEN o THEN dt ELSE 0 END) AS BIGINT) AS open_us, CAST(sum(dt) AS BIGINT) AS all_us, max(speed) FILTER (o) AS v_open, max(speed) FILTER (NOT o) AS v_closed FROM d GROUP BY 1)
    SELECT driver, open_us, round(open_us / all_us, 4) AS share, v_open, v_closed, round(v_open - v_closed, 4) AS gain FROM g""",
    "telemetry",
)
def drs_usage(t):
    return T.drs_usage(t("telemetry"))


@query()
def mini_sectors(t):
    return T.mini_sectors(t("telemetry"))


@query(
    """WITH top AS (SELECT lap_number, driver, min(distance_m) AS lo, max(distance_m) AS hi FROM telemetry GROUP BY ALL HAVING max(distance_m) > min(distance_m)),
    c AS (SELECT lap_number, min(hi - lo) AS len FROM top GROUP BY 1 HAVING count(DISTINCT driver) >= 2 AND min(hi - lo) > 0),
    s AS (SELECT *, lead(x) OVER w AS to_x, lead(y) OVER w AS to_y, (distance_m + lead(distance_m) OVER w) / 2 AS middle FROM telemetry WINDOW w AS (PARTITION BY lap_number, driver ORDER BY ord))
    SELECT s.lap_number, s.driver, ord, x, y, to_x, to_y, greatest(1, least(25, CAST(floor((middle - lo) / len * 25) AS BIGINT) + 1)) AS edge
    FROM s JOIN top ON s.lap_number = top.lap_number AND s.driver = top.driver JOIN c ON s.lap_number = c.lap_number WHERE middle IS NOT NULL""",
    "telemetry",
)
def segment_sectors(t):
    return T.segment_sectors(t("telemetry"))


@query()
def track_winners(t):
    return T.track_winners(t("telemetry"))


@query("SELECT driver, lap_number, round(sum(step) + any_value(back), 3) AS length FROM (SELECT driver, lap_number, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step, sqrt((first(x) OVER v - last(x) OVER v) ** 2 + (first(y) OVER v - last(y) OVER v) ** 2) AS back FROM telemetry WINDOW w AS (PARTITION BY driver, lap_number ORDER BY ord), v AS (PARTITION BY driver, lap_number ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY 1, 2", "telemetry")
def path_length(t):
    return T.path_length(t("telemetry"), ["driver", "lap_number"])


@query()
def elevation(t):
    return T.elevation(t("telemetry"), ["driver", "lap_number"])


@query("SELECT driver, ord, speed FROM (SELECT *, row_number() OVER (PARTITION BY driver ORDER BY ord) - 1 AS i, greatest(floor(count(*) OVER (PARTITION BY driver) / 20), 1) AS k FROM telemetry) WHERE i % k = 0", "telemetry")
def downsample(t):
    return T.downsample(t("telemetry"), ["driver"], "ord", 20).select("driver", "ord", "speed")


@query(
    """WITH d AS (SELECT *, throttle >= max(throttle) OVER (PARTITION BY driver) - 2 AS f, abs(throttle - lag(throttle) OVER w) AS m, coalesce(gear <> lag(gear) OVER w, true) AS s FROM telemetry WINDOW w AS (PARTITION BY driver ORDER BY ord))
    SELECT driver, round(avg(f::INT) * 100, 4) AS full_pct, round(avg(brake::INT) * 100, 4) AS brake_pct, round(avg((NOT brake AND throttle < 5)::INT) * 100, 4) AS coast_pct, round(avg((brake AND throttle > 5)::INT) * 100, 4) AS overlap_pct,
    CAST(sum(m) AS BIGINT) AS throttle_moves, count(*) FILTER (s) AS gear_changes FROM d GROUP BY 1""",
    "telemetry",
)
def style_features(t):
    return T.style_features(t("telemetry"))


@query("SELECT driver, lap_number, max(speed) AS v_max, round(avg(speed), 4) AS v_mean, round(avg(throttle), 4) AS throttle, round(avg(brake::INT) * 100, 4) AS brake_pct, round(avg(gear), 4) AS gear, count(*) AS n FROM telemetry GROUP BY 1, 2 HAVING count(*) >= 3", "telemetry")
def lap_profiles(t):
    return T.lap_profile(t("telemetry"))


@query("SELECT driver, round(avg((source = 'view')::INT), 4) AS car, round(avg((source = 'click')::INT), 4) AS pos, round(avg((source = 'error')::INT), 4) AS interpolation FROM telemetry GROUP BY 1", "telemetry")
def source_quality(t):
    return T.source_quality(t("telemetry"))


@query(
    """WITH g AS (SELECT round, avg(lap_time_s) FILTER (fresh_tyre) AS m1, avg(lap_time_s) FILTER (NOT fresh_tyre) AS m0, var_samp(lap_time_s) FILTER (fresh_tyre) AS v1, var_samp(lap_time_s) FILTER (NOT fresh_tyre) AS v0,
      count(*) FILTER (fresh_tyre) AS n1, count(*) FILTER (NOT fresh_tyre) AS n0 FROM laps GROUP BY 1)
    SELECT round, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t, round((v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)), 4) AS dof, n1, n0 FROM g""",
    "laps",
)
def ttest_parity(t):
    return S.t_statistic(t("laps"), ["round"], "lap_time_s", "fresh_tyre")


@query(
    """WITH r AS (SELECT *, rank() OVER (PARTITION BY round ORDER BY lap_ms) + (count(*) OVER (PARTITION BY round, lap_ms) - 1) / 2.0e0 AS r FROM laps)
    SELECT round, sum(r) FILTER (fresh_tyre) - count(*) FILTER (fresh_tyre) * (count(*) FILTER (fresh_tyre) + 1) / 2 AS u, count(*) FILTER (fresh_tyre) AS n1, count(*) FILTER (NOT fresh_tyre) AS n0 FROM r GROUP BY 1""",
    "laps",
)
def rank_statistics(t):
    return S.mann_whitney(t("laps"), ["round"], "lap_ms", "fresh_tyre")


@query(
    """WITH d AS (SELECT season, grid - position AS d FROM results WHERE grid <> position), r AS (SELECT *, rank() OVER (PARTITION BY season ORDER BY abs(d)) + (count(*) OVER (PARTITION BY season, abs(d)) - 1) / 2.0e0 AS r FROM d)
    SELECT season, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus, count(*) AS n FROM r GROUP BY 1""",
    "results",
)
def signed_ranks(t):
    return S.wilcoxon(t("results").select("season", (F.col("grid") - F.col("position")).alias("d")), ["season"], "d")


@query(
    """WITH r AS (SELECT season, rank() OVER (PARTITION BY season ORDER BY grid) + (count(*) OVER (PARTITION BY season, grid) - 1) / 2.0e0 AS a, rank() OVER (PARTITION BY season ORDER BY position) + (count(*) OVER (PARTITION BY season, position) - 1) / 2.0e0 AS b FROM results)
    SELECT season, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY 1""",
    "results",
)
def rank_correlation(t):
    return S.spearman(t("results"), ["season"], "grid", "position")


@query(
    """WITH c AS (SELECT season, count(*) FILTER (grid <= 10 AND position <= 10)::DOUBLE AS p, count(*) FILTER (grid <= 10 AND position > 10)::DOUBLE AS q, count(*) FILTER (grid > 10 AND position <= 10)::DOUBLE AS r, count(*) FILTER (grid > 10 AND position > 10)::DOUBLE AS s FROM results GROUP BY 1)
    SELECT season, round((p + q + r + s) * greatest(abs(p * s - q * r) - (p + q + r + s) / 2, 0) ** 2 / ((p + q) * (r + s) * (p + r) * (q + s)), 6) AS chi2 FROM c WHERE (p + q) * (r + s) * (p + r) * (q + s) > 0""",
    "results",
)
def chi_square(t):
    return S.chi_square(t("results").select("season", (F.col("grid") <= 10).alias("a"), (F.col("position") <= 10).alias("b")), ["season"], "a", "b")


FORECAST = "(SELECT season, round, driver, 1 - (grid - 1) / 25e0 AS score, (position <= 10)::INT AS won FROM results)"


def _forecast(t):
    return t("results").select("season", "round", "driver", (1 - (F.col("grid") - 1) / 25).alias("score"), (F.col("position") <= 10).cast("int").alias("won"))


@query(f"SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, round(avg(score), 6) AS mean_score, round(avg(won), 6) AS rate, count(*) AS n FROM {FORECAST} GROUP BY 1", "results")
def calibration_bins(t):
    return S.calibration(_forecast(t), "score", "won")


@query(
    f"""WITH r AS (SELECT *, rank() OVER (PARTITION BY season ORDER BY score) + (count(*) OVER (PARTITION BY season, score) - 1) / 2.0e0 AS r FROM {FORECAST})
    SELECT season, round(avg((score - won) ** 2), 6) AS brier, round((sum(r * won) - sum(won) * (sum(won) + 1) / 2) / nullif(sum(won) * (count(*) - sum(won)), 0), 6) AS auc FROM r GROUP BY 1""",
    "results",
)
def forecast_scores(t):
    return S.scores(_forecast(t), ["season"], "score", "won")


@query(
    """WITH g AS (SELECT round, covar_pop(tyre_life, tyre_life) AS aa, covar_pop(lap_number, lap_number) AS bb, covar_pop(tyre_life, lap_number) AS ab, covar_pop(tyre_life, lap_time_s) AS ay, covar_pop(lap_number, lap_time_s) AS by_, var_pop(lap_time_s) AS yy, count(*) AS n FROM laps GROUP BY 1)
    SELECT round, round((ay * bb - by_ * ab) / (aa * bb - ab * ab), 6) AS coef_a, round((by_ * aa - ay * ab) / (aa * bb - ab * ab), 6) AS coef_b, round(((ay * bb - by_ * ab) * ay + (by_ * aa - ay * ab) * by_) / (aa * bb - ab * ab) / yy, 6) AS r2, n FROM g""",
    "laps",
)
def temperature_regression(t):
    return S.two_regressors(t("laps"), ["round"], "lap_time_s", "tyre_life", "lap_number")


@query()
def bootstrap_ci(t):
    return S.bootstrap_median(t("laps"), ["round", "driver"], "lap_time_s")


@query()
def championship_mc(t):
    return S.title_odds(t("results"))


@query(
    f"""WITH s AS (SELECT compound, round(avg(slope), 4) AS slope FROM {FITS} WHERE reliable GROUP BY 1)
    SELECT o.compound AS old, w.compound AS new, n_laps, penalty, round(o.slope * n_laps * (n_laps + 1) / 2 - w.slope * n_laps * (n_laps - 1) / 2 - penalty + 1e-8, 6) AS gain_s FROM s o, s w, range(1, 11) r(n_laps), (VALUES (0.0e0), (0.5e0), (1.0e0)) p(penalty)""",
    "laps",
)
def undercut_gain_grid(t):
    """From the measured wear of each compound."""
    fits = L.degradation_by(L.degradation(t("laps"), 100.0, 4).where("reliable"), "compound")
    return G.undercut_gains(fits.select("compound", F.col("mean_slope").alias("slope")))


def _tyres(t):
    """Three tyre models whose pace comes from the parts table's sizes."""
    m = t("part").select((F.col("p_size") % 3).alias("k"), "p_size").groupBy("k").agg(F.avg("p_size").alias("m"))
    return m.select(F.concat(F.lit("C"), F.col("k")).alias("compound"), F.round(90 + F.col("m") / 100, 3).alias("base"), F.round(0.05 + 0.05 * F.col("k"), 3).alias("lin"), F.lit(0.001).alias("quad"), (30 - 5 * F.col("k")).cast("int").alias("max_age"))


TYRES = "(SELECT 'C' || k AS compound, round(90 + m / 100, 3) AS base, round(0.05e0 + 0.05e0 * k, 3) AS lin, 0.001e0 AS quad, 30 - 5 * k AS max_age FROM (SELECT p_size % 3 AS k, avg(p_size) AS m FROM part GROUP BY 1))"


@query(
    f"""SELECT compound, a AS first, b AS last, round(base * (b - a + 1) + lin * (b - a + 1) * (b - a) / 2 + quad * (b - a) * (b - a + 1) * (2 * (b - a + 1) - 1) / 6 + CASE WHEN a > 1 THEN 20e0 ELSE 0 END, 6) AS cost
    FROM {TYRES}, range(1, 41) x(a), range(1, 41) y(b) WHERE b - a + 1 BETWEEN 5 AND max_age AND (b = 40 OR 40 - b >= 5) AND (a = 1 OR a - 1 >= 5)"""
)
def stint_arcs(t):
    return G.stint_arcs(_tyres(t), 40, 20.0, 5)


@query()
def optimal_strategy(t):
    arcs = G.stint_arcs(_tyres(t), 40, 20.0, 5)
    losses = t("region").select(F.col("r_regionkey").cast("bigint").alias("scenario"))
    dear = arcs.join(losses, F.lit(True)).withColumn("cost", F.col("cost") + F.when(F.col("first") > 1, F.col("scenario") * 5.0).otherwise(0.0))
    return G.best_strategies(dear, ["scenario"], 40)


@query()
def gap_evolution(t):
    d = t("laps").select(F.col("driver").alias("grp"), "lap_number", (F.col("lap_ms") % 1000 / 1000 - 0.55).alias("delta"), (F.col("lap_ms") % 4 == 0).alias("passes"), F.lit(1.0).alias("gap0"))
    return G.gap_evolution(d.withColumnRenamed("lap_number", "lap"))


MART = f"(SELECT *, median_s / min(median_s) OVER (PARTITION BY round) AS rel_pace FROM (SELECT round, driver, count(*) AS n_laps, median(lap_time_s) AS median_s FROM {clean(4.0)} GROUP BY ALL HAVING count(*) >= 5))"


@query(f"SELECT round, driver, n_laps, round(median_s, 4) AS median_s, round(rel_pace, 6) AS rel_pace FROM {MART}", "laps")
def mart_driver_pace(t):
    d = D.driver_pace(L.clean_laps(t("laps"), 4.0), ["round"])
    return d.withColumns({"median_s": F.round("median_s", 4), "rel_pace": F.round("rel_pace", 6)})


@query(f"SELECT s_name AS name, count(*) AS events, round(avg(rel_pace), 4) AS mean_rel_pace FROM {MART} JOIN supplier ON s_suppkey = driver GROUP BY 1 ORDER BY 3, 1 LIMIT 10", "laps")
def fastest_names(t):
    """Each driver at hand has one round, so one event is enough."""
    names = t("supplier").select(F.col("s_suppkey").alias("driver"), F.col("s_name").alias("name"))
    return D.pace_by_name(D.driver_pace(L.clean_laps(t("laps"), 4.0), ["round"]), names, ["driver"], 1)


@query("SELECT round, compound, round(median(lap_time_s), 3) AS median_s, count(*) AS n FROM laps GROUP BY ALL HAVING count(*) > 50", "laps")
def mart_degradation(t):
    return t("laps").groupBy("round", "compound").agg(F.round(F.median("lap_time_s"), 3).alias("median_s"), F.count(F.lit(1)).alias("n")).where("n > 50")


@query(f"WITH {PREV} SELECT round, count(*) AS n_events, count(DISTINCT gainer) AS n_gainers FROM {EVENTS} GROUP BY 1", "laps")
def mart_overtakes_by_event(t):
    return R.overtake_events(t("laps")).groupBy("round").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("gainer").alias("n_gainers"))


@query(
    """SELECT 'lap_time_positive' AS test, count(*) FILTER (lap_ms <= 0) AS failures FROM laps UNION ALL SELECT 'position_present', count(*) FILTER (position IS NULL) FROM laps
    UNION ALL SELECT 'stint_positive', count(*) FILTER (stint < 1) FROM laps UNION ALL SELECT 'not_empty', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM laps""",
    "laps",
)
def quality_assertions(t):
    one = t("laps").agg(F.count_if(F.col("lap_ms") <= 0).alias("lap_time_positive"), F.count_if(F.col("position").isNull()).alias("position_present"), F.count_if(F.col("stint") < 1).alias("stint_positive"), F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("bigint").alias("not_empty"))
    return one.unpivot([], one.columns, "test", "failures")


AHEAD = "(SELECT round, lap_number, driver, lag(driver) OVER w AS ahead, end_ms - lag(end_ms) OVER w AS gap_ms FROM laps WINDOW w AS (PARTITION BY round, lap_number ORDER BY position))"


@query(f"SELECT * FROM {AHEAD}", "laps")
def car_ahead(t):
    return K.car_ahead(t("laps"))


@query(f"SELECT driver, round(median(nullif(gap_ms, 0)), 4) AS median_ms, min(nullif(gap_ms, 0)) AS least_ms, round(avg((nullif(gap_ms, 0) < 500000)::INT), 4) AS near_share FROM {AHEAD} WHERE ahead IS NOT NULL GROUP BY 1", "laps")
def close_following(t):
    return K.close_following(t("laps"))


@query(
    f"""WITH d AS (SELECT l.driver, l.tyre_life, l.lap_time_s, (g.gap_ms < 500000)::INT::DOUBLE AS near FROM laps l JOIN {AHEAD} g ON l.driver = g.driver AND l.lap_number = g.lap_number AND g.gap_ms > 0),
    f AS (SELECT driver, regr_slope(lap_time_s, tyre_life) AS s, regr_intercept(lap_time_s, tyre_life) AS i FROM d GROUP BY 1),
    r AS (SELECT d.driver, near, tyre_life, lap_time_s - s * tyre_life - i AS rest FROM d JOIN f ON d.driver = f.driver)
    SELECT driver, round(regr_slope(rest, near) + 1e-7, 4) AS cost_s, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT tyre_life) >= 2 AND count(DISTINCT near) = 2""",
    "laps",
)
def dirty_air(t):
    return K.dirty_air(t("laps"))


@query(
    """WITH s AS (SELECT *, t_us - min(t_us) OVER (PARTITION BY driver) AS u, distance_m - min(distance_m) OVER (PARTITION BY driver) AS d FROM telemetry)
    SELECT driver, round(min(u / 1e6) FILTER (speed >= 40), 3) AS t_first, round(min(u / 1e6) FILTER (speed >= 80), 3) AS t_second, round(max(d) FILTER (u / 1e6 <= 86400), 3) AS distance_m FROM s GROUP BY 1""",
    "telemetry",
)
def start_metrics(t):
    return K.start_metrics(t("telemetry"), ["driver"])


@query(
    """WITH c AS (SELECT driver, ord AS corner, distance_m AS at_m FROM telemetry WHERE source = 'purchase')
    SELECT t.driver, corner, min(speed) AS v_min, count(*) AS n FROM telemetry t JOIN c ON t.driver = c.driver AND abs(t.distance_m - c.at_m) < 60 GROUP BY 1, 2""",
    "telemetry",
)
def corner_min_speed(t):
    d = t("telemetry")
    return K.corner_min_speed(d, d.where("source = 'purchase'").select("driver", F.col("ord").alias("corner"), F.col("distance_m").alias("at_m")), "driver")


@query(
    """WITH c AS (SELECT driver, ord AS id, x AS px, y + 3 AS py FROM telemetry WHERE source = 'error')
    SELECT driver, id, distance_m, round(d, 4) AS apart FROM (SELECT t.driver, id, distance_m, sqrt((x - px) ** 2 + (y - py) ** 2) AS d, row_number() OVER (PARTITION BY t.driver, id ORDER BY sqrt((x - px) ** 2 + (y - py) ** 2), t.ord) AS k
    FROM telemetry t JOIN c ON t.driver = c.driver) WHERE k = 1""",
    "telemetry",
)
def nearest_sample(t):
    d = t("telemetry")
    return K.nearest_sample(d.where("source = 'error'").select("driver", F.col("ord").alias("id"), "x", (F.col("y") + 3).alias("y")), d, "driver")


@query(
    """WITH f AS (SELECT round, lap_number, max(end_ms) - min(end_ms) AS s FROM laps GROUP BY 1, 2), p AS (SELECT DISTINCT round, lap_number AS lap_start, lap_number + 2 AS lap_end FROM laps WHERE lap_number % 25 = 10),
    g AS (SELECT p.round, lap_start AS phase_id, median(s) FILTER (lap_number < lap_start) AS before_ms, min(s) FILTER (lap_number >= lap_start) AS inside_ms FROM p JOIN f ON p.round = f.round AND lap_number BETWEEN lap_start - 3 AND lap_end GROUP BY 1, 2)
    SELECT *, round((1 - inside_ms / before_ms) * 100, 4) AS compaction_pct FROM g WHERE before_ms > 0""",
    "laps",
)
def sc_compaction(t):
    laps = t("laps")
    phases = laps.where("lap_number % 25 = 10").select("round", F.col("lap_number").alias("phase_id"), F.col("lap_number").alias("lap_start"), (F.col("lap_number") + 2).alias("lap_end")).distinct()
    return K.neutral_compaction(L.field_spread(laps), phases)


@query(
    """WITH e AS (SELECT driver, lap_number * 50000 AS t_ms FROM laps WHERE lap_number % 7 = 0), s AS (SELECT driver, end_ms - lap_ms AS at_ms, lap_number, s1_ms, s2_ms FROM laps)
    SELECT e.driver, e.t_ms, s.lap_number, CASE WHEN s.lap_number IS NULL THEN NULL WHEN t_ms - at_ms < s1_ms THEN 1 WHEN t_ms - at_ms < s1_ms + s2_ms THEN 2 ELSE 3 END AS sector FROM e ASOF LEFT JOIN s ON e.driver = s.driver AND e.t_ms >= s.at_ms""",
    "laps",
)
def sc_deployment_sector(t):
    laps = t("laps")
    return K.sector_at(laps.where("lap_number % 7 = 0").select("driver", (F.col("lap_number") * 50000).alias("t_ms")), laps)


@query()
def dtw_profiles(t):
    """Each driver's mean speed by day, against the driver with the next number; a month bounds a profile."""
    days = t("telemetry").groupBy("driver", "lap_number").agg(F.avg("speed").alias("v"))
    d = days.groupBy("driver").agg(F.array_sort(F.collect_list(F.struct("lap_number", "v"))).alias("s")).select(F.lit(0).alias("track"), "driver", F.col("s.v").alias("v"))
    return K.dtw_pairs(d, "track", d.select("track", F.col("driver").alias("driver_a"), (F.col("driver") + 1).alias("driver_b")))


@query()
def kmeans_clusters(t):
    return M.best_clusters(T.style_features(t("telemetry")), ["full_pct", "brake_pct", "coast_pct", "overlap_pct"])


@query()
def gbt_position(t):
    d = R.shifted_form(t("results")).join(t("results").select("season", "round", "driver", "grid", (F.col("position") <= 3).cast("int").alias("podium")), ["season", "round", "driver"]).na.fill({"form": 0.0})
    last = d.select(F.max("season").alias("last"))
    d = d.join(last, F.lit(True))
    return M.podium_chances(d.where("season < last").drop("last"), d.where("season = last").drop("last"), ["form", "grid"], "podium", "gbt")


@query()
def podium_logistic(t):
    d = t("results").select("season", "round", "driver", "grid", (F.col("position") <= 3).cast("int").alias("podium"))
    d = d.join(d.select(F.max("season").alias("last")), F.lit(True))
    return M.podium_chances(d.where("season < last").drop("last"), d.where("season = last").drop("last"), ["grid"], "podium")


@query()
def anomaly_laps(t):
    return M.anomaly_flags(T.lap_profile(t("telemetry")), ["v_max", "v_mean", "throttle", "brake_pct", "gear"])


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS season, n_name AS country, count(*) AS n_events, lower(r_name) IN ('asia', 'america') AS is_sprint FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def event_dimension(t):
    d = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return d.groupBy(F.year("o_orderdate").cast("bigint").alias("season"), F.col("n_name").alias("country"), F.lower("r_name").isin("asia", "america").alias("is_sprint")).agg(F.count(F.lit(1)).alias("n_events"))


@query("SELECT l.* FROM (SELECT DISTINCT season, round FROM results) l ANTI JOIN (SELECT DISTINCT season, round FROM results WHERE round % 3 = 0) m ON l.season = m.season AND l.round = m.round", "results")
def load_manifest_delta(t):
    d = t("results").select("season", "round").distinct()
    return d.join(d.where("round % 3 = 0"), ["season", "round"], "left_anti")


@query("SELECT round, driver, lap_number, lap_ms, compound FROM laps WHERE NOT pit_in AND NOT pit_out QUALIFY row_number() OVER (PARTITION BY round ORDER BY lap_ms, driver, lap_number) = 1", "laps")
def fastest_lap(t):
    return L.fastest_laps(t("laps"), ["round"])


@query("SELECT round, driver, lap_number, lap_ms FROM laps QUALIFY row_number() OVER (PARTITION BY round, driver ORDER BY lap_ms, lap_number) <= 3", "laps")
def quickest_three(t):
    return L.n_quickest(t("laps"), ["round", "driver"], 3)


@query("SELECT driver, t_us, speed FROM telemetry WHERE t_us >= (SELECT min(t_us) FROM telemetry) + 60000000 AND t_us < (SELECT min(t_us) FROM telemetry) + 86400000000", "telemetry")
def time_slice(t):
    return T.time_slice(t("telemetry"), "t_us", 60_000_000, 86_400_000_000).select("driver", "t_us", "speed")


@query("SELECT round, driver, lap_number, row_number() OVER (PARTITION BY round, driver ORDER BY lap_number) - 1 AS nth_stop FROM laps WHERE pit_in", "laps")
def stop_numbers(t):
    return L.stop_numbers(t("laps"), ["round", "driver"])


@query("SELECT season, team, count(*) FILTER (WHERE position = 1) AS p1, count(*) FILTER (WHERE position = 2) AS p2, count(*) FILTER (WHERE position = 3) AS p3 FROM results GROUP BY ALL", "results")
def podium_matrix(t):
    return R.podium_matrix(t("results"))


@query("SELECT season, round, team, points, round(avg(points) OVER (PARTITION BY team ORDER BY season, round ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS form FROM (SELECT season, round, team, CAST(sum(points) AS BIGINT) AS points FROM results GROUP BY ALL)", "results")
def team_form(t):
    return R.team_form(t("results"))


@query("SELECT season, r.round, r.driver, grid, l.position AS lap1, grid - l.position AS gained FROM results r JOIN laps l ON r.season = l.round + 1991 AND r.round = l.round AND r.driver = l.driver AND l.lap_number = 1", "results", "laps")
def first_lap_gains(t):
    return R.first_lap_gains(t("results"), t("laps").withColumn("season", F.col("round") + 1991))  # the laps at hand: a season for each round


@query("SELECT season, r.round, r.driver, position, coalesce(n, 0) AS n_stops FROM results r LEFT JOIN (SELECT round, driver, count(*) AS n FROM laps WHERE pit_in GROUP BY 1, 2) s ON r.season = s.round + 1991 AND r.round = s.round AND r.driver = s.driver", "results", "laps")
def stops_and_results(t):
    return R.stops_and_results(t("results"), t("laps").withColumn("season", F.col("round") + 1991))


@query("SELECT season, round, team, string_agg(CAST(driver AS VARCHAR), ',' ORDER BY position, driver) AS drivers FROM results GROUP BY ALL", "results")
def winner_order(t):
    return R.winner_order(t("results"))


@query("SELECT s.*, l.lap_number IS NOT NULL AS seen FROM (SELECT round, driver, unnest(range(1, max(lap_number) + 1)) AS lap_number FROM laps WHERE NOT pit_in GROUP BY 1, 2) s LEFT JOIN (SELECT * FROM laps WHERE NOT pit_in) l ON s.round = l.round AND s.driver = l.driver AND s.lap_number = l.lap_number", "laps")
def lap_spine(t):
    return L.lap_spine(t("laps").where("not pit_in"), ["round", "driver"])


@query("SELECT *, coalesce(CAST(sum(n_laps) OVER (PARTITION BY round, driver ORDER BY stint ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start_at FROM (SELECT round, driver, stint, count(*) AS n_laps FROM laps GROUP BY ALL)", "laps")
def stint_offsets(t):
    return L.stint_offsets(t("laps"))


@query(f"SELECT s.round, CASE WHEN regexp_matches(track_status, '[467]') THEN 'neutral' WHEN track_status = '1' THEN 'green' ELSE 'other' END AS kind, count(*) AS n_stops, round(median(duration_s), 4) AS median_s FROM {STOPS} s JOIN laps l ON s.round = l.round AND s.driver = l.driver AND s.in_lap = l.lap_number GROUP BY 1, 2", "laps")
def neutral_stops(t):
    return L.neutral_stops(L.pit_stops(t("laps")), t("laps"))


@query("SELECT round, driver, lap_number, end_ms, lap_ms, b - lap_ms AS gain_ms FROM (SELECT *, min(lap_ms) OVER (PARTITION BY round ORDER BY end_ms, driver, lap_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM laps) WHERE b IS NULL OR lap_ms < b", "laps")
def session_evolution(t):
    return L.session_evolution(t("laps"))


@query("SELECT round, lap_number, count(*) AS n_cars, round(median(lap_time_s), 4) AS median_s, round(avg(pit_in::INT), 4) AS pit_share, round(avg(fresh_tyre::INT), 4) AS fresh_share FROM laps GROUP BY 1, 2", "laps")
def lap_features(t):
    return L.lap_features(t("laps"))


@query("SELECT round, CAST(floor(lap_ms / 5000) * 5000 AS BIGINT) AS from_ms, count(*) AS n FROM laps GROUP BY 1, 2", "laps")
def lap_histogram(t):
    return L.lap_histogram(t("laps"), 5000)


@query("WITH o AS (SELECT round, driver, bool_or(coalesce(deleted, false)) AS a, bool_or(pit_in AND track_status = '1') AS b FROM laps GROUP BY 1, 2) SELECT round, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND b) AS n_both, count(*) FILTER (a OR b) AS n_either FROM o GROUP BY 1", "laps")
def deleted_and_green_stops(t):
    return L.set_overlap(t("laps"), ["round"], F.col("deleted"), F.col("pit_in") & (F.col("track_status") == "1"))


@query("SELECT driver, CAST(floor(distance_m / 50) AS BIGINT) AS stretch, round(avg(speed), 4) AS v_mean, min(speed) AS v_min, count(*) AS n FROM telemetry GROUP BY 1, 2", "telemetry")
def speed_profile(t):
    return T.speed_profile(t("telemetry"), ["driver"], 50.0)


@query("SELECT driver, ord, round(x * cos(radians(30)) - y * sin(radians(30)), 4) AS x, round(x * sin(radians(30)) + y * cos(radians(30)), 4) AS y FROM telemetry", "telemetry")
def rotated_track(t):
    return T.rotated(t("telemetry"), 30.0).select("driver", "ord", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("SELECT session, round(s, 4) AS share, s >= 0.2 AS wet FROM (SELECT session, avg(rainfall::INT) AS s FROM weather GROUP BY 1)", "weather")
def wet_sessions(t):
    return T.wet_sessions(t("weather"))


# Cars by sampled position: a lap of 1000 m, samples of six hours in one bucket, as the events at hand are minutes apart.
CARS = "(SELECT r.round, t.* FROM telemetry t JOIN (SELECT DISTINCT round, driver FROM laps) r ON t.driver = r.driver)"
FOLLOWING = f"""(SELECT round, driver, lap_number, bucket, t_us, place_m, coalesce(nx, fr) AS ahead, round(coalesce(nm, fm + 1000) - place_m, 4) AS gap_m FROM (
  SELECT *, lead(driver) OVER w AS nx, lead(place_m) OVER w AS nm, first(driver) OVER w AS fr, first(place_m) OVER w AS fm, count(*) OVER (PARTITION BY round, bucket) AS cars FROM (
    SELECT round, driver, lap_number, CAST(t_us // 21600000000 AS BIGINT) AS bucket, t_us, distance_m - floor(distance_m / 1000) * 1000 AS place_m FROM {CARS}
    QUALIFY row_number() OVER (PARTITION BY round, t_us // 21600000000, driver ORDER BY t_us DESC, lap_number DESC, distance_m DESC) = 1)
  WINDOW w AS (PARTITION BY round, bucket ORDER BY place_m, driver)) WHERE cars > 1)"""
APPROACH = f"""(SELECT f.round, f.driver, f.ahead AS rival, f.lap_number, min(gap_m) AS least_m, count(*) AS n_samples FROM {FOLLOWING} f
  JOIN laps me ON me.round = f.round AND me.driver = f.driver AND me.lap_number = f.lap_number - 1 JOIN laps it ON it.round = f.round AND it.driver = f.ahead AND it.lap_number = f.lap_number - 1 AND it.position = me.position - 1
  JOIN laps now ON now.round = f.round AND now.driver = f.driver AND now.lap_number = f.lap_number AND now.track_status = '1' GROUP BY ALL)"""


def _following(t):
    cars = t("telemetry").join(t("laps").select("round", "driver").distinct(), "driver")
    return W.driver_ahead(cars, ["round"], 1000.0, 21_600_000_000)


@query(f"SELECT * FROM {FOLLOWING}", "laps", "telemetry")
def driver_ahead(t):
    return _following(t)


@query(f"SELECT * FROM {APPROACH}", "laps", "telemetry")
def closest_approach(t):
    return W.closest_approach(_following(t), t("laps"), ["round"])


@query(
    f"""SELECT a.round, a.driver, a.rival, a.lap_number, least_m, coalesce(m.position < r.position, false) AS success FROM {APPROACH} a
    LEFT JOIN laps m ON m.round = a.round AND m.driver = a.driver AND m.lap_number = a.lap_number LEFT JOIN laps r ON r.round = a.round AND r.driver = a.rival AND r.lap_number = a.lap_number WHERE least_m < 60""",
    "laps",
    "telemetry",
)
def overtake_attempts(t):
    return W.attempts(W.closest_approach(_following(t), t("laps"), ["round"]), t("laps"), ["round"], 60.0)


REPORT = f"""(SELECT l.round, l.driver, l.lap_number, round({FUEL.replace("lap_number", "l.lap_number")}, 4) AS sec_fuel, median_m, least_m, near_pct, compound, tyre_life FROM laps l JOIN (
    SELECT round, driver, lap_number, round(median(nullif(gap_m, 0)), 4) AS median_m, min(nullif(gap_m, 0)) AS least_m, round(avg(coalesce(nullif(gap_m, 0) < 50, false)::INT) * 100, 4) AS near_pct FROM {FOLLOWING} GROUP BY ALL) g
  ON l.round = g.round AND l.driver = g.driver AND l.lap_number = g.lap_number WHERE track_status = '1' AND is_accurate AND NOT pit_in AND NOT pit_out AND lap_time_s IS NOT NULL)"""


@query(f"SELECT * FROM {REPORT}", "laps", "telemetry")
def following_laps(t):
    return W.following_laps(_following(t), t("laps"), ["round"])


@query(
    f"""WITH d AS (SELECT * FROM {REPORT} WHERE median_m < 500 AND tyre_life IS NOT NULL), f AS (SELECT driver, regr_slope(sec_fuel, tyre_life) AS s FROM d GROUP BY 1),
    r AS (SELECT d.*, sec_fuel - s * tyre_life AS rest FROM d JOIN f ON d.driver = f.driver),
    o AS (SELECT round, driver, count(*) AS n, count(*) >= 5 AND min(tyre_life) < max(tyre_life) AND min(near_pct) < max(near_pct) AS ok, regr_slope(rest, near_pct) AS s, regr_intercept(rest, near_pct) AS i, regr_r2(rest, near_pct) AS r FROM r GROUP BY 1, 2)
    SELECT round, driver, n, CASE WHEN ok THEN round(s + 1e-7, 4) END AS slope, CASE WHEN ok THEN round(i + 1e-7, 4) END AS intercept, CASE WHEN ok THEN round(r + 1e-7, 4) END AS r2 FROM o""",
    "laps",
    "telemetry",
)
def following_cost(t):
    return W.following_cost(W.following_laps(_following(t), t("laps"), ["round"]), ["round"])


# zones from the brake marks of one driver of the round, on the same circle
@query(
    f"""WITH {PREV}, e AS {EVENTS}, z AS (SELECT round, floor(min(place_m) / 50) * 50 AS start_m, floor(min(place_m) / 50) * 50 + 120 AS end_m FROM (SELECT round, lap_number, distance_m - floor(distance_m / 1000) * 1000 AS place_m FROM {CARS} WHERE drs IN (10, 12, 14)) GROUP BY round, lap_number),
    l AS (SELECT e.round, e.lap_number, gainer, loser, round(arg_max(place_m, (t_us, place_m)), 1) AS place_m FROM e JOIN {FOLLOWING} f ON f.round = e.round AND f.lap_number = e.lap_number AND f.driver = gainer AND f.ahead = loser WHERE gap_m < 300 GROUP BY ALL)
    SELECT l.*, EXISTS (SELECT 1 FROM z WHERE z.round = l.round AND l.place_m BETWEEN z.start_m AND z.end_m) AS in_zone FROM l""",
    "laps",
    "telemetry",
)
def overtake_places(t):
    cars = t("telemetry").where("drs IN (10, 12, 14)").join(t("laps").select("round", "driver").distinct(), "driver")
    low = F.floor(F.min(F.col("distance_m") - F.floor(F.col("distance_m") / 1000) * 1000) / 50) * 50
    zones = cars.groupBy("round", "lap_number").agg(low.cast("double").alias("start_m"), (low + 120).cast("double").alias("end_m"))
    return W.locate_overtakes(R.overtake_events(t("laps")), _following(t), zones, ["round"], ["round"], 300.0)


# Phases of a round: the log of all its marshals' posts, on the clock of the laps (a tenth of a second of the log is one of their milliseconds).
LOG = "(SELECT session % (SELECT max(round) FROM laps) + 1 AS round, (t_us - 1704067200000000) // 100000 AS t_ms, status FROM status_log)"
PHASES = f"""pn AS (SELECT round, t_ms, CASE max(status) WHEN '1' THEN 'green' WHEN '2' THEN 'yellow' WHEN '4' THEN 'safety car' WHEN '5' THEN 'red' WHEN '6' THEN 'virtual safety car' END AS phase FROM {LOG} GROUP BY 1, 2),
  pf AS (SELECT *, lead(t_ms) OVER (PARTITION BY round ORDER BY t_ms) AS nx FROM (SELECT *, lag(phase) OVER (PARTITION BY round ORDER BY t_ms) AS b FROM pn) WHERE b IS NULL OR b <> phase),
  pe AS (SELECT f.round, phase, t_ms AS start_ms, coalesce(nx, l.e) AS end_ms FROM pf f LEFT JOIN (SELECT round, max(end_ms) AS e FROM laps GROUP BY 1) l ON l.round = f.round),
  lead_laps AS (SELECT round, end_ms - lap_ms AS at_ms, max(lap_number) OVER (PARTITION BY round ORDER BY end_ms - lap_ms) AS lap FROM laps WHERE position = 1),
  one_lead AS (SELECT round, at_ms, max(lap) AS lap FROM lead_laps GROUP BY 1, 2),
  p AS (SELECT e.round, phase, start_ms, end_ms, end_ms - start_ms AS duration_ms, coalesce(a.lap, 0) AS lap_start, coalesce(b.lap, 0) AS lap_end FROM pe e
    ASOF LEFT JOIN one_lead a ON a.round = e.round AND e.start_ms >= a.at_ms ASOF LEFT JOIN one_lead b ON b.round = e.round AND e.end_ms >= b.at_ms)"""


def _phases(t):
    rounds = t("laps").agg(F.max("round").alias("n"))
    log = t("status_log").join(F.broadcast(rounds), F.lit(True))  # one row
    log = log.select((F.col("session") % F.col("n") + 1).alias("round"), F.floor((F.col("t_us") - 1704067200000000) / 100000).alias("t_ms"), "status")
    return P.phases_with_laps(log, t("laps"), ["round"])


@query(f"WITH {PHASES} SELECT * FROM p", "laps", "status_log")
def phase_laps(t):
    return _phases(t)


@query(
    f"""WITH {PHASES}, s AS (SELECT p.round, start_ms, lap_start, lap_end, driver, min(lap_number) FILTER (lap_number < lap_start) AS early, min(lap_number) FILTER (lap_number >= lap_start) AS inside FROM p JOIN laps l ON l.round = p.round AND pit_in
      AND lap_number >= lap_start - 3 AND lap_number <= greatest(lap_end, lap_start - 1) WHERE phase IN ('safety car', 'virtual safety car') GROUP BY ALL)
    SELECT s.round, start_ms, s.driver, CASE WHEN early IS NOT NULL THEN 'before' ELSE 'during' END AS class, coalesce(early, inside) AS stop, a.position - b.position AS gained
    FROM s JOIN laps a ON a.round = s.round AND a.driver = s.driver AND a.lap_number = coalesce(early, inside) - 1 JOIN laps b ON b.round = s.round AND b.driver = s.driver AND b.lap_number = lap_end""",
    "laps",
    "status_log",
)
def neutral_stop_classes(t):
    return P.stop_classes(_phases(t), t("laps"), ["round"])


@query(
    f"""WITH f AS (SELECT l.*, phase_ends.phase_id, lap_start, lap_end FROM (SELECT round, lap_number, max(end_ms) - min(end_ms) AS s FROM laps GROUP BY 1, 2) l JOIN (WITH {PHASES} SELECT round, start_ms AS phase_id, lap_start, lap_end FROM p WHERE phase = 'safety car') phase_ends ON phase_ends.round = l.round AND lap_number BETWEEN lap_start - 3 AND greatest(lap_end, lap_start))
    SELECT *, round((1 - inside_ms / before_ms) * 100, 4) AS compaction_pct FROM (SELECT round, phase_id, median(s) FILTER (lap_number < lap_start) AS before_ms, min(s) FILTER (lap_number >= lap_start) AS inside_ms FROM f GROUP BY 1, 2) WHERE before_ms > 0""",
    "laps",
    "status_log",
)
def safety_car_compaction(t):
    """Field spread before and in the phases of the status log, in place of phases by lap number."""
    phases = _phases(t).where("phase = 'safety car'").select("round", F.col("start_ms").alias("phase_id"), "lap_start", F.greatest("lap_end", "lap_start").alias("lap_end"))
    return K.neutral_compaction(L.field_spread(t("laps")), phases)


# A feed of laps: every eleventh lap comes 200 s late; batches of 120 s, laps may be 60 s late.
@query(
    """WITH a AS (SELECT round, driver, lap_number, end_ms, lap_time_s, (end_ms + CASE WHEN lap_number % 11 = 0 THEN 200000 ELSE 0 END) // 120000 AS batch FROM laps),
    m AS (SELECT round, batch, max(e) OVER (PARTITION BY round ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 60000 AS mark FROM (SELECT round, batch, max(end_ms) AS e FROM a GROUP BY 1, 2)),
    o AS (SELECT a.* FROM a JOIN m ON m.round = a.round AND m.batch = a.batch WHERE mark IS NULL OR end_ms > mark)
    SELECT round, driver, lap_number, end_ms, r AS rolling_s FROM (SELECT *, count(*) OVER w AS n, round(median(lap_time_s) OVER w, 4) AS r FROM o WINDOW w AS (PARTITION BY round, driver ORDER BY end_ms, lap_number ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n >= 3""",
    "laps",
)
def late_lap_pace(t):
    arrives = F.col("end_ms") + F.when(F.col("lap_number") % 11 == 0, 200000).otherwise(0)
    laps = t("laps").withColumn("batch", F.floor(arrives / 120000))
    return feed.batch_snapshots(feed.on_time(laps, ["round"], "batch", "end_ms", 60000), ["round"], "end_ms")


@query()
def parity_test(t):
    d = S.welch_test(t("laps"), ["round"], "lap_time_s", "fresh_tyre")
    n = Window.partitionBy()  # a row for each round
    return d.withColumn("p_adjusted", F.least(F.col("p") * F.count(F.lit(1)).over(n), F.lit(1.0)))


@query()
def rank_test(t):
    return S.mann_whitney_test(t("laps"), ["round"], "lap_ms", "fresh_tyre")


@query()
def signed_rank_test(t):
    return S.wilcoxon_test(t("results").select("season", (F.col("grid") - F.col("position")).alias("d")), ["season"], "d")


@query()
def undercut_success(t):
    return S.success_test(R.undercut_duels(t("laps")), ["round"], "success")


@query(
    f"""WITH {PHASES}, c AS (SELECT round, count(*) AS n, sum(greatest(lap_end - lap_start, 0) + 1) AS u FROM p WHERE phase = 'safety car' AND lap_start > 0 GROUP BY 1),
    r AS (SELECT c.round, n_laps, least(n / greatest(n_laps - u, 1), 1e0) AS d, least(n / u, 1e0) AS e FROM c JOIN (SELECT round, max(lap_number) AS n_laps FROM laps GROUP BY 1) l ON l.round = c.round)
    SELECT round, lap, round(d / (d + e) * (1 - pow(1 - (d + e), lap - 1)), 9) AS q FROM (SELECT *, unnest(range(1, n_laps + 1)) AS lap FROM r)""",
    "laps",
    "status_log",
)
def sc_marginals(t):
    """Rates from the phases of each round."""
    return G.safety_car_marginals(G.safety_car_rates(_phases(t), t("laps"), ["round"]), ["round"])


# A lap that was taken away stands for an anomaly; a driver's code is D and two digits, as in the messages. Drivers of a team with an odd number retire.
@query(
    """WITH a AS (SELECT round, driver, lap_number, pit_in OR pit_out AS box FROM laps WHERE deleted), l AS (SELECT round, driver, max(lap_number) AS last_lap FROM laps WHERE team % 2 = 1 GROUP BY 1, 2),
    r AS (SELECT l.round, l.driver, last_lap, count(*) FILTER (box AND lap_number < last_lap) AS n_box, count(*) FILTER (NOT box AND lap_number < last_lap) AS n_track, max(lap_number) FILTER (NOT box AND lap_number < last_lap) AS warned
      FROM l LEFT JOIN a ON a.round = l.round AND a.driver = l.driver GROUP BY ALL),
    e AS (SELECT *, last_lap - warned AS lead_laps, 1991 + round AS season, 'D' || CAST(10 + driver % 30 AS VARCHAR) AS code, warned % 60 + 1 AS lap_number FROM r WHERE warned IS NOT NULL)
    SELECT e.season, driver, code, lap_number, round, last_lap, n_box, n_track, warned, lead_laps, coalesce((SELECT arg_min(m.message, m.msg_id) FROM race_control m WHERE m.season = e.season AND m.lap BETWEEN lap_number - 2 AND lap_number + 2 AND contains(m.message, code)), '') AS message FROM e""",
    "laps",
    "race_control",
)
def retirement_warnings(t):
    laps = t("laps")
    anomalies = laps.where("deleted").select("round", "driver", "lap_number", (F.col("pit_in") | F.col("pit_out")).alias("box_lap"))
    lead = R.retirement_lead(laps, anomalies, laps.where("team % 2 = 1").select("round", "driver"), ["round"]).where("warned is not null")
    events = lead.select((F.col("round") + 1991).alias("season"), "driver", F.concat(F.lit("D"), (F.col("driver") % 30 + 10).cast("string")).alias("code"), (F.col("warned") % 60 + 1).alias("lap_number"), "round", "last_lap", "n_box", "n_track", "warned", "lead_laps")
    return R.messages_near(events, t("race_control"), ["season"])


@query(
    """WITH s AS (SELECT 1 AS track, lap_number AS corner, driver, min(speed) AS v_min FROM telemetry GROUP BY ALL), d AS (SELECT *, v_min - max(v_min) OVER (PARTITION BY corner) AS rel, median(v_min) OVER (PARTITION BY corner) AS mid FROM s),
    e AS (SELECT *, avg(rel) OVER (PARTITION BY driver) AS m FROM d), f AS (SELECT *, rel - m AS rest FROM e),
    c AS (SELECT driver, CASE WHEN var_pop(rest) > 1e-12 AND var_pop(mid) > 1e-12 THEN corr(rest, mid) END AS c FROM f GROUP BY 1)
    SELECT track, corner, f.driver, v_min, round(rel, 4) AS rel, round(m + 1e-7, 4) AS mean_rel, round(c, 4) AS profile_corr FROM f JOIN c ON c.driver = f.driver""",
    "telemetry",
)
def corner_matrix(t):
    """Each day of the month stands for a corner."""
    speeds = t("telemetry").groupBy(F.lit(1).alias("track"), F.col("lap_number").alias("corner"), "driver").agg(F.min("speed").alias("v_min"))
    return K.corner_matrix(speeds, ["track"])


@query()
def profile_years(t):
    """The two halves of the month stand for two years of a driver's fastest laps."""
    d = t("telemetry").withColumn("year", F.when(F.col("lap_number") <= 15, 1).otherwise(2))
    return K.profile_differences(K.relative_profiles(d, ["driver", "year"], "distance_m", "speed", 200), ["driver"], "year", "speed")


@query(
    """WITH c AS (SELECT compound AS a, tyre_life % 3 AS b, CAST(count(*) AS DOUBLE) AS n FROM laps GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c),
    a AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT a, sum(n) AS n FROM c GROUP BY 1)), b AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT b, sum(n) AS n FROM c GROUP BY 1))
    SELECT CAST(t AS BIGINT) AS n, round((s - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 6) AS rand FROM s, a, b""",
    "laps",
)
def cluster_agreement(t):
    return M.adjusted_rand(t("laps").withColumn("b", F.col("tyre_life") % 3), "compound", "b")


@query()
def wet_dry_left_out(t):
    """A lap number of all rounds is a fold; compound R stands for rain tyres."""
    laps = t("laps").where("is_accurate").groupBy("round", "lap_number").agg(F.stddev_samp("lap_time_s").alias("std_s"), F.avg("speed_fl").alias("speed"), F.count(F.lit(1)).alias("n"), F.mode("compound", True).alias("compound"))
    d = laps.where("n >= 10").withColumn("wet", (F.col("compound") == "R").cast("int"))
    return M.confusion(M.leave_out_logistic(d, ["std_s", "speed"], "wet", "lap_number"), "wet", "predicted")


@query()
def isolated_laps(t):
    return M.isolation_forest(T.lap_profile(t("telemetry")), ["v_max", "v_mean", "throttle", "brake_pct", "gear"]).withColumn("score", F.round("score", 9))


@query()
def position_forecast(t):
    d = R.shifted_form(t("results")).join(t("results").select("season", "round", "driver", "grid", F.col("position").cast("double").alias("finish")), ["season", "round", "driver"]).na.fill({"form": 0.0})
    return M.time_ordered_scores(d.withColumn("grid", F.col("grid").cast("double")), ["form", "grid"], "finish", "season", "grid", ["season", "round", "driver"])


# The first, second and third twenty laps of a driver stand for the segments of a qualifying.
SEGMENTS = "(SELECT round, driver, lap_time_s, CASE WHEN lap_number <= 20 THEN 'q1' WHEN lap_number <= 40 AND driver % 4 > 0 THEN 'q2' WHEN lap_number <= 60 AND driver % 4 > 1 THEN 'q3' END AS segment FROM laps WHERE lap_number <= 60)"


def _segments(t):
    n, d = F.col("lap_number"), F.col("driver") % 4
    return t("laps").where("lap_number <= 60").withColumn("segment", F.when(n <= 20, "q1").when((n <= 40) & (d > 0), "q2").when((n <= 60) & (d > 1), "q3"))


@query(
    f"""WITH b AS (SELECT round, driver, segment, min(lap_time_s) AS s FROM {SEGMENTS} WHERE segment IS NOT NULL GROUP BY ALL)
    SELECT a.round, a.driver, a.segment || '-' || b.segment AS segment, round(a.s - b.s, 4) AS delta_s FROM b a JOIN b ON a.round = b.round AND a.driver = b.driver AND (a.segment, b.segment) IN (('q1', 'q2'), ('q2', 'q3'))""",
    "laps",
)
def qualifying_evolution(t):
    return E.qualifying_evolution(_segments(t), ["round"])


@query(
    f"""WITH b AS (SELECT round, driver, min(lap_time_s) FILTER (segment = 'q1') AS q1, min(lap_time_s) FILTER (segment = 'q2') AS q2, min(lap_time_s) FILTER (segment = 'q3') AS q3 FROM {SEGMENTS} GROUP BY 1, 2)
    SELECT *, coalesce(q3, q2, q1) AS quali_s FROM b""",
    "laps",
)
def qualifying_times(t):
    return E.last_segment_time(E.segment_times(_segments(t), ["round"]))


# Drivers with an even number drive the sprint; compound R of the first laps makes an event wet.
@query(
    f"""WITH {PREV}, e AS {EVENTS}, l AS (SELECT round, max(lap_number) FILTER (driver % 2 = 0) AS laps_sprint, max(lap_number) FILTER (driver % 2 = 1) AS laps_race FROM laps GROUP BY 1),
    p AS (SELECT round, count(*) FILTER (gainer % 2 = 0) AS n_sprint, count(*) FILTER (gainer % 2 = 1) AS n_race FROM e GROUP BY 1)
    SELECT l.round, coalesce(n_sprint, 0) AS n_sprint, coalesce(n_race, 0) AS n_race, laps_sprint, laps_race, round(coalesce(n_sprint, 0) / laps_sprint, 6) AS rate_sprint, round(coalesce(n_race, 0) / laps_race, 6) AS rate_race
    FROM l LEFT JOIN p ON p.round = l.round WHERE l.round NOT IN (SELECT round FROM laps WHERE compound IN ('WET', 'INTERMEDIATE')) AND laps_sprint > 0 AND laps_race > 0""",
    "laps",
)
def sprint_rates(t):
    kind = lambda who: F.when(F.col(who) % 2 == 0, "S").otherwise("R").alias("session")
    events = R.overtake_events(t("laps")).select("round", kind("gainer"))
    return E.sprint_rates(events, t("laps").select("round", "lap_number", "compound", kind("driver")), ["round"], "session", ["WET", "INTERMEDIATE"])


@query(
    """WITH s AS (SELECT lap_number % 2 AS season, lap_number, driver, max(distance_m) - min(distance_m) AS m FROM telemetry GROUP BY ALL), d AS (SELECT *, m - avg(m) OVER (PARTITION BY season, lap_number) AS rel FROM s),
    o AS (SELECT season, driver, round(avg(m) + 1e-9, 4) AS mean_m, count(*) AS n, round(avg(rel) + 1e-9, 4) AS mean_rel_m FROM d GROUP BY ALL) SELECT *, rank() OVER (PARTITION BY season ORDER BY mean_m DESC) AS rank FROM o""",
    "telemetry",
)
def launch_ranking(t):
    """A day stands for an event, odd and even days for two seasons."""
    starts = t("telemetry").groupBy((F.col("lap_number") % 2).alias("season"), "lap_number", "driver").agg((F.max("distance_m") - F.min("distance_m")).alias("distance_m"))
    return E.launch_ranking(starts, ["season", "lap_number"], ["season"])


@query()
def braking_comparison(t):
    """Every driver against the one with the next number."""
    zones = T.braking_zones(t("telemetry"), ["driver"]).select(F.lit(1).alias("track"), "driver", "start_m")
    pairs = zones.select("track", F.col("driver").alias("driver_a"), (F.col("driver") + 1).alias("driver_b")).distinct()
    return E.compare_braking(zones, pairs, ["track"])


@query(
    """WITH d AS (SELECT *, drs IN (10, 12, 14) AS open FROM telemetry), i AS (SELECT *, CAST(sum(c) OVER (PARTITION BY driver ORDER BY ord) AS BIGINT) AS island FROM (SELECT *, CASE WHEN open = lag(open) OVER (PARTITION BY driver ORDER BY ord) THEN 0 ELSE 1 END AS c FROM d))
    SELECT driver, island, start_m, end_m, n, end_m - start_m AS length_m FROM (SELECT driver, island, arg_min(distance_m, ord) AS start_m, arg_max(distance_m, ord) AS end_m, count(*) AS n FROM i WHERE open GROUP BY 1, 2) WHERE end_m - start_m >= 100""",
    "telemetry",
)
def drs_zones(t):
    return T.active_zones(t("telemetry").withColumn("open", F.col("drs").isin(10, 12, 14)), ["driver"], "open", 100.0)


@query(
    """WITH s AS (SELECT round, driver, stint, compound, count(*) AS n FROM laps GROUP BY ALL), c AS (SELECT round, compound, round(avg(n) + 1e-9, 1) AS m FROM s GROUP BY ALL),
    k AS (SELECT round, '{' || string_agg('"' || compound || '":' || CAST(m AS VARCHAR), ',' ORDER BY compound) || '}' AS j FROM c GROUP BY 1)
    SELECT k.round, '{"n_stints":' || CAST(n AS VARCHAR) || ',"stints_per_driver":' || CAST(p AS VARCHAR) || ',"mean_length":' || j || '}' AS json FROM k JOIN (SELECT round, count(*) AS n, round(count(*) / count(DISTINCT driver) + 1e-9, 2) AS p FROM s GROUP BY 1) x ON x.round = k.round""",
    "laps",
)
def stint_figures(t):
    return E.json_rows(E.stint_figures(L.stints(t("laps")), ["round"]), ["round"])


@query()
def elo_seasons(t):
    """Team mates of a result list, round by round; each season starts anew."""
    r = t("results")
    best = F.struct("position", "driver")
    duels = r.groupBy("season", "round", "team").agg(F.count(F.lit(1)).alias("n"), F.min(best)["driver"].alias("winner"), F.max(best)["driver"].alias("loser")).where("n = 2")
    return E.elo_history(duels.select("season", "round", F.col("team").alias("ord"), "winner", "loser"), ["season"])


@query(
    f"""WITH c AS (SELECT *, count(*) OVER (PARTITION BY round) AS k FROM (SELECT round, compound, median(slope) AS s, median(intercept) AS b, max(n) AS max_age FROM {FITS} WHERE reliable GROUP BY ALL)),
    base AS (SELECT driver, median(lap_time_s) AS base FROM {clean(100.0)} GROUP BY 1), m AS (SELECT round, median(lap_time_s - base) FILTER (pit_in) AS i, median(lap_time_s - base) FILTER (pit_out) AS o FROM laps JOIN base USING (driver) WHERE NOT contains(track_status, '5') GROUP BY 1)
    SELECT c.round, compound, round(s + 1e-7, 4) AS slope, round(b + s + 1e-7, 3) AS base_s, max_age, n_laps, round(round(i, 6) + round(o, 6), 6) AS pit_loss_s FROM c JOIN (SELECT round, max(lap_number) AS n_laps FROM laps GROUP BY 1) n ON n.round = c.round LEFT JOIN m ON m.round = c.round WHERE k >= 2""",
    "laps",
)
def race_configs(t):
    laps = t("laps")
    base = L.clean_laps(laps, 100.0).groupBy("driver").agg(F.median("lap_time_s").alias("base"))
    return D.race_configs(L.degradation(laps, 100.0, 4), laps, L.pit_loss(laps, base=base), ["round"])


@query()
def circuits(t):
    """Every driver of the laps is asked for as a circuit; who has no telemetry keeps a row."""
    tele = t("telemetry").withColumnRenamed("driver", "circuit")
    asked = t("laps").select(F.col("driver").alias("circuit")).distinct()
    return D.circuit_dimension(asked, tele, tele.where("source = 'purchase'"), ["circuit"])


@query(
    """SELECT round, lap_number, round(stddev_samp(lap_time_s), 4) AS std_s, round(avg(speed_fl), 4) AS mean_speed, count(lap_time_s) AS n FROM laps WHERE is_accurate GROUP BY 1, 2 HAVING count(lap_time_s) >= 10""",
    "laps",
)
def field_features(t):
    return D.field_features(t("laps"), ["round"]).withColumns({"std_s": F.round("std_s", 4), "mean_speed": F.round("mean_speed", 4)})


# Weather of a round: that of all its posts, the warmer of two at one time; laps at the time of their start. Times spread wide, so 20,000 s from the median are near.
@query(
    f"""WITH w AS (SELECT session % (SELECT max(round) FROM laps) + 1 AS round, (t_us - 1704067200000000) // 100000 AS t_ms, max(track_temp) AS track_temp, bool_or(rainfall) AS rainfall FROM weather GROUP BY 1, 2),
    l AS (SELECT l.round, l.driver, l.tyre_life, {FUEL} AS corrected_s, w.track_temp, w.rainfall FROM laps l ASOF JOIN w ON w.round = l.round AND l.end_ms - l.lap_ms >= w.t_ms),
    d AS (SELECT *, corrected_s - median(corrected_s) OVER (PARTITION BY round, driver) AS rel FROM l WHERE NOT rainfall), n AS (SELECT *, abs(rel) < 20000 AS near FROM d),
    s AS (SELECT round, regr_slope(corrected_s, track_temp) AS ns, regr_r2(corrected_s, track_temp) AS nr, count(*) AS al, count(*) FILTER (near) AS n, avg(track_temp) FILTER (near) AS mx, avg(tyre_life) FILTER (near) AS mz, avg(rel) FILTER (near) AS my,
      var_pop(track_temp) FILTER (near) AS xx, var_pop(tyre_life) FILTER (near) AS zz, var_pop(rel) FILTER (near) AS yy, covar_pop(track_temp, tyre_life) FILTER (near) AS xz, covar_pop(track_temp, rel) FILTER (near) AS xy, covar_pop(tyre_life, rel) FILTER (near) AS zy FROM n GROUP BY 1),
    b AS (SELECT *, xx * zz - xz * xz AS det FROM s), f AS (SELECT *, (xy * zz - zy * xz) / det AS b, (zy * xx - xy * xz) / det AS c FROM b WHERE det > 1e-9 AND yy > 0 AND n >= 20)
    SELECT round, round(ns, 6) AS naive_slope, round(nr, 6) AS naive_r2, round(zy * zy / zz / yy, 6) AS r2_tyre, round((b * xy + c * zy) / yy, 6) AS r2_full, round(b, 6) AS coef_temp, round(sqrt(greatest(yy - b * xy - c * zy, 0) / (n - 3) * zz / det), 6) AS se_temp, round(c, 6) AS coef_tyre, round(my - b * mx - c * mz, 4) AS intercept, n FROM f""",
    "laps",
    "weather",
)
def temperature_effect(t):
    rounds = t("laps").agg(F.max("round").alias("k"))
    log = t("weather").join(F.broadcast(rounds), F.lit(True))  # one row
    log = log.groupBy((F.col("session") % F.col("k") + 1).alias("round"), F.floor((F.col("t_us") - 1704067200000000) / 100000).alias("t_ms")).agg(F.max("track_temp").alias("track_temp"), F.bool_or("rainfall").alias("rainfall"))
    laps = t("laps").select("round", "driver", F.col("tyre_life").cast("double").alias("tyre_life"), L.fuel_corrected().alias("corrected_s"), (F.col("end_ms") - F.col("lap_ms")).alias("t_ms"))
    return D.temperature_effect(T.asof_join(laps, log, ["round"], "t_ms", ["track_temp", "rainfall"]).where("track_temp is not null"), ["round"], 20_000.0)
