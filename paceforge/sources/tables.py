"""Logical tables of a motorsport season, projected from the tables at hand.

Each projection is one statement that Spark and DuckDB both read; the few words that
differ between them are named in ``SPARK`` and ``DUCKDB``. There are at least four rounds, with fields of 20 cars at most, whose stops fall on different laps. Times are whole milliseconds, so that
running sums are exact in any order of evaluation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {"micros": "unix_micros(CAST(ts AS TIMESTAMP))"}
DUCKDB = {"micros": "epoch_us(ts)"}

LAPS = """
SELECT q.*, row_number() OVER (PARTITION BY round, lap_number ORDER BY end_ms, driver) AS position
FROM (
  SELECT p.*, CAST(floor((lap_number - 1 + driver % 7) / 20e0) AS BIGINT) + 1 AS stint,
         (lap_number + driver % 7) % 20 = 0 AS pit_in, (lap_number + driver % 7) % 20 = 1 AND lap_number > 1 AS pit_out,
         lap_ms / 1000e0 AS lap_time_s, lap_ms - s1_ms - s2_ms AS s3_ms,
         count(*) OVER (PARTITION BY driver) AS total_laps,
         CAST(sum(lap_ms) OVER (PARTITION BY driver ORDER BY lap_number ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_ms
  FROM (
    SELECT l_suppkey AS driver, CAST(s_nationkey AS BIGINT) AS team, l_suppkey % (SELECT greatest(4, CAST(ceil(count(*) / 20e0) AS BIGINT)) FROM {supplier}) + 1 AS round,
           row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS lap_number,
           l_returnflag AS compound, l_quantity AS tyre_life, CASE l_linestatus WHEN 'O' THEN '1' ELSE '4' END AS track_status,
           CAST(round(l_extendedprice) AS BIGINT) AS lap_ms, CAST(floor(round(l_extendedprice) * 3 / 10e0) AS BIGINT) AS s1_ms,
           CAST(floor(round(l_extendedprice) * 4 / 10e0) AS BIGINT) + l_linenumber AS s2_ms,
           CASE l_linenumber WHEN 7 THEN true WHEN 6 THEN NULL ELSE false END AS deleted,
           l_linenumber <> 5 AS is_accurate, l_linenumber % 2 = 0 AS fresh_tyre,
           200 + l_quantity AS speed_i1, 210 + 2 * l_quantity AS speed_i2, 205 + 100 * l_tax AS speed_fl, 150 + 3 * l_quantity AS speed_st
    FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey) p) q
"""

TELEMETRY = """
SELECT driver, t_us, t_us / 1000000e0 AS t_s, lap_number, speed, brake, drs, source, gear, throttle, ord,
       CAST(sum(step_cm) OVER (PARTITION BY driver ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS BIGINT) / 100e0 AS distance_m,
       CAST(floor(speed * 7) AS BIGINT) % 200 AS x, CAST(floor(speed * 13) AS BIGINT) % 150 AS y, CAST(floor(speed * 3) AS BIGINT) % 40 AS z
FROM (
  SELECT user_id AS driver, {micros} AS t_us, CAST(day(ts) AS BIGINT) AS lap_number, value AS speed, value >= 30 AS brake,
         CAST(round(value * 100) AS BIGINT) AS step_cm, event_type AS source, CAST(floor(value / 10) AS BIGINT) % 8 + 1 AS gear,
         CAST(floor(value * 2) AS BIGINT) % 101 AS throttle, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS ord,
         CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 8 WHEN 'purchase' THEN 10 WHEN 'error' THEN 12 ELSE 14 END AS drs
  FROM {events}) e
"""

STATUS_LOG = """
SELECT user_id AS session, {micros} AS t_us, CASE event_type WHEN 'view' THEN '1' WHEN 'click' THEN '2' WHEN 'purchase' THEN '4' WHEN 'error' THEN '5' ELSE '6' END AS status
FROM {events}
"""

WEATHER = """
SELECT user_id AS session, {micros} AS t_us, 20 + value / 10 AS track_temp, value > 60 AS rainfall FROM {events} WHERE event_type = 'view'
"""

RESULTS = """
SELECT season, round, driver, team, score, position, CASE WHEN position % 7 = 0 THEN 'Engine' WHEN position % 5 = 0 THEN '+1 Lap' ELSE 'Finished' END AS status,
       CASE position WHEN 1 THEN 25 WHEN 2 THEN 18 WHEN 3 THEN 15 WHEN 4 THEN 12 WHEN 5 THEN 10 WHEN 6 THEN 8 WHEN 7 THEN 6 WHEN 8 THEN 4 WHEN 9 THEN 2 WHEN 10 THEN 1 ELSE 0 END AS points,
       row_number() OVER (PARTITION BY season, round ORDER BY n_orders DESC, driver) AS grid
FROM (
  SELECT season, round, driver, team, score, n_orders, row_number() OVER (PARTITION BY season, round ORDER BY score DESC, driver) AS position
  FROM (
    SELECT CAST(year(o_orderdate) AS BIGINT) AS season, CAST(month(o_orderdate) AS BIGINT) AS round, CAST(c_nationkey AS BIGINT) AS driver,
           CAST(floor(c_nationkey / 2e0) AS BIGINT) AS team, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS score, count(*) AS n_orders
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey
    GROUP BY year(o_orderdate), month(o_orderdate), c_nationkey) a) b
"""

RACE_CONTROL = """
SELECT CAST(year(o_orderdate) AS BIGINT) AS season, o_orderkey AS msg_id, CAST(o_orderkey % 60 + 1 AS BIGINT) AS lap,
  CASE o_orderkey % 5
    WHEN 0 THEN CASE o_custkey % 8 WHEN 0 THEN 'DRIVE THROUGH PENALTY' WHEN 1 THEN 'REPRIMAND' WHEN 2 THEN '10 SECOND STOP/GO PENALTY' ELSE CAST(o_custkey % 4 * 5 + 5 AS VARCHAR(9)) || ' SECOND TIME PENALTY' END
      || ' FOR CAR ' || CAST(o_custkey % 30 + 1 AS VARCHAR(9)) || ' (D' || CAST(10 + o_custkey % 30 AS VARCHAR(9)) || ')' || CASE WHEN o_custkey % 7 = 0 THEN '' ELSE ' - CAUSING A COLLISION' END
    WHEN 1 THEN 'CAR ' || CAST(o_custkey % 30 + 1 AS VARCHAR(9)) || ' (D' || CAST(10 + o_custkey % 30 AS VARCHAR(9)) || ') TIME 1:2' || CAST(o_orderkey % 10 AS VARCHAR(9)) || '.345 DELETED - TRACK LIMITS AT TURN ' || CAST(o_orderkey % 15 + 1 AS VARCHAR(9)) || ' LAP ' || CAST(o_orderkey % 60 + 1 AS VARCHAR(9))
    WHEN 2 THEN 'WAVED BLUE FLAG FOR CAR ' || CAST(o_custkey % 30 + 1 AS VARCHAR(9)) || ' TIMED AT 14:00:00'
    ELSE 'GREEN LIGHT - PIT EXIT OPEN' END AS message,
  CASE WHEN o_orderkey % 5 = 2 THEN 'BLUE' ELSE NULL END AS flag, CAST(o_custkey % 30 + 1 AS BIGINT) AS car
FROM {orders}
"""

SQL = {"laps": LAPS, "telemetry": TELEMETRY, "status_log": STATUS_LOG, "weather": WEATHER, "results": RESULTS, "race_control": RACE_CONTROL}
DEALT = {"laps": ("lineitem", "l_suppkey", 250_000), "placed_laps": ("lineitem", "l_suppkey", 250_000), "telemetry": ("events", "user_id", 100_000)}  # table, driver, rows for a task
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def tasks_for(spark: SparkSession, path: str, rows_per_task: int) -> int | None:
    """Tasks that a stored table's rows are dealt to; None where they fit one. The rows are counted from the files' footers."""
    rows = spark.read.parquet(path).count()
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_task)) if rows > rows_per_task else None


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table if the name is one of ours, else the stored table.

    Rows of laps and telemetry are dealt by driver before their windows, over as many tasks as there are rows for; one
    exchange then serves all windows of a driver. ``placed_laps`` are the laps for queries on positions, whose
    rows of a lap are dealt in the same way.
    """
    if name not in SQL and name != "placed_laps":
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SQL["laps" if name == "placed_laps" else name]
    used = {b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in BASE if "{" + b + "}" in text}
    if name in DEALT:
        table, driver, rows_per_task = DEALT[name]
        n = tasks_for(spark, f"{sf_dir}/{table}.parquet", rows_per_task)
        if n:
            used[table] = used[table].repartition(n, driver)
            if name == "placed_laps":
                text = text.replace("SELECT p.*,", f"SELECT /*+ REPARTITION({n}, round, lap_number) */ p.*,")
    for word, own in SPARK.items():
        text = text.replace("{" + word + "}", own)
    return spark.sql(text.replace("VARCHAR(9)", "STRING"), **used)


def oracle(query: str, *names: str) -> str:
    """``query`` for DuckDB with the logical tables it names as common table expressions."""
    parts = [f"{n} AS ({SQL[n].format(**{b: b for b in BASE}, **DUCKDB)})" for n in names]
    query = query.strip()
    if query.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {query[5:]}"
    return f"WITH {', '.join(parts)} {query}"
