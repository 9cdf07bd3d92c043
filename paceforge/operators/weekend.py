"""Qualifying segments, sprints, starts, braking points of two drivers, and key figures of a weekend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceforge.operators.timeseries import match_by_distance


def last_segment_time(results: DataFrame, segments: tuple[str, ...] = ("q1", "q2", "q3")) -> DataFrame:
    """Adds ``quali_s``: the time of the last segment that a driver set one in, which need not be the fastest; null without any."""
    return results.withColumn("quali_s", F.coalesce(*(F.col(s) for s in reversed(segments))))


def segment_times(laps: DataFrame, keys: list[str], segments: tuple[str, ...] = ("q1", "q2", "q3")) -> DataFrame:
    """Best lap of each driver in each segment, wide: keys, driver, one column a segment. ``laps``: keys, driver, segment, lap_time_s."""
    return laps.where("lap_time_s is not null").groupBy(*keys, "driver").agg(*(F.min(F.when(F.col("segment") == s, F.col("lap_time_s"))).alias(s) for s in segments))


def qualifying_evolution(laps: DataFrame, keys: list[str], segments: tuple[str, ...] = ("q1", "q2", "q3")) -> DataFrame:
    """Best time of a segment less that of the next for drivers with both: keys, driver, segment ('q1-q2'), delta_s; positive: the later one was faster."""
    d = segment_times(laps, keys, segments)
    steps = F.array(*(F.struct(F.lit(f"{a}-{b}").alias("segment"), (F.col(a) - F.col(b)).alias("delta_s")) for a, b in zip(segments, segments[1:], strict=False)))
    return d.select(*keys, "driver", F.explode(steps).alias("s")).select(*keys, "driver", "s.segment", F.round("s.delta_s", 4).alias("delta_s")).where("delta_s is not null")


def sprint_rates(events: DataFrame, laps: DataFrame, event: list[str], session: str, wet: list[str]) -> DataFrame:
    """Overtakes for each lap in sprint (S) and race (R) of the dry events that have both: event, n_sprint, n_race, laps_sprint, laps_race, rate_sprint, rate_race.

    ``events``: event, session (one row an overtake); ``laps``: event, session, lap_number, compound. An
    event is wet if any lap of either was on one of the ``wet`` compounds. One pass over each table.
    """
    in_ = lambda s: F.col(session) == s
    ran = laps.groupBy(*event).agg(
        F.max(F.when(in_("S"), F.col("lap_number"))).alias("laps_sprint"), F.max(F.when(in_("R"), F.col("lap_number"))).alias("laps_race"), F.bool_or(F.coalesce(F.col("compound").isin(wet), F.lit(False))).alias("wet")
    )
    passes = events.groupBy(*event).agg(F.count_if(in_("S")).alias("n_sprint"), F.count_if(in_("R")).alias("n_race"))
    d = ran.where("not wet and laps_sprint > 0 and laps_race > 0").join(passes, event, "left").fillna(0, ["n_sprint", "n_race"])
    return d.select(*event, "n_sprint", "n_race", "laps_sprint", "laps_race", F.round(F.col("n_sprint") / F.col("laps_sprint"), 6).alias("rate_sprint"), F.round(F.col("n_race") / F.col("laps_race"), 6).alias("rate_race"))


def launch_ranking(starts: DataFrame, event: list[str], season: list[str]) -> DataFrame:
    """Drivers of a season by the mean distance after their starts: mean_m, n, the mean deviation from the field, and the rank (ties share one).

    ``starts``: event (season included), driver, distance_m; nulls don't count.
    """
    known = starts.where("distance_m is not null")
    d = known.withColumn("rel", F.col("distance_m") - F.avg("distance_m").over(Window.partitionBy(*event)))
    out = d.groupBy(*season, "driver").agg(F.round(F.avg("distance_m") + 1e-9, 4).alias("mean_m"), F.count(F.lit(1)).alias("n"), F.round(F.avg("rel") + 1e-9, 4).alias("mean_rel_m"))
    return out.withColumn("rank", F.rank().over(Window.partitionBy(*season).orderBy(F.desc("mean_m"))).cast("bigint"))


def compare_braking(zones: DataFrame, pairs: DataFrame, keys: list[str], tolerance_m: float = 150.0) -> DataFrame:
    """Braking zones of stated pairs of drivers, matched by where they begin: keys, driver_a, driver_b, start_m_a, start_m_b, delta_m.

    ``zones``: keys, driver, start_m; ``pairs``: keys, driver_a, driver_b. The zones of a are taken in order; each
    looks at the nearest zone of b, and stays alone when that one is taken or further than ``tolerance_m``.
    """
    named = pairs.withColumn("grp", F.struct(*keys, "driver_a", "driver_b"))
    w = Window.partitionBy("grp").orderBy("start_m")

    def side(who: str, number: str) -> DataFrame:
        d = named.join(zones.select(*keys, F.col("driver").alias(who), "start_m"), [*keys, who])
        return d.select("grp", (F.row_number().over(w) - 1).cast("bigint").alias(number), F.col("start_m").alias("pos"))

    a, b = side("driver_a", "i"), side("driver_b", "j")
    met = match_by_distance(a, b, tolerance_m)
    out = met.join(a.withColumnRenamed("pos", "start_m_a"), ["grp", "i"]).join(b.withColumnRenamed("pos", "start_m_b"), ["grp", "j"])
    return out.select(*(f"grp.{c}" for c in (*keys, "driver_a", "driver_b")), "start_m_a", "start_m_b", F.round(F.col("start_m_b") - F.col("start_m_a"), 4).alias("delta_m"))


def stint_figures(stints: DataFrame, keys: list[str]) -> DataFrame:
    """Key figures of a race's stints: n_stints, stints for each driver, and the mean length by compound as a map in order of the compounds."""
    by = stints.groupBy(*keys, "compound").agg(F.round(F.avg("n_laps") + 1e-9, 1).alias("mean"), F.count(F.lit(1)).alias("n"))
    lengths = F.map_from_entries(F.array_sort(F.collect_list(F.struct("compound", "mean"))))  # a race's few compounds
    cars = stints.groupBy(*keys).agg(F.countDistinct("driver").alias("cars"))
    d = by.where("compound is not null").groupBy(*keys).agg(lengths.alias("mean_length")).join(stints.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_stints")), keys).join(cars, keys)
    return d.select(*keys, "n_stints", F.round(F.col("n_stints") / F.col("cars") + 1e-9, 2).alias("stints_per_driver"), "mean_length")


def json_rows(df: DataFrame, keys: list[str], name: str = "json") -> DataFrame:
    """Keys, and all other columns as one JSON object a row; nulls are written."""
    return df.select(*keys, F.to_json(F.struct(*(c for c in df.columns if c not in keys)), {"ignoreNullFields": "false"}).alias(name))


def write_figures(df: DataFrame, path: str) -> None:
    """Key figures as JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def elo_history(duels: DataFrame, keys: list[str], k: float = 24.0, start: float = 1500.0, scale: float = 400.0) -> DataFrame:
    """Ratings of all drivers rated so far after each round: keys, round, driver, rating.

    ``duels``: keys, round, ord, winner, loser. A fold over one series' duels in order (each rating needs those
    before it), with a snapshot at the end of a round; series run side by side.
    """
    rounds = duels.groupBy(*keys, "round").agg(F.array_sort(F.collect_list(F.struct("ord", "winner", "loser"))).alias("d"))
    rows = rounds.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("round", "d"))).alias("r"))
    empty = F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<double>"))

    def duel(acc: Column, x: Column) -> Column:
        a, b = F.coalesce(F.element_at(acc, x["winner"]), F.lit(start)), F.coalesce(F.element_at(acc, x["loser"]), F.lit(start))
        gain = F.lit(k) * (1 - 1 / (1 + F.pow(F.lit(10.0), (b - a) / scale)))
        rest = F.map_filter(acc, lambda key, v: (key != x["winner"]) & (key != x["loser"]))
        return F.map_concat(rest, F.map_from_arrays(F.array(x["winner"], x["loser"]), F.array(a + gain, b - gain)))

    kind = duels.schema["round"].dataType.simpleString()
    first = F.struct(empty.alias("now"), F.array().cast(f"array<struct<round:{kind},ratings:map<bigint,double>>>").alias("seen"))

    def one_round(acc: Column, r: Column) -> Column:
        now = F.aggregate(r["d"], acc["now"], duel)
        return F.struct(now.alias("now"), F.concat(acc["seen"], F.array(F.struct(r["round"].alias("round"), now.alias("ratings")))).alias("seen"))

    out = rows.select(*keys, F.explode(F.aggregate("r", first, one_round)["seen"]).alias("s"))
    return out.select(*keys, "s.round", F.explode("s.ratings").alias("driver", "rating")).withColumn("rating", F.round("rating", 4))
