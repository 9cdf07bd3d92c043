"""Race operators: positions, overtakes, undercuts, track-limit and penalty messages, results over seasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceforge.operators.laps import KEYS

PENALTY = r"(?i)(?:(\d+) SECOND )?(TIME PENALTY|STOP/GO PENALTY|DRIVE.?THROUGH PENALTY|REPRIMAND) FOR CAR (\d+) \(([A-Z0-9]+)\)(?: - (.*))?"
TRACK_LIMITS = r"(?i)CAR (\d+) \(([A-Z0-9]+)\).*TRACK LIMITS AT TURN (\d+)"
TRACK_LIMITS_LAP = r"(?i)TRACK LIMITS AT TURN \d+ LAP (\d+)"


def position_progression(laps: DataFrame, who: str = "driver", keys: Sequence[str] = KEYS) -> DataFrame:
    """Best position of each driver (or team) on each lap, long."""
    return laps.groupBy(*keys, "lap_number", who).agg(F.min("position").alias("position"))


def position_table(laps: DataFrame, who: str, values: list[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """The same, wide; the columns are given so that no pass has to find them."""
    return laps.groupBy(*keys, "lap_number").pivot(who, values).agg(F.min("position"))


def with_previous(laps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Position and pit stop on the lap before; null where that lap is missing."""
    w = Window.partitionBy(*keys, "driver").orderBy("lap_number")
    before = F.lag("lap_number").over(w) == F.col("lap_number") - 1
    return laps.withColumn("prev", F.when(before, F.lag("position").over(w))).withColumn("prev_pit", F.when(before, F.lag("pit_in").over(w)))


def overtake_events(laps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Ordered pairs that swapped places from one lap to the next, both on green laps.

    Dropped when the loser pits on this lap or the gainer pitted on the one before. Cars
    meet on session and lap, so the join is one hash exchange; its group is a field of cars.
    """
    d = with_previous(laps, keys).where("prev is not null and track_status = '1'")
    a = d.where("not coalesce(prev_pit, false)").select(*keys, "lap_number", F.col("driver").alias("gainer"), F.col("prev").alias("p_a"), F.col("position").alias("c_a"))
    b = d.where("not pit_in").select(*keys, "lap_number", F.col("driver").alias("loser"), F.col("prev").alias("p_b"), F.col("position").alias("c_b"))
    return a.join(b, [*keys, "lap_number"]).where("p_a > p_b and c_a < c_b").select(*keys, "lap_number", "gainer", "loser")


def overtakes_matrix(events: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return events.groupBy(*keys, "gainer", "loser").agg(F.count(F.lit(1)).alias("n"))


def undercut_duels(laps: DataFrame, window: int = 3, after: int = 2, keys: Sequence[str] = KEYS) -> DataFrame:
    """A driver pits; the car one place ahead on the lap before pits within ``window`` laps; who is ahead ``after`` laps later?"""
    place = laps.select(*keys, "lap_number", "driver", "position")
    stops = laps.where("pit_in").select(*keys, F.col("driver").alias("chaser"), F.col("lap_number").alias("stop"))
    chaser = stops.join(place.select(*keys, F.col("driver").alias("chaser"), (F.col("lap_number") + 1).alias("stop"), F.col("position").alias("pos")), [*keys, "chaser", "stop"])
    ahead = place.select(*keys, F.col("driver").alias("rival"), (F.col("lap_number") + 1).alias("stop"), (F.col("position") + 1).alias("pos"))
    duel = chaser.join(ahead, [*keys, "stop", "pos"])
    later = stops.select(*keys, F.col("chaser").alias("rival"), F.explode(F.sequence(F.col("stop") - window, F.col("stop"))).alias("stop"), F.col("stop").alias("rival_stop"))
    # a rival that stops on the same lap duels for nothing; the first later stop counts
    met = duel.join(later, [*keys, "rival", "stop"]).groupBy(*keys, "chaser", "rival", "stop").agg(F.min("rival_stop").alias("rival_stop")).where("rival_stop > stop")
    at = F.col("rival_stop") + after
    end = lambda who: place.select(*keys, F.col("driver").alias(who), F.col("lap_number").alias("at"), F.col("position").alias(f"{who}_pos"))
    out = met.withColumn("at", at).join(end("chaser"), [*keys, "chaser", "at"]).join(end("rival"), [*keys, "rival", "at"])
    return out.select(*keys, "chaser", "rival", "stop", "rival_stop", (F.col("chaser_pos") < F.col("rival_pos")).alias("success"))


def _group(pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract("message", pattern, k), F.lit(""))


def penalties(messages: DataFrame) -> DataFrame:
    """Penalties of every kind; seconds and reason are null where the message names none."""
    d = messages.where(F.col("message").rlike(PENALTY))
    whole = {"seconds": _group(PENALTY, 1).cast("bigint"), "kind": F.upper(_group(PENALTY, 2)), "car": _group(PENALTY, 3).cast("bigint"), "code": _group(PENALTY, 4), "reason": _group(PENALTY, 5)}
    return d.select("season", "msg_id", *(c.alias(n) for n, c in whole.items()))


def track_limits(messages: DataFrame) -> DataFrame:
    d = messages.where(F.col("message").rlike(TRACK_LIMITS))
    return d.select("season", "msg_id", _group(TRACK_LIMITS, 1).cast("bigint").alias("car"), _group(TRACK_LIMITS, 2).alias("code"), _group(TRACK_LIMITS, 3).cast("bigint").alias("turn"), _group(TRACK_LIMITS_LAP, 1).cast("bigint").alias("lap"))


def blue_flags(messages: DataFrame, cars: DataFrame) -> DataFrame:
    """Blue flags with the driver of the car; unknown cars keep a null."""
    return messages.where("flag = 'BLUE'").select("season", "msg_id", "lap", "car").join(cars, "car", "left")


def limits_without_deletion(limits: DataFrame, deleted: DataFrame) -> DataFrame:
    """Track-limit messages without a deleted lap of that car."""
    return limits.join(deleted, ["car", "lap"], "left_anti")


def deletions_without_limits(limits: DataFrame, deleted: DataFrame) -> DataFrame:
    return deleted.join(limits, ["car", "lap"], "left_anti")


def shifted_form(results: DataFrame, size: int = 3) -> DataFrame:
    """Mean points over a driver's previous ``size`` rounds; the current round never counts."""
    w = Window.partitionBy("driver").orderBy("season", "round").rowsBetween(-size, -1)
    return results.select("season", "round", "driver", F.round(F.avg("points").over(w), 4).alias("form"))


def previous_season(results: DataFrame) -> DataFrame:
    before = results.select((F.col("season") + 1).alias("season"), "round", "driver", F.col("position").alias("last_position"))
    return results.select("season", "round", "driver", "position").join(before, ["season", "round", "driver"], "left")


def season_dominance(results: DataFrame) -> DataFrame:
    total = results.groupBy("season", "driver").agg(F.sum("points").alias("points"))
    w = Window.partitionBy("season")
    d = total.withColumn("k", F.row_number().over(w.orderBy(F.desc("points"), "driver"))).withColumn("share", F.round(F.col("points") / F.sum("points").over(w), 4))
    return d.where("k = 1").select("season", F.col("driver").alias("champion"), "points", "share")


def retirement_rate(results: DataFrame) -> DataFrame:
    finished = F.col("status").rlike(r"^(Finished|\+\d+ Lap)")
    return results.groupBy("season").agg(F.round(1 - F.avg(finished.cast("double")), 4).alias("dnf_rate"), F.count(F.lit(1)).alias("n_entries"))


def calendar_size(results: DataFrame) -> DataFrame:
    return results.groupBy("season").agg(F.countDistinct("round").alias("n_rounds"), F.countDistinct("team").alias("n_teams"))


def title_chances(results: DataFrame, last_round: int, per_round: int = 25) -> DataFrame:
    """Who could still win after each round: points plus all points to come against the leader's."""
    w = Window.partitionBy("season", "driver").orderBy("round")
    d = results.select("season", "round", "driver", F.sum("points").over(w).alias("points"))
    lead = F.max("points").over(Window.partitionBy("season", "round"))
    return d.select("season", "round", "driver", "points", (F.col("points") + (last_round - F.col("round")) * per_round >= lead).alias("alive"))


def grid_to_finish(results: DataFrame) -> DataFrame:
    return results.groupBy("grid").agg(F.round(F.avg(F.col("grid") - F.col("position")), 4).alias("mean_gain"), F.count_if(F.col("position") == 1).alias("wins"), F.count(F.lit(1)).alias("n"))


def elo(duels: DataFrame, k: float = 24.0, start: float = 1500.0, scale: float = 400.0) -> DataFrame:
    """Ratings after all duels of a group: a fold in order over (winner, loser) with a map of ratings, inside the JVM.

    ``duels``: grp, ord, winner, loser. A group is folded by one task, as each rating depends on
    the ones before; groups run side by side.
    """
    rows = duels.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("ord", "winner", "loser"))).alias("d"))
    empty = F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<double>"))

    def step(acc: Column, x: Column) -> Column:
        a = F.coalesce(F.element_at(acc, x["winner"]), F.lit(start))
        b = F.coalesce(F.element_at(acc, x["loser"]), F.lit(start))
        gain = F.lit(k) * (1 - 1 / (1 + F.pow(F.lit(10.0), (b - a) / scale)))
        rest = F.map_filter(acc, lambda key, v: (key != x["winner"]) & (key != x["loser"]))
        return F.map_concat(rest, F.map_from_arrays(F.array(x["winner"], x["loser"]), F.array(a + gain, b - gain)))

    return rows.select("grp", F.explode(F.aggregate("d", empty, step)).alias("driver", "rating")).withColumn("rating", F.round("rating", 4))


def podium_matrix(results: DataFrame, places: int = 3) -> DataFrame:
    """How often each team took each of the first ``places`` in a season; 0 where it never did."""
    return results.groupBy("season", "team").agg(*(F.count_if(F.col("position") == p).alias(f"p{p}") for p in range(1, places + 1)))


def team_form(results: DataFrame, size: int = 3) -> DataFrame:
    """Mean points of a team over its previous ``size`` rounds, all its cars together; the current round never counts."""
    total = results.groupBy("season", "round", "team").agg(F.sum("points").alias("points"))
    w = Window.partitionBy("team").orderBy("season", "round").rowsBetween(-size, -1)
    return total.select("season", "round", "team", "points", F.round(F.avg("points").over(w), 4).alias("form"))


def first_lap_gains(results: DataFrame, laps: DataFrame) -> DataFrame:
    """Grid place against the place after lap 1; both sides have season, round and driver."""
    first = laps.where("lap_number = 1").select("season", "round", "driver", F.col("position").alias("lap1"))
    return results.join(first, ["season", "round", "driver"]).select("season", "round", "driver", "grid", "lap1", (F.col("grid") - F.col("lap1")).alias("gained"))


def stops_and_results(results: DataFrame, laps: DataFrame) -> DataFrame:
    """Every result with its number of stops, 0 where none is known."""
    stops = laps.where("pit_in").groupBy("season", "round", "driver").agg(F.count(F.lit(1)).alias("n_stops"))
    return results.join(stops, ["season", "round", "driver"], "left").select("season", "round", "driver", "position", F.coalesce("n_stops", F.lit(0).cast("bigint")).alias("n_stops"))


def winner_order(results: DataFrame) -> DataFrame:
    """A team's finishers of a round as one string in order of finish."""
    d = results.groupBy("season", "round", "team").agg(F.array_sort(F.collect_list(F.struct("position", "driver"))).alias("p"))  # a team's few cars
    return d.select("season", "round", "team", F.array_join(F.transform("p", lambda x: x["driver"].cast("string")), ",").alias("drivers"))


def messages_near(events: DataFrame, messages: DataFrame, keys: list[str], laps: int = 2) -> DataFrame:
    """The first message that names the driver's code within ``laps`` laps of each event, either way; empty where there is none.

    ``events``: keys, driver, code, lap_number, any more; ``messages``: keys, lap, msg_id, message. First is the
    smallest msg_id. Events are dealt to the laps of their band, so that the band join is an equi join.
    """
    asked = events.select(*keys, "driver", "code", "lap_number").distinct()
    band = asked.withColumn("lap", F.explode(F.sequence(F.col("lap_number") - laps, F.col("lap_number") + laps)))
    met = band.join(messages.select(*keys, "lap", "msg_id", "message"), [*keys, "lap"]).where(F.contains("message", "code"))
    first = met.groupBy(*keys, "driver", "code", "lap_number").agg(F.min_by("message", "msg_id").alias("message"))
    return events.join(first, [*keys, "driver", "code", "lap_number"], "left").withColumn("message", F.coalesce("message", F.lit("")))


def retirement_lead(laps: DataFrame, anomalies: DataFrame, retired: DataFrame, keys: list[str]) -> DataFrame:
    """For each retired driver: last lap, anomalies before it in box laps and on the track, and laps from the last one on the track to the end.

    ``anomalies``: keys, driver, lap_number, box_lap; ``retired``: keys, driver. lead_laps is null without an anomaly on the track.
    """
    last = laps.groupBy(*keys, "driver").agg(F.max("lap_number").alias("last_lap")).join(retired.select(*keys, "driver").distinct(), [*keys, "driver"])
    own = last.join(anomalies.select(*keys, "driver", "lap_number", "box_lap"), [*keys, "driver"], "left")
    before = F.col("lap_number") < F.col("last_lap")
    out = own.groupBy(*keys, "driver", "last_lap").agg(F.count_if(before & F.col("box_lap")).alias("n_box"), F.count_if(before & ~F.col("box_lap")).alias("n_track"), F.max(F.when(before & ~F.col("box_lap"), F.col("lap_number"))).alias("warned"))
    return out.withColumn("lead_laps", F.col("last_lap") - F.col("warned"))
