"""Neutral phases of a session with their laps, and who stopped before or during them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: track status codes and what they mean
LABELS = {"1": "green", "2": "yellow", "4": "safety car", "5": "red", "6": "virtual safety car", "7": "virtual safety car ending"}
NEUTRAL = ["safety car", "virtual safety car"]


def lap_at(times: DataFrame, laps: DataFrame, keys: list[str]) -> DataFrame:
    """The leader's lap at each time (keys, t_ms): the highest lap that the driver in first place has begun, 0 before the first.

    Times and lap starts go through one window, starts first at equal times. A session's times
    and its leader's laps meet in one task; both are few. ``laps``: keys, position, lap_number, end_ms, lap_ms.
    """
    starts = laps.where("position = 1").select(*keys, (F.col("end_ms") - F.col("lap_ms")).alias("t_ms"), F.col("lap_number").alias("lap")).where("t_ms is not null and lap is not null")
    asked = times.select(*keys, "t_ms").distinct().withColumn("lap", F.lit(None).cast(starts.schema["lap"].dataType))
    both = starts.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True))).repartition(*keys)  # dealt as a whole, as in asof_join
    w = Window.partitionBy(*keys).orderBy("t_ms", "asks").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("lap", F.coalesce(F.max("lap").over(w), F.lit(0))).where("asks").select(*keys, "t_ms", "lap")


def phases_with_laps(log: DataFrame, laps: DataFrame, keys: list[str]) -> DataFrame:
    """Phases of a status log (keys, t_ms, status): phase, start_ms, end_ms, duration_ms, lap_start, lap_end.

    Equal labels in a row are one phase, an unknown code is its own label; at one time the highest
    code counts. A phase ends where the next begins, the last with the last lap of the session.
    """
    names = F.create_map(*(F.lit(x) for p in LABELS.items() for x in p))
    one = log.groupBy(*keys, "t_ms").agg(F.max("status").alias("status"))
    w = Window.partitionBy(*keys).orderBy("t_ms")
    named = one.withColumn("phase", F.coalesce(F.element_at(names, F.col("status")), F.col("status"))).withColumn("before", F.lag("phase").over(w))
    first = named.where("before is null or before <> phase").withColumn("next_ms", F.lead("t_ms").over(w))
    ends = laps.groupBy(*keys).agg(F.max("end_ms").alias("last_ms"))
    d = first.join(ends, keys, "left").select(*keys, "phase", F.col("t_ms").alias("start_ms"), F.coalesce("next_ms", "last_ms").alias("end_ms"))
    at = lap_at(d.select(*keys, F.explode(F.array("start_ms", "end_ms")).alias("t_ms")).where("t_ms is not null"), laps, keys)
    for side in ("start", "end"):
        d = d.join(at.select(*keys, F.col("t_ms").alias(f"{side}_ms"), F.col("lap").alias(f"lap_{side}")), [*keys, f"{side}_ms"], "left")
    return d.select(*keys, "phase", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "lap_start", "lap_end")


def stop_classes(phases: DataFrame, laps: DataFrame, keys: list[str], before: int = 3, width: int = 8) -> DataFrame:
    """For each neutral phase and driver with a stop up to ``before`` laps before it ('before') or in it ('during'): places gained.

    The first stop before the phase counts, else the first one in it; gained is the position on the lap before that
    stop less the position on the phase's last lap; drivers without one of the two have no row. Phases
    and stops are dealt to cells of ``width`` laps, so that the range join is an equi join with a residual.
    ``laps``: keys, driver, lap_number, position, pit_in.
    """
    p = phases.where(F.col("phase").isin(NEUTRAL)).select(*keys, "start_ms", "lap_start", "lap_end")
    p = p.withColumn("cell", F.explode(F.sequence(F.floor((F.col("lap_start") - before) / width), F.floor(F.greatest("lap_start", "lap_end") / width))))
    stops = laps.where("pit_in").select(*keys, "driver", F.col("lap_number").alias("stop")).withColumn("cell", F.floor(F.col("stop") / width))
    met = p.join(stops, [*keys, "cell"]).where(F.col("stop").between(F.col("lap_start") - before, F.col("lap_end")) | F.col("stop").between(F.col("lap_start") - before, F.col("lap_start") - 1))
    own = met.groupBy(*keys, "start_ms", "lap_end", "driver").agg(F.min(F.when(F.col("stop") < F.col("lap_start"), F.col("stop"))).alias("early"), F.min(F.when(F.col("stop") >= F.col("lap_start"), F.col("stop"))).alias("inside"))
    own = own.withColumns({"class": F.when(F.col("early").isNotNull(), "before").otherwise("during"), "stop": F.coalesce("early", "inside")})
    place = lambda lap, name: laps.select(*keys, "driver", F.col("lap_number").alias(lap), F.col("position").alias(name))
    out = own.withColumn("prior", F.col("stop") - 1).join(place("prior", "p0"), [*keys, "driver", "prior"]).join(place("lap_end", "p1"), [*keys, "driver", "lap_end"])
    return out.where("p0 is not null and p1 is not null").select(*keys, "start_ms", "driver", "class", "stop", (F.col("p0") - F.col("p1")).alias("gained"))
