"""What a timing service answers, as DataFrames, and a command line over the catalogue.

    python -m paceforge.plans.serve race_pace /data/season [rows]
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceforge.operators import laps as L
from paceforge.operators import race as R
from paceforge.operators import timeseries as T
from paceforge.plans import catalogue
from paceforge.sources.tables import read


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "laps").groupBy("round").agg(F.countDistinct("driver").alias("n_drivers"), F.max("lap_number").alias("n_laps"))


def driver_laps(spark: SparkSession, sf_dir: str, round_: int, driver: int | None = None) -> DataFrame:
    laps = read(spark, sf_dir, "laps").where(F.col("round") == round_)
    laps = laps if driver is None else laps.where(F.col("driver") == driver)
    return laps.select("driver", "lap_number", "compound", "tyre_life", "lap_time_s", "position").orderBy("driver", "lap_number")


def telemetry(spark: SparkSession, sf_dir: str, driver: int, lap: int, points: int = 300) -> DataFrame:
    d = read(spark, sf_dir, "telemetry").where((F.col("driver") == driver) & (F.col("lap_number") == lap))
    return T.downsample(d, ["driver"], "ord", points).select("t_s", "distance_m", "speed", "throttle", "brake", "gear", "drs").orderBy("t_s")


def compare(spark: SparkSession, sf_dir: str, a: int, b: int, lap: int, points: int = 200) -> DataFrame:
    """Time and speed of two drivers on one grid of relative distance, and the time between them."""
    d = read(spark, sf_dir, "telemetry").where(F.col("driver").isin(a, b) & (F.col("lap_number") == lap))
    ends = d.groupBy("driver").agg(F.min("distance_m").alias("lo"), F.max("distance_m").alias("hi"), F.min("t_s").alias("t0"))
    rel = d.join(ends, "driver").select("driver", ((F.col("distance_m") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).alias("x"), (F.col("t_s") - F.col("t0")).alias("t"), "speed")
    rel = rel.where("x is not null").groupBy("driver", "x").agg(F.min("t").alias("t"), F.max("speed").alias("speed"))
    grid = ends.select("driver", F.explode(F.sequence(F.lit(0), F.lit(points))).alias("i")).select("driver", "i", (F.col("i") / points).alias("x"))
    at = T.interpolate(rel.select("driver", "x", "t"), grid, ["driver"], "x", "t").join(T.interpolate(rel.select("driver", "x", "speed"), grid, ["driver"], "x", "speed"), ["driver", "i", "x"])
    side = lambda c, who: F.max(F.when(F.col("driver") == who, F.col(c)))
    out = at.groupBy("i", "x").agg(side("t", a).alias("t_a"), side("t", b).alias("t_b"), side("speed", a).alias("v_a"), side("speed", b).alias("v_b"))
    return out.withColumn("delta_s", F.col("t_b") - F.col("t_a")).orderBy("i")


def strategy(spark: SparkSession, sf_dir: str, round_: int) -> DataFrame:
    return L.stints(read(spark, sf_dir, "laps").where(F.col("round") == round_)).orderBy("driver", "first_lap")


def overtakes(spark: SparkSession, sf_dir: str, round_: int) -> DataFrame:
    return R.overtake_events(read(spark, sf_dir, "laps").where(F.col("round") == round_)).orderBy("lap_number", "gainer", "loser")


def main(args: list[str]) -> None:
    known = catalogue.queries()
    if len(args) < 2 or args[0] not in known:
        sys.exit(f"{__doc__}\nqueries: {', '.join(sorted(known))}")
    spark = SparkSession.builder.appName("paceforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    known[args[0]](spark, args[1]).show(int(args[2]) if len(args) > 2 else 20, truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
