"""Cars on the track by sampled position: who is next ahead, attempts to pass, where a pass happened, and what following costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceforge.operators.laps import fuel_corrected


def driver_ahead(samples: DataFrame, keys: list[str], length_m: float, bucket_us: int) -> DataFrame:
    """The next car round the circle for every car and time bucket: keys, driver, lap_number, bucket, t_us, place_m, ahead, gap_m.

    ``samples``: keys, driver, lap_number, t_us, distance_m. A car stands where its last sample
    of the bucket puts it (the later lap on a tie), at its distance modulo the track's
    length; the last car of a round sees the first one a length further. Cars alone in a bucket have no row,
    cars at one place are ordered by driver. The samples fold to one row per car and
    bucket before the window, whose groups hold a field of cars at most, whatever the sampling rate.
    """
    bucket = F.floor(F.col("t_us") / bucket_us).alias("bucket")
    last = samples.groupBy(*keys, bucket, "driver").agg(F.max(F.struct("t_us", "lap_number", "distance_m")).alias("s"))
    last = last.select(*keys, "bucket", "driver", "s.lap_number", "s.t_us", (F.col("s.distance_m") - F.floor(F.col("s.distance_m") / length_m) * length_m).alias("place_m"))
    w = Window.partitionBy(*keys, "bucket").orderBy("place_m", "driver")
    everyone = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = last.withColumns(
        {"next": F.lead("driver").over(w), "next_m": F.lead("place_m").over(w), "front": F.first("driver").over(everyone), "front_m": F.first("place_m").over(everyone), "cars": F.count(F.lit(1)).over(everyone)}
    )
    gap = F.coalesce(F.col("next_m"), F.col("front_m") + length_m) - F.col("place_m")
    return seen.where("cars > 1").select(*keys, "driver", "lap_number", "bucket", "t_us", "place_m", F.coalesce("next", "front").alias("ahead"), F.round(gap, 4).alias("gap_m"))


def closest_approach(following: DataFrame, laps: DataFrame, keys: list[str]) -> DataFrame:
    """Least gap of each lap to the rival: the driver one place ahead at the end of the lap before.

    Green laps of the chaser only; laps on which the car ahead on the track never is the rival have no row.
    ``laps``: keys, driver, lap_number, position, track_status.
    """
    place = laps.select(*keys, "driver", "lap_number", "position")
    before = place.select(*keys, "driver", (F.col("lap_number") + 1).alias("lap_number"), (F.col("position") - 1).alias("position"))
    ahead = place.select(*keys, F.col("driver").alias("rival"), (F.col("lap_number") + 1).alias("lap_number"), "position")
    rivals = before.join(ahead, [*keys, "lap_number", "position"]).drop("position")
    green = laps.where("track_status = '1'").select(*keys, "driver", "lap_number")
    rivals = rivals.join(green, [*keys, "driver", "lap_number"], "left_semi")
    met = following.select(*keys, "driver", "lap_number", F.col("ahead").alias("rival"), "gap_m").join(rivals, [*keys, "driver", "lap_number", "rival"])
    return met.groupBy(*keys, "driver", "rival", "lap_number").agg(F.min("gap_m").alias("least_m"), F.count(F.lit(1)).alias("n_samples"))


def attempts(approach: DataFrame, laps: DataFrame, keys: list[str], near_m: float = 3.0) -> DataFrame:
    """Approaches under ``near_m``; a success has the chaser before the rival at the end of the lap, a missing position is none."""
    end = lambda who: laps.select(*keys, F.col("driver").alias(who), "lap_number", F.col("position").alias(f"{who}_pos"))
    d = approach.where(F.col("least_m") < near_m)
    d = d.join(end("driver"), [*keys, "driver", "lap_number"], "left").join(end("rival"), [*keys, "rival", "lap_number"], "left")
    return d.select(*keys, "driver", "rival", "lap_number", "least_m", F.coalesce(F.col("driver_pos") < F.col("rival_pos"), F.lit(False)).alias("success"))


def locate_overtakes(events: DataFrame, following: DataFrame, zones: DataFrame, keys: list[str], zone_keys: list[str], near_m: float = 30.0, width: float = 100.0) -> DataFrame:
    """Place of each overtake, and whether it lies in a zone: keys, lap_number, gainer, loser, place_m, in_zone.

    The place is that of the gainer's last sample of the lap with the loser next ahead and nearer than
    ``near_m``; events without one have no row. ``zones``: zone_keys, start_m, end_m (both ends
    inside), from whatever session they were measured in. Zones are dealt to cells of ``width``
    metres, so that the interval join is an equi join with a residual.
    """
    near = following.where(F.col("gap_m") < near_m).select(*keys, "lap_number", F.col("driver").alias("gainer"), F.col("ahead").alias("loser"), "t_us", "place_m")
    found = events.select(*keys, "lap_number", "gainer", "loser").join(near, [*keys, "lap_number", "gainer", "loser"])
    found = found.groupBy(*keys, "lap_number", "gainer", "loser").agg(F.round(F.max_by("place_m", F.struct("t_us", "place_m")), 1).alias("place_m"))
    cells = zones.select(*zone_keys, "start_m", "end_m", F.explode(F.sequence(F.floor(F.col("start_m") / width), F.floor(F.col("end_m") / width))).alias("cell"))
    inside = found.withColumn("cell", F.floor(F.col("place_m") / width)).join(cells, [*zone_keys, "cell"], "left")
    hit = F.coalesce(F.col("place_m").between(F.col("start_m"), F.col("end_m")), F.lit(False))
    return inside.groupBy(*keys, "lap_number", "gainer", "loser", "place_m").agg(F.bool_or(hit).alias("in_zone"))


def following_laps(following: DataFrame, laps: DataFrame, keys: list[str], near_m: float = 50.0) -> DataFrame:
    """Each green lap against the car ahead: keys, driver, lap_number, sec_fuel, median_m, least_m, near_pct, compound, tyre_life.

    A gap of zero is unknown: it is neither in the median nor the least, but among the samples
    that near_pct is a share of. Box laps, inaccurate laps and laps without a time or a sample have no row.
    A lap's samples are one group.
    """
    gap = F.nullif("gap_m", F.lit(0.0))
    seen = following.groupBy(*keys, "driver", "lap_number").agg(
        F.round(F.median(gap), 4).alias("median_m"), F.min(gap).alias("least_m"), F.round(F.avg(F.coalesce(gap < near_m, F.lit(False)).cast("double")) * 100, 4).alias("near_pct")
    )
    raced = laps.where("track_status = '1' and is_accurate and not pit_in and not pit_out and lap_time_s is not null")
    raced = raced.select(*keys, "driver", "lap_number", F.round(fuel_corrected(), 4).alias("sec_fuel"), "compound", "tyre_life")
    return raced.join(seen, [*keys, "driver", "lap_number"]).select(*keys, "driver", "lap_number", "sec_fuel", "median_m", "least_m", "near_pct", "compound", "tyre_life")


def following_cost(report: DataFrame, keys: list[str], far_m: float = 500.0, least: int = 5) -> DataFrame:
    """Seconds that a percent of a lap spent near costs: keys, driver, n, slope, intercept, r2 of a driver's laps (``following_laps``).

    Laps with a median gap of ``far_m`` or more are left out, as are laps without one. The line over
    tyre age is taken off first. Under ``least`` laps, with a single tyre age or always the same
    share near, the three figures are null.
    """
    w = Window.partitionBy(*keys, "driver")
    d = report.where(F.col("median_m").isNotNull() & F.col("tyre_life").isNotNull() & (F.col("median_m") < far_m))
    d = d.withColumn("rest", F.col("sec_fuel") - F.regr_slope("sec_fuel", "tyre_life").over(w) * F.col("tyre_life"))
    out = d.groupBy(*keys, "driver").agg(
        F.count(F.lit(1)).alias("n"), F.min("tyre_life").alias("lo"), F.max("tyre_life").alias("hi"), F.min("near_pct").alias("p0"), F.max("near_pct").alias("p1"),
        F.regr_slope("rest", "near_pct").alias("s"), F.regr_intercept("rest", "near_pct").alias("i"), F.regr_r2("rest", "near_pct").alias("r"),
    )
    ok = (F.col("n") >= least) & (F.col("lo") < F.col("hi")) & (F.col("p0") < F.col("p1"))
    return out.select(*keys, "driver", "n", *(F.when(ok, F.round(F.col(c) + 1e-7, 4)).alias(name) for c, name in (("s", "slope"), ("i", "intercept"), ("r", "r2"))))
