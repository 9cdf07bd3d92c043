"""Marts and dimensions: pace by driver and event, race configurations, circuits, features of laps, the effect of the track's temperature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceforge.operators.timeseries import elevation, path_length


def driver_pace(clean: DataFrame, event: list[str], least: int = 5) -> DataFrame:
    """Median pace of each driver with at least ``least`` clean laps in an event, and its ratio to the event's best."""
    d = clean.groupBy(*event, "driver").agg(F.count(F.lit(1)).alias("n_laps"), F.median("lap_time_s").alias("median_s")).where(F.col("n_laps") >= least)
    return d.withColumn("rel_pace", F.col("median_s") / F.min("median_s").over(Window.partitionBy(*event)))


def pace_by_name(mart: DataFrame, drivers: DataFrame, keys: list[str], least: int = 10, top: int = 10) -> DataFrame:
    """The ``top`` names of the driver dimension (keys, name) by mean relative pace over at least ``least`` events; ties by name."""
    d = mart.join(drivers, keys).groupBy("name").agg(F.count(F.lit(1)).alias("events"), F.round(F.avg("rel_pace"), 4).alias("mean_rel_pace")).where(F.col("events") >= least)
    return d.orderBy("mean_rel_pace", "name").limit(top)


def race_configs(fits: DataFrame, laps: DataFrame, loss: DataFrame, event: list[str], two_compounds: bool = True) -> DataFrame:
    """A row for each event and compound with reliable fits: slope, base_s at tyre age 1, max_age, and the event's n_laps and pit_loss_s.

    Medians over the stints' fits (event, compound, slope, intercept, n, reliable). Events with fewer than two
    such compounds have no row if ``two_compounds``.
    """
    ok = fits.where("reliable and compound is not null")
    d = ok.groupBy(*event, "compound").agg(F.median("slope").alias("s"), F.median("intercept").alias("b"), F.max("n").alias("max_age"))
    d = d.withColumn("compounds", F.count(F.lit(1)).over(Window.partitionBy(*event))).where(F.col("compounds") >= (2 if two_compounds else 1))
    length = laps.groupBy(*event).agg(F.max("lap_number").alias("n_laps"))
    d = d.join(length, event).join(loss.select(*event, "pit_loss_s"), event, "left")
    return d.select(*event, "compound", F.round(F.col("s") + 1e-7, 4).alias("slope"), F.round(F.col("b") + F.col("s") + 1e-7, 3).alias("base_s"), "max_age", "n_laps", "pit_loss_s")


def circuit_dimension(asked: DataFrame, points: DataFrame, corners: DataFrame, keys: list[str], units_per_m: float = 10.0) -> DataFrame:
    """A row for every circuit asked for: corners, length_m, elev_gain_m, elev_span_m, and the error where there is no position.

    ``points``: keys, ord, x, y, z of one lap in ``1 / units_per_m`` metres; ``corners``: keys, one row a corner. Each figure
    is null on its own where its source has nothing.
    """
    own = points.join(asked.select(*keys).distinct(), keys, "left_semi")
    metres = own.select(*keys, "ord", *((F.col(c) / units_per_m).alias(c) for c in ("x", "y", "z")))
    out = asked.select(*keys).distinct().join(corners.groupBy(*keys).agg(F.count(F.lit(1)).alias("corners")), keys, "left")
    out = out.join(path_length(metres, keys).select(*keys, F.round("length", 1).alias("length_m")), keys, "left")
    out = out.join(elevation(metres, keys).select(*keys, F.col("gain_m").alias("elev_gain_m"), F.col("span_m").alias("elev_span_m")), keys, "left")
    return out.withColumn("error", F.when(F.col("length_m").isNull(), F.lit("no position")))


def field_features(laps: DataFrame, event: list[str], least: int = 10) -> DataFrame:
    """The field on each accurate lap with at least ``least`` cars: spread of the lap times, mean speed at the line, cars."""
    d = laps.where("is_accurate").groupBy(*event, "lap_number").agg(F.stddev_samp("lap_time_s").alias("std_s"), F.avg("speed_fl").alias("mean_speed"), F.count("lap_time_s").alias("n"))
    return d.where((F.col("n") >= least) & F.col("std_s").isNotNull() & F.col("mean_speed").isNotNull())


def temperature_effect(laps: DataFrame, keys: list[str], limit_s: float = 3.0, least: int = 20) -> DataFrame:
    """What a degree of track temperature costs, tyre age held fixed: naive_slope, naive_r2, r2_tyre, r2_full, coef_temp, se_temp, coef_tyre, intercept, n.

    ``laps``: keys, driver, track_temp, tyre_life, corrected_s, rainfall. Dry laps with all values; the naive line is
    that of the plain times on temperature. Then times are taken against the driver's median, those further than ``limit_s``
    go, and least squares on temperature and age follow from centred sums. Sessions with under ``least`` laps
    before or after, or whose temperature and age are collinear, have no row.
    """
    dry = laps.where("not rainfall").dropna(subset=["track_temp", "corrected_s", "tyre_life"])
    w = Window.partitionBy(*keys, "driver")
    dry = dry.withColumn("rel", F.col("corrected_s") - F.median("corrected_s").over(w)).withColumn("near", F.abs("rel") < limit_s)
    x, z, y = (F.when(F.col("near"), F.col(c).cast("double")) for c in ("track_temp", "tyre_life", "rel"))
    s = dry.groupBy(*keys).agg(
        F.regr_slope("corrected_s", "track_temp").alias("naive_slope"), F.regr_r2("corrected_s", "track_temp").alias("naive_r2"), F.count(F.lit(1)).alias("all"), F.count_if("near").alias("n"),
        F.avg(x).alias("mx"), F.avg(z).alias("mz"), F.avg(y).alias("my"), F.var_pop(x).alias("xx"), F.var_pop(z).alias("zz"), F.var_pop(y).alias("yy"),
        F.covar_pop(x, z).alias("xz"), F.covar_pop(x, y).alias("xy"), F.covar_pop(z, y).alias("zy"),
    )
    s = s.where((F.col("all") >= least) & (F.col("n") >= least)).withColumn("det", F.col("xx") * F.col("zz") - F.col("xz") ** 2).where("det > 1e-9 and yy > 0")
    s = s.withColumns({"b": (F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz")) / F.col("det"), "c": (F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz")) / F.col("det")})
    left = F.col("yy") - F.col("b") * F.col("xy") - F.col("c") * F.col("zy")  # mean squared residual
    se = F.sqrt(F.greatest(left, F.lit(0.0)) / (F.col("n") - 3) * F.col("zz") / F.col("det"))
    return s.select(
        *keys, F.round("naive_slope", 6).alias("naive_slope"), F.round("naive_r2", 6).alias("naive_r2"), F.round(F.col("zy") ** 2 / F.col("zz") / F.col("yy"), 6).alias("r2_tyre"), F.round(1 - left / F.col("yy"), 6).alias("r2_full"),
        F.round("b", 6).alias("coef_temp"), F.round(se, 6).alias("se_temp"), F.round("c", 6).alias("coef_tyre"), F.round(F.col("my") - F.col("b") * F.col("mx") - F.col("c") * F.col("mz"), 4).alias("intercept"), "n",
    )
