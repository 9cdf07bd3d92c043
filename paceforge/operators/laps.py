"""Lap-level operators: which laps count, pace, stints, degradation, pit stops.

``keys`` names the columns of a session, such as season, round and session; every best lap,
median, rank and previous lap stays inside one. Tables of a single season need only the round.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FUEL_KG_PER_LAP, FUEL_S_PER_KG = 1.8, 0.03
MAD_FACTOR, MAD_LIMIT = 0.6745, 3.5
KEYS = ("round",)


def valid(deleted: str = "deleted") -> Column:
    """A lap whose deletion is unknown counts as valid."""
    return ~F.coalesce(F.col(deleted), F.lit(False))


def fuel_corrected(time: str = "lap_time_s", lap: str = "lap_number", total: str = "total_laps") -> Column:
    """Lap time at an empty tank."""
    return F.col(time) - (F.col(total) - F.col(lap)) * F.lit(FUEL_KG_PER_LAP * FUEL_S_PER_KG)


def lap_filters(threshold: float, keys: Sequence[str] = KEYS, best: Column | None = None) -> list[tuple[str, Column]]:
    """The cleaning steps in order; the last compares with the session's best lap of all laps."""
    best = F.min("lap_ms").over(Window.partitionBy(*keys)) if best is None else best
    return [
        ("no_box", ~F.col("pit_in") & ~F.col("pit_out")),
        ("accurate", F.col("is_accurate")),
        ("green", F.col("track_status") == "1"),
        ("valid", valid()),
        ("quick", F.col("lap_ms") < F.lit(threshold) * best),
    ]


def clean_laps(laps: DataFrame, threshold: float = 1.07, keys: Sequence[str] = KEYS) -> DataFrame:
    """Best laps, one row a session, go to the laps, which stay where they are; unknown keys are a session too."""
    best = laps.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.min("lap_ms").alias("__best"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys), F.lit(True))
    keep = reduce(and_, (step for _, step in lap_filters(threshold, keys, F.col("__best"))))
    return laps.join(F.broadcast(best), same).where(keep).select(*laps.columns)


def quality_funnel(laps: DataFrame, threshold: float = 1.07, keys: Sequence[str] = KEYS) -> DataFrame:
    """Laps left after each step, from one pass over the laps."""
    steps = lap_filters(threshold, keys)
    flags, so_far = laps, F.lit(True)
    for name, step in steps:
        flags = flags.withColumn(f"__{name}", step)
    sums = [F.count(F.lit(1)).alias("all")]
    for name, _ in steps:
        so_far = so_far & F.col(f"__{name}")
        sums.append(F.count_if(so_far).alias(name))
    wide = flags.groupBy(*keys).agg(*sums)
    names = ["all", *(n for n, _ in steps)]
    pairs = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(n).alias("filter"), F.col(f"`{n}`").alias("n_laps")) for i, n in enumerate(names)))
    return wide.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")


def with_mad(df: DataFrame, value: str, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    apart = df.withColumn("__apart", F.abs(F.col(value) - F.median(value).over(w)))
    out = apart.withColumn("__mad", F.median("__apart").over(w))
    scaled = MAD_FACTOR * F.col("__apart") / F.nullif(F.col("__mad"), F.lit(0.0))
    return out.withColumn("mad_outlier", F.coalesce(scaled > MAD_LIMIT, F.lit(False))).drop("__apart", "__mad")


def outlier_classes(laps: DataFrame, threshold: float = 1.07, keys: Sequence[str] = KEYS) -> DataFrame:
    """How the quick-lap rule and the MAD rule agree, lap by lap, counted per round."""
    slow = F.col("lap_ms") >= F.lit(threshold) * F.min("lap_ms").over(Window.partitionBy(*keys))
    seen = with_mad(laps.withColumn("slow", slow), "lap_time_s", *keys, "driver")
    kind = F.when(F.col("slow") & F.col("mad_outlier"), "both").when(F.col("slow"), "threshold_only").when(F.col("mad_outlier"), "mad_only").otherwise("kept")
    return seen.groupBy(*keys, kind.alias("category")).agg(F.count(F.lit(1)).alias("n_laps"))


def race_pace(laps: DataFrame, threshold: float = 1.07, min_laps: int = 8, keys: Sequence[str] = KEYS) -> DataFrame:
    """Median fuel-corrected time per driver over clean laps."""
    pace = clean_laps(laps, threshold, keys).withColumn("t", fuel_corrected())
    return pace.groupBy(*keys, "driver").agg(F.count("t").alias("n_laps"), F.min("team").alias("team"), F.median("t").alias("pace")).where(F.col("n_laps") >= min_laps)


def pace_table(laps: DataFrame, keys: Sequence[str] = KEYS, **kw) -> DataFrame:
    pace = race_pace(laps, keys=keys, **kw)
    gap = F.col("pace") - F.min("pace").over(Window.partitionBy(*keys))
    return pace.select(*keys, "driver", "team", "n_laps", F.round("pace", 4).alias("pace_s"), F.round(gap, 4).alias("delta_s"))


def stints(laps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return laps.groupBy(*keys, "driver", "stint", "compound").agg(F.min("lap_number").alias("first_lap"), F.max("lap_number").alias("last_lap"), F.count("lap_number").alias("n_laps"))


def stint_positions(laps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Places won or lost between a stint's first and last lap."""
    return (
        laps.groupBy(*keys, "driver", "stint").agg(F.min_by("position", "lap_number").alias("start_position"), F.max_by("position", "lap_number").alias("end_position"))
        .withColumn("gained", F.col("start_position") - F.col("end_position"))
    )


def guarded_fit(x: str, y: str) -> list[Column]:
    """slope, intercept, r2, n of y on x; r2 is 0 for a constant y."""
    r2 = F.when(F.var_pop(y) == 0, 0.0).otherwise(F.regr_r2(y, x))
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), r2.alias("r2"), F.regr_count(y, x).alias("n")]


def degradation(laps: DataFrame, threshold: float = 1.10, min_laps: int = 6, keys: Sequence[str] = KEYS) -> DataFrame:
    """Line of corrected time over tyre age for each stint and compound; constant ages have none."""
    pace = clean_laps(laps, threshold, keys).withColumn("t", fuel_corrected())
    fits = pace.groupBy(*keys, "driver", "stint", "compound").agg(*guarded_fit("tyre_life", "t"), F.min("tyre_life").alias("lo"), F.max("tyre_life").alias("hi"), F.min_by("fresh_tyre", "lap_number").alias("fresh"))
    fits = fits.where((F.col("n") >= min_laps) & (F.col("lo") < F.col("hi"))).drop("lo", "hi")
    return fits.withColumn("reliable", (F.col("n") >= 6) & (F.col("r2") >= 0.3))


def degradation_by(fits: DataFrame, *keys: str) -> DataFrame:
    return fits.groupBy(*keys).agg(F.round(F.avg("slope"), 4).alias("mean_slope"), F.round(F.stddev_samp("slope"), 4).alias("std_slope"), F.count(F.lit(1)).alias("n_stints"))


def tyre_models(fits: DataFrame) -> DataFrame:
    return fits.groupBy("compound").agg(F.round(F.median("slope"), 4).alias("slope"), F.round(F.median("intercept"), 4).alias("base"), F.count(F.lit(1)).alias("n_stints"))


def stint_cliff(laps: DataFrame, min_segment: int = 4, keys: Sequence[str] = KEYS) -> DataFrame:
    """Two-line fit of every stint: the split with the least squared error, if it pays.

    Prefix sums over the stint in order of tyre age give both sides' error at each split
    in closed form. A cliff needs 8 laps, a total error of at most 0.8 of the single line's
    and a steeper right side. y is centred first, as the sums would cancel otherwise.
    """
    key = [*keys, "driver", "stint"]
    w = Window.partitionBy(*key)
    run = w.orderBy("tyre_life", "lap_number").rowsBetween(Window.unboundedPreceding, 0)
    d = laps.select(*key, "lap_number", F.col("tyre_life").cast("double").alias("x"), "tyre_life", (F.col("lap_time_s") - F.avg("lap_time_s").over(w)).alias("y"))
    d = d.withColumn("i", F.row_number().over(w.orderBy("tyre_life", "lap_number"))).withColumn("n", F.count(F.lit(1)).over(w))
    parts = {"1": F.lit(1.0), "x": F.col("x"), "y": F.col("y"), "xx": F.col("x") ** 2, "xy": F.col("x") * F.col("y"), "yy": F.col("y") ** 2}
    for k, e in parts.items():
        d = d.withColumn(f"l{k}", F.sum(e).over(run)).withColumn(f"t{k}", F.sum(e).over(w))

    def line(p: dict[str, Column]) -> tuple[Column, Column, Column]:
        sxx, sxy, syy = p["xx"] - p["x"] ** 2 / p["1"], p["xy"] - p["x"] * p["y"] / p["1"], p["yy"] - p["y"] ** 2 / p["1"]
        return syy - sxy**2 / F.when(sxx > 1e-9, sxx), sxy / F.when(sxx > 1e-9, sxx), sxx

    left = {k: F.col(f"l{k}") for k in parts}
    right = {k: F.col(f"t{k}") - F.col(f"l{k}") for k in parts}
    whole = {k: F.col(f"t{k}") for k in parts}
    inside = (F.col("i") >= min_segment) & (F.col("i") <= F.col("n") - min_segment)
    d = d.withColumn("next_x", F.lead("x").over(w.orderBy("tyre_life", "lap_number")))
    cut = d.where((F.col("n") >= 8) & inside).select(*key, "i", "next_x", line(whole)[0].alias("single"), (line(left)[0] + line(right)[0]).alias("sse"), line(left)[1].alias("ls"), line(right)[1].alias("rs"))
    best = cut.where("sse is not null").groupBy(*key).agg(F.min_by(F.struct("i", "next_x", "single", "sse", "ls", "rs"), F.struct(F.round("sse", 6), "i")).alias("b")).select(*key, "b.*")
    return best.where((F.col("single") >= 1e-6) & (F.col("sse") <= 0.8 * F.col("single")) & (F.col("rs") > F.col("ls"))).select(*key, F.col("next_x").cast("bigint").alias("cliff_age"))


def pit_loss(laps: DataFrame, exclude_red: bool = True, base: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Median excess of in-laps plus median excess of out-laps over the driver's clean median of the session, or over ``base``'s."""
    if base is None:
        base = clean_laps(laps, 1.10, keys).groupBy(*keys, "driver").agg(F.median("lap_time_s").alias("base"))
    used = laps.where(~F.coalesce(F.col("track_status").contains("5"), F.lit(False))) if exclude_red else laps
    extra = F.col("lap_time_s") - F.col("base")
    return (
        used.join(base, [c for c in (*keys, "driver") if c in base.columns]).groupBy(*keys)
        .agg(F.round(F.median(F.when(F.col("pit_in"), extra)), 6).alias("in_loss_s"), F.round(F.median(F.when(F.col("pit_out"), extra)), 6).alias("out_loss_s"))
        .withColumn("pit_loss_s", F.round(F.col("in_loss_s") + F.col("out_loss_s"), 6))
    )


def pit_stops(laps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """In-lap with the out-lap that follows at once: compounds before and after, and the time both took."""
    w = Window.partitionBy(*keys, "driver").orderBy("lap_number")
    follows = (F.lead("lap_number").over(w) == F.col("lap_number") + 1) & F.lead("pit_out").over(w)
    d = laps.withColumn("after", F.when(follows, F.lead("compound").over(w))).withColumn("out_ms", F.when(follows, F.lead("lap_ms").over(w)))
    return d.where("pit_in").select(*keys, "driver", "team", F.col("lap_number").alias("in_lap"), "stint", F.col("compound").alias("compound_before"), F.col("after").alias("compound_after"), ((F.col("lap_ms") + F.col("out_ms")) / 1000).alias("duration_s"))


def team_pit_ranking(stops: DataFrame, low: float, high: float) -> DataFrame:
    d = stops.where(F.col("duration_s").between(low, high))
    q = lambda p: F.percentile("duration_s", F.lit(p))
    return d.groupBy("team").agg(F.round(F.median("duration_s"), 4).alias("median_s"), F.min("duration_s").alias("best_s"), F.round(q(0.75) - q(0.25), 6).alias("iqr_s"), F.count(F.lit(1)).alias("n_stops"))


def pit_window_pressure(stops: DataFrame, crowd: int = 4, keys: Sequence[str] = KEYS) -> DataFrame:
    """Median stop alone on a lap against laps on which ``crowd`` or more stop."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, "in_lap"))
    d = stops.where("duration_s is not null").withColumn("n", n)
    return d.groupBy(*keys).agg(
        F.round(F.median(F.when(F.col("n") == 1, F.col("duration_s"))), 4).alias("alone_s"), F.round(F.median(F.when(F.col("n") >= crowd, F.col("duration_s"))), 4).alias("crowd_s"),
        F.count_if(F.col("n") == 1).alias("n_alone"), F.count_if(F.col("n") >= crowd).alias("n_crowd"),
    )


def best_sectors(laps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Theoretical best lap from a driver's best sectors."""
    d = laps.groupBy(*keys, "driver").agg(*(F.min(f"s{i}_ms").alias(f"s{i}_ms") for i in (1, 2, 3)), F.min("lap_ms").alias("best_ms"))
    return d.withColumn("ideal_ms", F.col("s1_ms") + F.col("s2_ms") + F.col("s3_ms")).withColumn("unused_ms", F.col("best_ms") - F.col("ideal_ms"))


def speed_traps(laps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    traps = ("speed_i1", "speed_i2", "speed_fl", "speed_st")
    return laps.groupBy(*keys, "driver").agg(*(F.round(F.max(t), 3).alias(t) for t in traps)).withColumn("top", F.greatest(*traps))


def teammate_duels(laps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Teams of exactly two drivers in a round: the faster by best lap, the slower, and the gap."""
    best = laps.groupBy(*keys, "team", "driver").agg(F.min("lap_ms").alias("ms"))
    w = Window.partitionBy(*keys, "team")
    d = best.withColumn("k", F.row_number().over(w.orderBy("ms", "driver"))).withColumn("n", F.count(F.lit(1)).over(w)).where("n = 2")
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    out = d.groupBy(*keys, "team").agg(pick("driver", 1).alias("faster"), pick("driver", 2).alias("slower"), pick("ms", 1).alias("a"), pick("ms", 2).alias("b"))
    return out.select(*keys, "team", "faster", "slower", (F.col("b") - F.col("a")).alias("gap_ms"), F.round((F.col("b") - F.col("a")) / F.col("a") * 100, 4).alias("gap_pct"))


def field_spread(laps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return laps.where("position is not null").groupBy(*keys, "lap_number").agg((F.max("end_ms") - F.min("end_ms")).alias("spread_ms"), F.count(F.lit(1)).alias("n_cars"))


def common_compound(laps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Most used compound per lap (ties: first by name) and its share."""
    n = laps.groupBy(*keys, "lap_number", "compound").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys, "lap_number")
    d = n.withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "compound"))).withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 4))
    return d.where("k = 1").select(*keys, "lap_number", "compound", "share")


def rolling_pace(laps: DataFrame, size: int = 5, least: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """Median of a driver's last ``size`` laps once there are ``least``."""
    w = Window.partitionBy(*keys, "driver").orderBy("lap_number").rowsBetween(1 - size, 0)
    return laps.select(*keys, "driver", "lap_number", F.when(F.count("lap_time_s").over(w) >= least, F.percentile("lap_time_s", F.lit(0.5)).over(w)).alias("rolling_s")).where("rolling_s is not null").withColumn("rolling_s", F.round("rolling_s", 4))


def current_board(rolling: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each driver's latest rolling pace, fastest first."""
    w = Window.partitionBy(*keys, "driver").orderBy(F.desc("lap_number"))
    return rolling.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k").orderBy(*keys, F.asc_nulls_last("rolling_s"), "driver")


def fastest_laps(laps: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the fastest lap of each session, box laps left out; ties go to the smaller driver, then the earlier lap."""
    driven = laps.where(~F.col("pit_in") & ~F.col("pit_out") & F.col("lap_ms").isNotNull())
    best = driven.groupBy(*keys).agg(F.min(F.struct("lap_ms", "driver", "lap_number", "compound")).alias("best"))
    return best.select(*keys, *(f"best.{c}" for c in ("driver", "lap_number", "lap_ms", "compound") if c not in keys))


def n_quickest(laps: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` quickest laps of each group; ties go to the earlier lap."""
    w = Window.partitionBy(*keys).orderBy("lap_ms", "lap_number")
    return laps.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).select(*keys, "lap_number", "lap_ms")


def stop_numbers(laps: DataFrame, keys: list[str]) -> DataFrame:
    """In-laps numbered from 0 within each group."""
    w = Window.partitionBy(*keys).orderBy("lap_number")
    return laps.where("pit_in").select(*keys, "lap_number", (F.row_number().over(w) - 1).cast("bigint").alias("nth_stop"))


def lap_spine(laps: DataFrame, keys: list[str]) -> DataFrame:
    """Every lap from 1 to a group's last one, with whether it was recorded."""
    spine = laps.groupBy(*keys).agg(F.max("lap_number").alias("n")).select(*keys, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n").cast("bigint"))).alias("lap_number"))
    seen = laps.select(*keys, F.col("lap_number").cast("bigint").alias("lap_number"), F.lit(True).alias("seen")).distinct()
    return spine.join(seen, [*keys, "lap_number"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def stint_offsets(laps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Laps of each stint and where it starts when a driver's stints are stacked."""
    w = Window.partitionBy(*keys, "driver").orderBy("stint").rowsBetween(Window.unboundedPreceding, -1)
    d = laps.groupBy(*keys, "driver", "stint").agg(F.count(F.lit(1)).alias("n_laps"))
    return d.withColumn("start_at", F.coalesce(F.sum("n_laps").over(w), F.lit(0).cast("bigint")))


def neutral_stops(stops: DataFrame, laps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Stops by the track status of their in-lap: green, neutral (safety car, real or virtual) or other."""
    status = laps.select(*keys, "driver", F.col("lap_number").alias("in_lap"), "track_status")
    kind = F.when(F.col("track_status").rlike("[467]"), "neutral").when(F.col("track_status") == "1", "green").otherwise("other")
    d = stops.join(status, [*keys, "driver", "in_lap"]).withColumn("kind", kind)
    return d.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("n_stops"), F.round(F.median("duration_s"), 4).alias("median_s"))


def session_evolution(laps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Laps that were the session's quickest when they ended."""
    w = Window.partitionBy(*keys).orderBy("end_ms", "driver", "lap_number").rowsBetween(Window.unboundedPreceding, -1)
    d = laps.withColumn("before", F.min("lap_ms").over(w))
    return d.where(F.col("before").isNull() | (F.col("lap_ms") < F.col("before"))).select(*keys, "driver", "lap_number", "end_ms", "lap_ms", (F.col("before") - F.col("lap_ms")).alias("gain_ms"))


def lap_features(laps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The field on each lap: cars, median time, share of box laps, share of fresh tyres."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    return laps.groupBy(*keys, "lap_number").agg(
        F.count(F.lit(1)).alias("n_cars"), F.round(F.median("lap_time_s"), 4).alias("median_s"), share("pit_in").alias("pit_share"), share("fresh_tyre").alias("fresh_share")
    )


def lap_histogram(laps: DataFrame, width_ms: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Laps of a round by bins of equal width."""
    at = F.floor(F.col("lap_ms") / F.lit(width_ms)) * width_ms
    return laps.groupBy(*keys, at.cast("bigint").alias("from_ms")).agg(F.count(F.lit(1)).alias("n"))


def set_overlap(laps: DataFrame, keys: list[str], a: Column, b: Column, item: str = "driver") -> DataFrame:
    """How many items have rows with ``a``, with ``b``, with both and with either."""
    one = laps.groupBy(*keys, item).agg(F.bool_or(F.coalesce(a, F.lit(False))).alias("a"), F.bool_or(F.coalesce(b, F.lit(False))).alias("b"))
    return one.groupBy(*keys).agg(F.count_if("a").alias("n_a"), F.count_if("b").alias("n_b"), F.count_if(F.col("a") & F.col("b")).alias("n_both"), F.count_if(F.col("a") | F.col("b")).alias("n_either"))
