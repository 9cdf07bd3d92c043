"""Time-series operators: as-of joins, islands, zones, phases, interpolation, geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], on: str, values: list[str], forward: bool = False) -> DataFrame:
    """Latest right row at or before each left row (``forward``: the next at or after), in one shuffle.

    Both sides go through one window, right rows first at equal times, so the cost is a
    sort and not a join of all pairs. Left rows without a match keep nulls. The union is dealt as a whole: sides
    that were dealt by the keys before may have been joined into tasks in different ways, and must not meet task by task.
    """
    pack = F.struct(F.col(on).alias("at"), *(F.col(v) for v in values))
    cols = left.columns
    l = left.select(F.lit(1).alias("__side"), *cols, F.lit(None).cast(right.select(pack.alias("p")).schema["p"].dataType).alias("__r"))
    r = right.select(F.lit(0).alias("__side"), *(F.col(c) if c in (*keys, on) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols), pack.alias("__r"))
    order = [F.desc(on), "__side"] if forward else [F.asc(on), "__side"]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = l.unionByName(r).repartition(*keys).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return seen.select(*cols, F.col("__r.at").alias(f"matched_{on}"), *(F.col(f"__r.{v}").alias(v) for v in values))


def with_islands(df: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Numbers the runs of equal ``flag`` values."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.coalesce(F.lag(flag).over(w) != F.col(flag), F.lit(True)).cast("bigint")
    return df.withColumn("__change", change).withColumn("island", F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__change")


def active_zones(df: DataFrame, keys: list[str], flag: str, min_length: float) -> DataFrame:
    """Runs of true by distance: first to last true sample; shorter ones are dropped."""
    runs = with_islands(df, keys, "ord", flag).where(F.col(flag))
    z = runs.groupBy(*keys, "island").agg(F.min_by("distance_m", "ord").alias("start_m"), F.max_by("distance_m", "ord").alias("end_m"), F.count(F.lit(1)).alias("n"))
    return z.withColumn("length_m", F.col("end_m") - F.col("start_m")).where(F.col("length_m") >= min_length)


def braking_zones(tele: DataFrame, keys: list[str], min_length: float = 20.0) -> DataFrame:
    """Braking runs with speeds at their ends; v_min is the speed of the last sample."""
    runs = with_islands(tele, keys, "ord", "brake").where("brake")
    z = runs.groupBy(*keys, "island").agg(
        *(F.min_by(c, "ord").alias(f"{n}0") for c, n in (("distance_m", "d"), ("speed", "v"), ("t_s", "t"))),
        *(F.max_by(c, "ord").alias(f"{n}1") for c, n in (("distance_m", "d"), ("speed", "v"), ("t_s", "t"))),
    )
    z = z.where(F.col("d1") - F.col("d0") >= min_length)
    decel = (F.col("v0") - F.col("v1")) / 3.6 / F.greatest(F.col("t1") - F.col("t0"), F.lit(1e-3)) / 9.81
    return z.select(*keys, "island", F.round("d0", 2).alias("start_m"), F.round("d1", 2).alias("end_m"), F.round(F.col("d1") - F.col("d0"), 2).alias("length_m"), F.round("v0", 2).alias("v_start"), F.round("v1", 2).alias("v_min"), F.round(decel, 4).alias("decel_g"))


def status_intervals(log: DataFrame, key: str = "session") -> DataFrame:
    """Repeats merged; an interval ends where the next begins, the last stays open."""
    w = Window.partitionBy(key).orderBy("t_us")
    first = log.withColumn("before", F.lag("status").over(w)).where("before is null or before <> status").drop("before")
    return first.withColumn("end_us", F.lead("t_us").over(w)).withColumnRenamed("t_us", "start_us")


def status_phases(intervals: DataFrame, last: DataFrame, key: str = "session") -> DataFrame:
    """Labels, closed ends (by the session's last time) and durations."""
    names = F.create_map(*(F.lit(x) for p in (("1", "green"), ("2", "yellow"), ("4", "safety car"), ("5", "red"), ("6", "virtual safety car")) for x in p))
    end = F.coalesce("end_us", "last_us")
    d = intervals.join(last, key, "left")
    return d.select(key, F.coalesce(F.element_at(names, F.col("status")), F.col("status")).alias("phase"), "start_us", end.alias("end_us"), (end - F.col("start_us")).alias("duration_us"))


def zone_membership(points: DataFrame, zones: DataFrame, width: int = 100) -> DataFrame:
    """Points with whether any zone holds them, ends included.

    Points and zones meet in cells of ``width``: an equi join with a residual, not a
    comparison of all pairs.
    """
    cells = zones.select("key", "start_m", "end_m", F.explode(F.sequence(F.floor(F.col("start_m") / width), F.floor(F.col("end_m") / width))).alias("cell"))
    p = points.withColumn("cell", F.floor(F.col("pos") / width))
    hits = p.join(cells, ["key", "cell"]).where("pos between start_m and end_m").select("key", "id").distinct().withColumn("inside", F.lit(True))
    return points.join(hits, ["key", "id"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def lead_to_zone(points: DataFrame, zones: DataFrame, lap_length: str = "length") -> DataFrame:
    """Distance to the next zone start, over the line if need be. points: key, id, pos, length; zones: key, start_m."""
    starts = zones.select("key", F.col("start_m").alias("pos"))
    nxt = asof_join(points, starts.withColumn("start_m", F.col("pos")), ["key"], "pos", ["start_m"], forward=True)
    first = zones.groupBy("key").agg(F.min("start_m").alias("first_m"))
    out = nxt.join(first, "key", "left")
    return out.select("key", "id", F.round(F.coalesce(F.col("start_m"), F.col("first_m") + F.col(lap_length)) - F.col("pos"), 4).alias("lead_m"))


def match_by_distance(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """Each a (in order of i) takes its nearest b if within tolerance and not yet taken; it never tries another.

    As no second choice is made, the first i of each b is the whole answer. a: grp, i, pos; b: grp, j, pos.
    The nearest b is the nearer of the as-of matches on both sides.
    """
    # of b's at one place only the first can be a nearest one
    right = b.groupBy("grp", "pos").agg(F.min("j").alias("j")).withColumn("b_pos", F.col("pos"))
    found = F.when(F.col("j").isNotNull(), F.struct(F.abs(F.col("pos") - F.col("b_pos")).alias("d"), "j"))
    down = asof_join(a.select("grp", "i", "pos"), right, ["grp"], "pos", ["j", "b_pos"]).select("grp", "i", "pos", found.alias("down"))
    both = asof_join(down, right, ["grp"], "pos", ["j", "b_pos"], forward=True).select("grp", "i", F.least("down", found).alias("x"))
    near = both.where("x is not null").groupBy("grp", "i").agg(F.min("x").alias("x")).where(F.col("x.d") <= tolerance)
    w = Window.partitionBy("grp", "x.j").orderBy("i")
    return near.withColumn("k", F.row_number().over(w)).where("k = 1").select("grp", "i", "x.j", F.round("x.d", 4).alias("distance"))


def interpolate(samples: DataFrame, grid: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Linear interpolation of y at the grid's x, clamped to the ends; x of samples is unique within a key."""
    s = samples.select(*keys, x, y)
    back = asof_join(grid, s.withColumn("xa", F.col(x)), keys, x, ["xa", y]).withColumnRenamed(y, "ya").drop(f"matched_{x}")
    both = asof_join(back, s.withColumn("xb", F.col(x)), keys, x, ["xb", y], forward=True).withColumnRenamed(y, "yb").drop(f"matched_{x}")
    part = (F.col(x) - F.col("xa")) / F.nullif(F.col("xb") - F.col("xa"), F.lit(0.0))
    return both.withColumn(y, F.coalesce(F.col("ya") + part * (F.col("yb") - F.col("ya")), "ya", "yb")).drop("xa", "xb", "ya", "yb")


def with_stretch(tele: DataFrame) -> DataFrame:
    """Adds where the driver's lap starts (lo) and the length that all drivers of the lap cover (len); laps of one driver have no row."""
    top = tele.groupBy("lap_number", "driver").agg(F.min("distance_m").alias("lo"), F.max("distance_m").alias("hi")).where("hi > lo")
    common = top.groupBy("lap_number").agg(F.min(F.col("hi") - F.col("lo")).alias("len"), F.countDistinct("driver").alias("n_drivers")).where("n_drivers >= 2 and len > 0")
    w = Window.partitionBy("lap_number", "driver")
    own = tele.withColumns({"lo": F.min("distance_m").over(w), "hi": F.max("distance_m").over(w)}).where("hi > lo")
    return own.join(F.broadcast(common.select("lap_number", "len")), "lap_number").drop("hi")  # a number for each lap


def mini_sectors(tele: DataFrame, n: int = 25) -> DataFrame:
    """Fastest driver through each of n equal stretches of the distance that all drivers of a lap cover; who covers none is left out.

    The times at the n + 1 edges are interpolated between the two samples around each; every edge is made
    from the one sample at or before it, so that samples stay in the task of their driver.
    """
    at = with_stretch(tele.groupBy("lap_number", "driver", "distance_m").agg(F.min("t_s").alias("t_s")))
    w = Window.partitionBy("lap_number", "driver").orderBy("distance_m")
    at = at.withColumns({"to_m": F.lead("distance_m").over(w), "to_s": F.lead("t_s").over(w)})
    place = lambda c: F.floor((F.col(c) - F.col("lo")) / F.col("len") * n)
    # an edge more on either side, for rounding
    at = at.withColumns({"low": F.greatest(place("distance_m") - 1, F.lit(0)), "high": F.coalesce(F.least(place("to_m") + 1, F.lit(n)), F.lit(n))}).where("low <= high")
    at = at.withColumn("edge", F.explode(F.sequence("low", "high"))).withColumn("x", F.col("lo") + F.col("len") * F.col("edge") / n)
    at = at.where("x >= distance_m and (to_m is null or x < to_m)")
    passed = F.col("t_s") + (F.col("x") - F.col("distance_m")) / (F.col("to_m") - F.col("distance_m")) * (F.col("to_s") - F.col("t_s"))
    at = at.select("lap_number", "driver", F.col("edge").cast("int").alias("edge"), F.coalesce(passed, "t_s").alias("t_s"))
    d = at.withColumn("dt", F.round(F.col("t_s") - F.lag("t_s").over(Window.partitionBy("lap_number", "driver").orderBy("edge")), 3)).where("edge > 0")
    return d.groupBy("lap_number", "edge").agg(F.min_by("driver", F.struct("dt", "driver")).alias("winner"), F.min("dt").alias("best_s"))


def segment_sectors(tele: DataFrame, n: int = 25) -> DataFrame:
    """The mini sector (edge 1 to n) of every stretch between two samples of a lap, by its middle: lap_number, driver, ord, x, y, to_x, to_y, edge.

    Middles past the common length belong to the last sector. A lap's last sample starts no stretch.
    """
    w = Window.partitionBy("lap_number", "driver").orderBy("ord")
    nxt = lambda c: F.lead(c).over(w)
    d = with_stretch(tele).withColumns({"to_x": nxt("x"), "to_y": nxt("y"), "middle": (F.col("distance_m") + nxt("distance_m")) / 2}).where("middle is not null")
    edge = F.floor((F.col("middle") - F.col("lo")) / F.col("len") * n) + 1
    return d.select("lap_number", "driver", "ord", "x", "y", "to_x", "to_y", F.greatest(F.lit(1), F.least(F.lit(n), edge)).cast("bigint").alias("edge"))


def track_winners(tele: DataFrame, n: int = 25) -> DataFrame:
    """The same with the fastest driver of the sector: the track map of a lap in its winners' colours, drawn along any of its drivers."""
    fastest = mini_sectors(tele, n).select("lap_number", F.col("edge").cast("bigint").alias("edge"), "winner")
    return segment_sectors(tele, n).join(F.broadcast(fastest), ["lap_number", "edge"])  # n rows for each lap


def path_length(points: DataFrame, keys: list[str], closed: bool = True) -> DataFrame:
    """Length of a polyline in order of ord; closed adds the way back to the first point."""
    w = Window.partitionBy(*keys).orderBy("ord")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    d = points.where("x is not null and y is not null").withColumn("step", step)
    out = d.groupBy(*keys).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("open"), F.hypot(F.max_by("x", "ord") - F.min_by("x", "ord"), F.max_by("y", "ord") - F.min_by("y", "ord")).alias("back"))
    return out.select(*keys, F.round(F.col("open") + (F.col("back") if closed else 0), 3).alias("length"))


def elevation(points: DataFrame, keys: list[str], min_step: float = 1.0) -> DataFrame:
    """Climb and drop of a height profile, changes under ``min_step`` ignored: a fold with direction, pivot and peak.

    A leg is booked when the height turns by at least ``min_step`` from its peak; the last leg
    is booked at the end. The span is that of the raw heights. A profile is one array in one
    task, as each step depends on the one before: a lap's samples, not a table's.
    """
    rows = points.where("z is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", F.col("z").cast("double").alias("z")))).alias("p"), F.max("z").alias("hi"), F.min("z").alias("lo"))
    zero = F.struct(F.lit(0).alias("dir"), F.lit(None).cast("double").alias("pivot"), F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("gain"), F.lit(0.0).alias("loss"))

    def step(s: Column, p: Column) -> Column:
        z = p["z"]
        make = lambda d, pivot, peak, gain, loss: F.struct(d.cast("int").alias("dir"), pivot.alias("pivot"), peak.alias("peak"), gain.alias("gain"), loss.alias("loss"))
        first = make(F.lit(0), z, z, s["gain"], s["loss"])
        up, down = z - s["pivot"] >= min_step, s["pivot"] - z >= min_step
        idle = F.when(up, make(F.lit(1), s["pivot"], z, s["gain"], s["loss"])).when(down, make(F.lit(-1), s["pivot"], z, s["gain"], s["loss"])).otherwise(s)
        rising = F.when(z > s["peak"], make(F.lit(1), s["pivot"], z, s["gain"], s["loss"])).when(s["peak"] - z >= min_step, make(F.lit(-1), s["peak"], z, s["gain"] + s["peak"] - s["pivot"], s["loss"])).otherwise(s)
        falling = F.when(z < s["peak"], make(F.lit(-1), s["pivot"], z, s["gain"], s["loss"])).when(z - s["peak"] >= min_step, make(F.lit(1), s["peak"], z, s["gain"], s["loss"] + s["pivot"] - s["peak"])).otherwise(s)
        return F.when(s["pivot"].isNull(), first).when(s["dir"] == 0, idle).when(s["dir"] == 1, rising).otherwise(falling)

    s = F.aggregate("p", zero, step)
    out = rows.select(*keys, s.alias("s"), (F.col("hi") - F.col("lo")).alias("span"))
    gain = F.col("s.gain") + F.when(F.col("s.dir") == 1, F.col("s.peak") - F.col("s.pivot")).otherwise(0)
    loss = F.col("s.loss") + F.when(F.col("s.dir") == -1, F.col("s.pivot") - F.col("s.peak")).otherwise(0)
    return out.select(*keys, F.round(gain, 1).alias("gain_m"), F.round(loss, 1).alias("loss_m"), F.round("span", 1).alias("span_m"))


def drs_state(code: str = "drs") -> Column:
    return F.when(F.col(code).isin(10, 12, 14), 2).when(F.col(code) == 8, 1).otherwise(0)


def drs_usage(tele: DataFrame) -> DataFrame:
    """Time with the flap open, its share, and top speeds open and closed."""
    w = Window.partitionBy("driver").orderBy("t_us")
    d = tele.withColumn("dt", F.coalesce(F.col("t_us") - F.lag("t_us").over(w), F.lit(0))).withColumn("open", drs_state() == 2)
    top = lambda c: F.max(F.when(c, F.col("speed")))
    return d.groupBy("driver").agg(F.sum(F.when(F.col("open"), F.col("dt")).otherwise(0)).alias("open_us"), F.sum("dt").alias("all_us"), top(F.col("open")).alias("v_open"), top(~F.col("open")).alias("v_closed")).select(
        "driver", "open_us", F.round(F.col("open_us") / F.col("all_us"), 4).alias("share"), "v_open", "v_closed", F.round(F.col("v_open") - F.col("v_closed"), 4).alias("gain")
    )


def downsample(df: DataFrame, keys: list[str], order: str, points: int) -> DataFrame:
    """Every k-th row, so that about ``points`` are left."""
    w = Window.partitionBy(*keys)
    step = F.greatest(F.floor(F.count(F.lit(1)).over(w) / points), F.lit(1))
    return df.withColumn("__i", F.row_number().over(w.orderBy(order)) - 1).withColumn("__k", step).where("__i % __k = 0").drop("__i", "__k")


def style_features(tele: DataFrame) -> DataFrame:
    """Driving style from a driver's samples; the first sample counts as a gear change."""
    w = Window.partitionBy("driver").orderBy("ord")
    full = F.col("throttle") >= F.max("throttle").over(Window.partitionBy("driver")) - 2
    d = tele.withColumn("full", full).withColumn("dthr", F.abs(F.col("throttle") - F.lag("throttle").over(w))).withColumn("shift", F.coalesce(F.col("gear") != F.lag("gear").over(w), F.lit(True)))
    pct = lambda c: F.round(F.avg(c.cast("double")) * 100, 4)
    return d.groupBy("driver").agg(pct(F.col("full")).alias("full_pct"), pct(F.col("brake")).alias("brake_pct"), pct(~F.col("brake") & (F.col("throttle") < 5)).alias("coast_pct"), pct(F.col("brake") & (F.col("throttle") > 5)).alias("overlap_pct"), F.sum("dthr").alias("throttle_moves"), F.count_if("shift").alias("gear_changes"))


def lap_profile(tele: DataFrame, min_samples: int = 3) -> DataFrame:
    d = tele.groupBy("driver", "lap_number").agg(F.max("speed").alias("v_max"), F.round(F.avg("speed"), 4).alias("v_mean"), F.round(F.avg("throttle"), 4).alias("throttle"), F.round(F.avg(F.col("brake").cast("double")) * 100, 4).alias("brake_pct"), F.round(F.avg("gear"), 4).alias("gear"), F.count(F.lit(1)).alias("n"))
    return d.where(F.col("n") >= min_samples)


def source_quality(tele: DataFrame) -> DataFrame:
    share = lambda s: F.round(F.avg((F.col("source") == s).cast("double")), 4)
    return tele.groupBy("driver").agg(share("view").alias("car"), share("click").alias("pos"), share("error").alias("interpolation"))


def time_slice(samples: DataFrame, time: str, start: int, end: int) -> DataFrame:
    """Samples from ``start`` up to, but without, ``end`` after the first one of all."""
    first = samples.agg(F.min(time).alias("first"))
    offset = F.col(time) - first.scalar()
    return samples.where((offset >= start) & (offset < end))


def speed_profile(samples: DataFrame, keys: list[str], width_m: float) -> DataFrame:
    """Speed by stretch of equal length."""
    at = F.floor(F.col("distance_m") / F.lit(width_m)).cast("bigint")
    return samples.groupBy(*keys, at.alias("stretch")).agg(F.round(F.avg("speed"), 4).alias("v_mean"), F.min("speed").alias("v_min"), F.count(F.lit(1)).alias("n"))


def rotated(samples: DataFrame, degrees: float) -> DataFrame:
    """x and y turned about the origin."""
    c, s = F.cos(F.radians(F.lit(degrees))), F.sin(F.radians(F.lit(degrees)))
    return samples.withColumns({"x": F.col("x") * c - F.col("y") * s, "y": F.col("x") * s + F.col("y") * c})


def wet_sessions(weather: DataFrame, least: float = 0.2) -> DataFrame:
    """Sessions with the share of their samples in rain, wet from ``least`` on."""
    d = weather.groupBy("session").agg(F.avg(F.col("rainfall").cast("double")).alias("share"))
    return d.select("session", F.round("share", 4).alias("share"), (F.col("share") >= least).alias("wet"))
