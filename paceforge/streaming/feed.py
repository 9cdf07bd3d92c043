"""Live timing: a text feed of laps, rolling pace in event time with late and repeated laps, and a snapshot sink that survives replays."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SESSION = ["season", "round", "session"]
FEED = "season int, round int, session string, driver bigint, lap_number bigint, compound string, tyre_life double, lap_time_s double, ts timestamp"
OUT = "season int, round int, session string, driver bigint, lap_number bigint, ts timestamp, compound string, tyre_life double, rolling_s double"
STATE = "times array<double>, done array<bigint>, at array<bigint>, laps array<bigint>, seconds array<double>, compounds array<string>, ages array<double>"
IDLE_MS = 2 * 3_600_000


def parse_feed(lines: DataFrame) -> DataFrame:
    """Laps of feed lines (``value``, one JSON object each); lines that don't parse or lack the session, driver, lap or time go."""
    d = lines.select(F.from_json("value", FEED, {"mode": "PERMISSIVE", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]"}).alias("lap")).select("lap.*")
    return d.dropna(subset=[*SESSION, "driver", "lap_number", "ts"])


def read_feed(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The feed as a stream: a collector adds text files to the folder, each is read once."""
    return parse_feed(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder))


def replay_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The same laps as a batch, by the same parser."""
    return parse_feed(spark.read.text(folder))


def _median(times: list[float]) -> float:
    return round(float(pd.Series(times).median()), 4)


def pace_snapshots(laps: DataFrame, delay: str = "60 seconds", size: int = 5, least: int = 3) -> DataFrame:
    """Rolling median pace of each driver over a stream of laps, in the order of their times.

    A lap waits in the driver's state until the watermark (the latest time of earlier batches less
    ``delay``) has passed it, so that laps that come out of order count in order; a lap that comes
    after the watermark has passed it is late and dropped. A lap number counts once, the earliest time
    of it. Laps without a lap time give no row and don't count. The state of a driver holds ``size`` times, the
    waiting laps and the numbers seen in the session, and goes two hours after the last lap.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, done, *waiting = (list(x) for x in state.get) if state.exists else ([], [], [], [], [], [], [])
        rows, now, out = list(zip(*waiting, strict=True)), state.getCurrentWatermarkMs(), []
        if not state.hasTimedOut:  # Spark drops what was late a batch ago; what has become late since goes here
            for pdf in frames:
                at = pdf["ts"].astype("datetime64[us]").astype("int64")
                rows += [(int(a), int(n), s, c, g) for a, n, s, c, g in zip(at, pdf["lap_number"], pdf["lap_time_s"], pdf["compound"], pdf["tyre_life"], strict=True) if int(a) // 1000 > now]
        rows.sort(key=lambda r: (r[0], r[1]))
        while rows and rows[0][0] // 1000 <= now:
            at, lap, seconds, compound, age = rows.pop(0)
            if lap in done or pd.isna(seconds):
                continue
            done.append(lap)
            times = [*times, float(seconds)][-size:]
            if len(times) >= least:
                out.append((*key, lap, pd.Timestamp(at, unit="us"), compound, None if pd.isna(age) else float(age), _median(times)))
        if state.hasTimedOut and not rows and not out:
            state.remove()
        else:
            cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], [], []]
            state.update((times, done, *cols))
            state.setTimeoutTimestamp(max(rows[0][0] // 1000, now + 1) if rows else now + IDLE_MS)
        yield pd.DataFrame(out, columns=[*SESSION, "driver", "lap_number", "ts", "compound", "tyre_life", "rolling_s"])

    return laps.withWatermark("ts", delay).groupBy(*SESSION, "driver").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def on_time(laps: DataFrame, keys: list[str], batch: str, ts: str, delay: int | float) -> DataFrame:
    """The laps that a feed read in numbered batches would not drop: later than the latest time of all earlier batches less ``delay``.

    One feed for each ``keys``; batches are folded to one row before the running maximum.
    """
    latest = laps.groupBy(*keys, batch).agg(F.max(ts).alias("latest"))
    w = Window.partitionBy(*keys).orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    marks = latest.select(*keys, batch, (F.max("latest").over(w) - delay).alias("mark"))
    return laps.join(marks, [*keys, batch]).where(F.col("mark").isNull() | (F.col(ts) > F.col("mark"))).drop("mark")


def batch_snapshots(laps: DataFrame, keys: list[str], ts: str, size: int = 5, least: int = 3) -> DataFrame:
    """The batch twin of ``pace_snapshots`` over laps that are on time: keys, driver, lap_number, ts, rolling_s."""
    known = laps.where(F.col("lap_time_s").isNotNull())
    first = known.groupBy(*keys, "driver", "lap_number").agg(F.min(F.struct(ts, "lap_time_s")).alias("s")).select(*keys, "driver", "lap_number", f"s.{ts}", "s.lap_time_s")
    w = Window.partitionBy(*keys, "driver").orderBy(ts, "lap_number").rowsBetween(1 - size, 0)
    last = first.withColumn("last", F.array_sort(F.collect_list("lap_time_s").over(w)))  # at most ``size`` values; a median takes no frame
    n = F.size("last")
    middle = (F.col("last")[F.floor((n - 1) / 2).cast("int")] + F.col("last")[F.floor(n / 2).cast("int")]) / 2
    return last.withColumns({"n": n, "rolling_s": F.round(middle, 4)}).where(F.col("n") >= least).select(*keys, "driver", "lap_number", ts, "rolling_s")


def write_snapshots(snapshots: DataFrame, root: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Start the sink: each batch is a folder of its own that a replay writes over, so a restart adds nothing twice."""

    def put(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(root)

    writer = snapshots.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(OUT + ", batch bigint").parquet(root)


def live_board(snapshots: DataFrame) -> DataFrame:
    """Each driver's latest snapshot in a session."""
    last = snapshots.groupBy(*SESSION, "driver").agg(F.max_by(F.struct("lap_number", "ts", "compound", "tyre_life", "rolling_s"), F.struct("ts", "lap_number")).alias("s"))
    return last.select(*SESSION, "driver", "s.*")
