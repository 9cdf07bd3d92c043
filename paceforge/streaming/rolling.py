"""Rolling pace over a stream of laps: the live twin of the batch query."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState


def rolling_pace_stream(laps: DataFrame, size: int = 5, least: int = 3) -> DataFrame:
    """One row per arriving lap once a driver has ``least``: driver, lap_number, rolling_s.

    ``laps``: driver bigint, lap_number, lap_time_s. The state of a driver is the last
    ``size`` times. Laps of one batch are taken in order of their number; laps without a
    time are skipped.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).dropna(subset=["lap_time_s"]).sort_values("lap_number")
        out = []
        for lap, t in zip(rows["lap_number"], rows["lap_time_s"], strict=True):
            times = [*times, float(t)][-size:]
            if len(times) >= least:
                out.append((key[0], int(lap), round(float(pd.Series(times).median()), 4)))
        state.update((times,))
        yield pd.DataFrame(out, columns=["driver", "lap_number", "rolling_s"])

    return laps.groupBy("driver").applyInPandasWithState(update, "driver bigint, lap_number bigint, rolling_s double", "times array<double>", "append", "NoTimeout")
