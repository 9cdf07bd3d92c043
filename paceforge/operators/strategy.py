"""Strategy kernels: tyre models, stint arcs, undercut gains, safety-car chains, shortest strategies, traffic."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lap_cost(age: Column, base: str = "base", lin: str = "lin", quad: str = "quad") -> Column:
    """Lap time at a tyre age; age 1 is the base time."""
    return F.col(base) + F.col(lin) * (age - 1) + F.col(quad) * (age - 1) ** 2


def undercut_gains(slopes: DataFrame, max_laps: int = 10, penalties: tuple[float, ...] = (0.0, 0.5, 1.0)) -> DataFrame:
    """Gain of n laps on new tyres of one compound against a rival's old ones of another, for each n and warm-up penalty.

    ``slopes``: compound, slope (seconds a lap), few rows: every two compounds meet.
    """
    old, new = slopes.select(F.col("compound").alias("old"), F.col("slope").alias("so")), slopes.select(F.col("compound").alias("new"), F.col("slope").alias("sn"))
    grid = old.join(new, F.lit(True)).select("*", F.explode(F.sequence(F.lit(1), F.lit(max_laps))).alias("n_laps")).select("*", F.explode(F.array(*map(F.lit, penalties))).alias("penalty"))
    k = F.col("n_laps")
    # old tyres lose more each lap from now on, new ones from the second
    return grid.select("old", "new", k.cast("bigint").alias("n_laps"), "penalty", F.round(F.col("so") * k * (k + 1) / 2 - F.col("sn") * k * (k - 1) / 2 - F.col("penalty") + 1e-8, 6).alias("gain_s"))


def stint_arcs(tyres: DataFrame, n_laps: int, pit_loss: float, min_stint: int) -> DataFrame:
    """All stints a race can hold: compound, first and last lap, cost with the stop before it.

    tyres: compound, base, lin, quad, max_age. A stint has min_stint laps at least and leaves
    none or min_stint laps at least.
    """
    arcs = tyres.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_laps))).alias("first")).select("*", F.explode(F.sequence(F.col("first"), F.lit(n_laps))).alias("last"))
    size = F.col("last") - F.col("first") + 1
    rest = F.lit(n_laps) - F.col("last")
    before = F.col("first") - 1
    ok = (size >= min_stint) & (size <= F.col("max_age")) & ((rest == 0) | (rest >= min_stint)) & ((before == 0) | (before >= min_stint))
    total = F.col("base") * size + F.col("lin") * size * (size - 1) / 2 + F.col("quad") * (size - 1) * size * (2 * size - 1) / 6
    return arcs.where(ok).select("compound", "first", "last", F.round(total + F.when(F.col("first") > 1, pit_loss).otherwise(0.0), 6).alias("cost"))


def best_strategies(arcs: DataFrame, keys: list[str], n_laps: int, two_compounds: bool = True) -> DataFrame:
    """Cheapest chain of stints that covers the race, per scenario, by dynamic programming over laps and compounds used.

    One scenario has a few thousand arcs and is solved in one group; scenarios run side by side.
    """
    kinds = dict(arcs.dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf["compound"].unique())
        bit = {c: 1 << i for i, c in enumerate(names)}
        by_first: dict[int, list] = {}
        for r in pdf.sort_values(["compound", "first", "last"]).itertuples(index=False):
            by_first.setdefault(int(r.first), []).append((r.compound, int(r.last), float(r.cost)))
        best: list[dict[int, tuple[float, list]]] = [{} for _ in range(n_laps + 1)]
        best[0][0] = (0.0, [])
        for lap in range(n_laps):
            for mask, (cost, path) in best[lap].items():
                for compound, last, more in by_first.get(lap + 1, []):
                    m = mask | bit[compound]
                    if m not in best[last] or cost + more < best[last][m][0]:
                        best[last][m] = (cost + more, [*path, f"{compound}:{lap + 1}-{last}"])
        ends = [v for m, v in best[n_laps].items() if not two_compounds or m.bit_count() >= 2]
        cols = [*keys, "total_s", "stops", "plan"]
        if not ends:
            return pd.DataFrame(columns=cols)
        cost, path = min(ends, key=lambda v: v[0])
        return pd.DataFrame([[*pdf[keys].iloc[0], round(cost, 6), len(path) - 1, " ".join(path)]], columns=cols)

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return arcs.groupBy(*keys).applyInPandas(solve, f"{schema}, total_s double, stops bigint, plan string")


def strategy_laps(plan: DataFrame, pit_loss: float) -> DataFrame:
    """Lap times of a plan (strategy, compound, first, last, base, lin, quad); the stop falls on the first stint's last lap."""
    d = plan.select("strategy", "compound", "first", "last", "base", "lin", "quad", F.explode(F.sequence("first", "last")).alias("lap"), F.max("last").over(Window.partitionBy("strategy")).alias("n"))
    stop = F.when((F.col("lap") == F.col("last")) & (F.col("last") < F.col("n")), pit_loss).otherwise(0.0)
    return d.select("strategy", "lap", "compound", F.round(lap_cost(F.col("lap") - F.col("first") + 1) + stop, 6).alias("lap_time_s"))


def safety_car_rates(phases: DataFrame, laps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_laps, p_deploy, p_end of each session: deployments for each green lap, and ends for each lap under a safety car, 1 at most."""
    cars = phases.where("phase = 'safety car' and lap_start > 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.col("lap_end") - F.col("lap_start"), F.lit(0)) + 1).alias("under"))
    d = laps.groupBy(*keys).agg(F.max("lap_number").alias("n_laps")).join(cars, keys)
    green = F.greatest(F.col("n_laps") - F.col("under"), F.lit(1))
    return d.select(*keys, "n_laps", F.least(F.col("n") / green, F.lit(1.0)).alias("p_deploy"), F.least(F.col("n") / F.col("under"), F.lit(1.0)).alias("p_end"))


def safety_car_marginals(rates: DataFrame, keys: list[str]) -> DataFrame:
    """Chance that each lap runs under the safety car; a race starts green. The chain of two states in closed form."""
    both = F.col("p_deploy") + F.col("p_end")
    d = rates.where("p_deploy + p_end > 0").select(*keys, "p_deploy", "p_end", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_laps").cast("bigint"))).alias("lap"))
    return d.select(*keys, "lap", F.round(F.col("p_deploy") / both * (1 - F.pow(1 - both, F.col("lap") - 1)), 9).alias("q"))


def gap_evolution(laps: DataFrame, block_gap: float = 0.5) -> DataFrame:
    """Gap of a chaser over laps, as a fold: free laps add hero less rival, a blocked lap passes only if its draw allows.

    laps: grp, lap, delta (hero less rival seconds), passes boolean; a gap over 0 means behind.
    """
    rows = laps.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("lap", "delta", "passes"))).alias("l"), F.max("gap0").alias("gap0"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.element_at(acc, -1)
        free = gap + x["delta"]
        return F.concat(acc, F.array(F.when((gap > 0) & (free <= block_gap) & ~x["passes"], F.lit(block_gap)).otherwise(free)))

    out = rows.select("grp", F.posexplode(F.aggregate("l", F.array("gap0"), step)).alias("lap", "gap"))
    return out.select("grp", F.col("lap").cast("bigint").alias("lap"), F.round("gap", 6).alias("gap_s"))
