"""Statistics in closed form: tests, ranks, regressions, calibration, bootstrap."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceforge.functions import tails


def t_statistic(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """Welch's t and its degrees of freedom for group true against false; t is null without spread."""
    part = lambda f, g: f(F.when(F.col(group) == g, F.col(value)))
    d = df.groupBy(*keys).agg(*(part(f, g).alias(f"{n}{i}") for i, g in ((1, True), (0, False)) for f, n in ((F.avg, "m"), (F.var_samp, "v"), (F.count, "n"))))
    e1, e0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    df_ = (e1 + e0) ** 2 / (e1**2 / (F.col("n1") - 1) + e0**2 / (F.col("n0") - 1))
    ok = (F.col("n1") > 1) & (F.col("n0") > 1) & (e1 + e0 > 0)
    return d.where(ok).select(*keys, F.round((F.col("m1") - F.col("m0")) / F.sqrt(e1 + e0), 6).alias("t"), F.round(df_, 4).alias("dof"), "n1", "n0")


def average_rank(value: str | Column, *keys: str) -> Column:
    """Rank with ties at their mean."""
    v = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(v)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, v)) - 1) / 2.0


def mann_whitney(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """U of group true: sum of its average ranks less n (n + 1) / 2."""
    d = df.withColumn("r", average_rank(value, *keys)).groupBy(*keys).agg(F.sum(F.when(F.col(group), F.col("r"))).alias("s"), F.count_if(F.col(group)).alias("n1"), F.count_if(~F.col(group)).alias("n0"))
    return d.where("n1 > 0 and n0 > 0").select(*keys, (F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"), "n1", "n0")


def wilcoxon(df: DataFrame, keys: list[str], diff: str) -> DataFrame:
    """Signed-rank sums over non-zero differences."""
    d = df.where(F.col(diff) != 0).withColumn("a", F.abs(F.col(diff)))
    d = d.withColumn("r", average_rank("a", *keys))
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("r"))), F.lit(0.0))
    return d.groupBy(*keys).agg(side(F.col(diff) > 0).alias("w_plus"), side(F.col(diff) < 0).alias("w_minus"), F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    d = df.withColumn("rx", average_rank(x, *keys)).withColumn("ry", average_rank(y, *keys))
    return d.groupBy(*keys).agg(F.round(F.corr("rx", "ry"), 6).alias("rho"), F.count(F.lit(1)).alias("n"))


def chi_square(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Yates-corrected chi-square of a 2 x 2 table."""
    c = lambda x, y: F.count_if((F.col(a) == x) & (F.col(b) == y)).cast("double")
    d = df.groupBy(*keys).agg(c(True, True).alias("p"), c(True, False).alias("q"), c(False, True).alias("r"), c(False, False).alias("s"))
    n = F.col("p") + F.col("q") + F.col("r") + F.col("s")
    margin = (F.col("p") + F.col("q")) * (F.col("r") + F.col("s")) * (F.col("p") + F.col("r")) * (F.col("q") + F.col("s"))
    top = F.greatest(F.abs(F.col("p") * F.col("s") - F.col("q") * F.col("r")) - n / 2, F.lit(0.0))
    return d.where(margin > 0).select(*keys, F.round(n * top**2 / margin, 6).alias("chi2"))


def welch_test(df: DataFrame, keys: list[str], value: str, group: str, tests: int = 1) -> DataFrame:
    """``t_statistic`` with its two-sided p, and p for the number of tests that were made (Bonferroni)."""
    p = tails.t_two_sided(F.col("t"), F.col("dof"))
    return t_statistic(df, keys, value, group).withColumns({"p": p, "p_adjusted": tails.bonferroni(p, tests)})


def tie_sums(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum of t^3 - t over groups of t equal values."""
    n = F.count(F.lit(1)).cast("double")
    return df.groupBy(*keys, value).agg((n * n * n - n).alias("t")).groupBy(*keys).agg(F.sum("t").alias("ties"))


def mann_whitney_test(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """``mann_whitney`` with its two-sided p by the normal approximation, corrected for ties and continuity; null where all values tie."""
    d = mann_whitney(df, keys, value, group).join(tie_sums(df.where(F.col(group).isNotNull() & F.col(value).isNotNull()), keys, value), keys)
    n = F.col("n1") + F.col("n0")
    spread = F.sqrt(F.col("n1") * F.col("n0") / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1))))
    apart = F.greatest(F.abs(F.col("u") - F.col("n1") * F.col("n0") / 2.0) - 0.5, F.lit(0.0))
    return d.withColumn("p", F.when(spread > 0, tails.normal_two_sided(apart / spread))).drop("ties")


def wilcoxon_test(df: DataFrame, keys: list[str], diff: str) -> DataFrame:
    """``wilcoxon`` with its two-sided p by the normal approximation, corrected for ties."""
    sizes = df.where(F.col(diff) != 0).withColumn("__a", F.abs(F.col(diff)))
    d = wilcoxon(df, keys, diff).join(tie_sums(sizes, keys, "__a"), keys)
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0)
    z = (F.least("w_plus", "w_minus") - n * (n + 1) / 4.0) / spread
    return d.withColumn("p", F.when(spread > 0, tails.normal_two_sided(z))).drop("ties")


def success_test(df: DataFrame, keys: list[str], success: str, chance: float = 0.5, confidence: float = 0.95) -> DataFrame:
    """Successes of each group: n, k, rate, the exact two-sided binomial p against ``chance``, and the exact interval of the rate."""
    d = df.where(F.col(success).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(success)).alias("k"))
    d = d.repartition(4 * d.sparkSession.sparkContext.defaultParallelism)  # a few bytes a group, but long searches for its interval
    low, high = tails.binomial_interval(F.col("k"), F.col("n"), confidence)
    return d.withColumns({"rate": F.col("k") / F.col("n"), "p": tails.binomial_two_sided(F.col("k"), F.col("n"), chance), "low": low, "high": high})


def calibration(df: DataFrame, score: str, outcome: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("bigint")
    return df.groupBy(b.alias("bin")).agg(F.round(F.avg(score), 6).alias("mean_score"), F.round(F.avg(outcome), 6).alias("rate"), F.count(F.lit(1)).alias("n"))


def scores(df: DataFrame, keys: list[str], score: str, outcome: str) -> DataFrame:
    """Brier score and ROC area (by ranks) of 0/1 outcomes."""
    d = df.withColumn("r", average_rank(score, *keys))
    d = d.groupBy(*keys).agg(F.avg(F.pow(F.col(score) - F.col(outcome), 2)).alias("brier"), F.sum(F.col("r") * F.col(outcome)).alias("s"), F.sum(outcome).alias("n1"), F.count(F.lit(1)).alias("n"))
    area = (F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2) / F.nullif(F.col("n1") * (F.col("n") - F.col("n1")), F.lit(0))
    return d.select(*keys, F.round("brier", 6).alias("brier"), F.round(area, 6).alias("auc"))


def two_regressors(df: DataFrame, keys: list[str], y: str, a: str, b: str) -> DataFrame:
    """Least squares of y on a and b with intercept, from centred sums: coefficients and R2; no row where they are collinear."""
    sxy = lambda u, v: F.covar_pop(u, v)
    d = df.groupBy(*keys).agg(sxy(a, a).alias("aa"), sxy(b, b).alias("bb"), sxy(a, b).alias("ab"), sxy(a, y).alias("ay"), sxy(b, y).alias("by"), F.var_pop(y).alias("yy"), F.count(F.lit(1)).alias("n"))
    det = F.col("aa") * F.col("bb") - F.col("ab") ** 2
    ka = (F.col("ay") * F.col("bb") - F.col("by") * F.col("ab")) / det
    kb = (F.col("by") * F.col("aa") - F.col("ay") * F.col("ab")) / det
    return d.where((det > 1e-9) & (F.col("yy") > 0)).select(*keys, F.round(ka, 6).alias("coef_a"), F.round(kb, 6).alias("coef_b"), F.round((ka * F.col("ay") + kb * F.col("by")) / F.col("yy"), 6).alias("r2"), "n")


@lru_cache(maxsize=256)
def median_places(n: int, resamples: int, seed: int) -> np.ndarray:
    """The two places (one twice, for odd n) among n sorted values whose mean is each resample's median; they don't depend on the values."""
    rng, middle = np.random.default_rng(seed), ((n - 1) // 2, n // 2)
    return np.array([np.partition(rng.integers(0, n, n), middle)[list(middle)] for _ in range(resamples)]).T


def bootstrap_median(df: DataFrame, keys: list[str], value: str, resamples: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Median with a percentile bootstrap interval per group; the same seed for every group, groups of under 2 values left out.

    Groups of one size draw the same places, so a worker draws once for each size it meets.
    """
    kinds = dict(df.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[value].to_numpy(float)
        x = np.sort(x[np.isfinite(x)])
        if len(x) < 2:
            return pd.DataFrame(columns=[*keys, "median", "low", "high", "n"])
        left, right = median_places(len(x), resamples, seed)
        low, high = np.quantile((x[left] + x[right]) / 2, [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame([[*pdf[keys].iloc[0], float(np.median(x)), float(low), float(high), len(x)]], columns=[*keys, "median", "low", "high", "n"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return df.select(*keys, value).groupBy(*keys).applyInPandas(one, f"{schema}, median double, low double, high double, n bigint")


def title_odds(results: DataFrame, sims: int = 2000, seed: int = 7) -> DataFrame:
    """Season simulation: every driver's points of each round are redrawn from their own rounds; share of titles won.

    Simulations are rows of a range dealt over the cluster; each draws with its own seed, so
    a repeated task gives the same numbers. Only per-season lists of points travel with them.
    """
    hist = results.groupBy("season", "driver").agg(F.array_sort(F.collect_list("points")).alias("p"))
    sim = results.sparkSession.range(0, sims, 1, 16).withColumnRenamed("id", "sim")
    seasons = results.select("season").distinct()
    table = hist.groupBy("season").agg(F.array_sort(F.collect_list(F.struct("driver", "p"))).alias("d"))
    rows = sim.join(seasons, F.lit(True)).join(table, "season")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                rng = np.random.default_rng([seed, int(r.sim), int(r.season)])
                total = [int(np.asarray(d["p"])[rng.integers(0, len(d["p"]), len(d["p"]))].sum()) for d in r.d]
                out.append((r.season, r.d[int(np.argmax(total))]["driver"]))
            yield pd.DataFrame(out, columns=["season", "driver"])

    won = rows.mapInPandas(run, "season bigint, driver bigint")
    return won.groupBy("season", "driver").agg((F.count(F.lit(1)) / sims).alias("title_share"))
