"""Tails of distributions as column expressions: whole-stage arithmetic and folds over short sequences, no Python rows.

Each takes and gives columns of doubles. Accuracy is about 1e-11 relative but where noted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _num(x: Column | float | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x > 0: Stirling's series at x + 10, and the ten factors in between taken off."""
    x = _num(x)
    z = x + 10
    between = sum((F.log(x + i) for i in range(1, 10)), F.log(x))
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - between


def normal_two_sided(z: Column) -> Column:
    """Chance that a standard normal value is at least as far from 0 as z: a power series near 0, a continued fraction beyond."""
    x = F.abs(_num(z)) / math.sqrt(2)
    start = F.struct(x.alias("term"), x.alias("total"))

    def more(acc: Column, k: Column) -> Column:
        term = -acc["term"] * x * x / k
        return F.struct(term.alias("term"), (acc["total"] + term / (2 * k + 1)).alias("total"))

    near = 1 - 2 / math.sqrt(math.pi) * F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, more)["total"]
    tail = F.aggregate(F.sequence(F.lit(60), F.lit(1)), F.lit(0.0), lambda acc, k: k / 2 / (x + acc))
    return F.when(x < 2, near).otherwise(F.exp(-x * x) / math.sqrt(math.pi) / (x + tail))


def _beta_fraction(x: Column, a: Column, b: Column) -> Column:
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x)) / a

    def step(acc: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(k % 2 == 0, even).otherwise(odd) / (1 + acc)

    terms = F.ceil(60 + 4 * F.sqrt(F.greatest(a, b))).cast("int")  # it converges in some sqrt(max(a, b)) steps
    return front / (1 + F.aggregate(F.sequence(terms, F.lit(1)), F.lit(0.0), step))


def beta_cdf(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function, by the continued fraction on the side where it converges fast."""
    x, a, b = _num(x), _num(a), _num(b)
    inner = F.when(x < (a + 1) / (a + b + 2), _beta_fraction(x, a, b)).otherwise(1 - _beta_fraction(1 - x, b, a))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inner)


def t_two_sided(t: Column, dof: Column) -> Column:
    """Two-sided p of Student's t."""
    t, dof = _num(t), _num(dof)
    return beta_cdf(dof / (dof + t * t), dof / 2, F.lit(0.5))


def binomial_log_pmf(k: Column, n: Column, p: float) -> Column:
    k, n = _num(k), _num(n)
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)


def binomial_two_sided(k: Column, n: Column, p: float = 0.5) -> Column:
    """Exact two-sided p of k successes in n: all outcomes no likelier than k, summed up; 0 < p < 1, null for n = 0."""
    mine = binomial_log_pmf(k, n, p)
    each = F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: binomial_log_pmf(i, n, p))
    total = F.aggregate(each, F.lit(0.0), lambda acc, v: acc + F.when(v <= mine + 1e-7, F.exp(v)).otherwise(0.0))
    return F.when(n > 0, F.least(total, F.lit(1.0)))


def binomial_interval(k: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Exact (Clopper-Pearson) interval of the share of successes, by 50 halvings of the beta function."""
    k, n, alpha = _num(k), _num(n), (1 - confidence) / 2

    def quantile(q: float, a: Column, b: Column) -> Column:
        halves = F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.pow(F.lit(0.5), i))
        return F.aggregate(halves, F.lit(0.0), lambda low, half: low + F.when(beta_cdf(low + half, a, b) < q, half).otherwise(0.0))

    low = F.when(k <= 0, 0.0).otherwise(quantile(alpha, F.greatest(k, F.lit(1.0)), n - k + 1))
    high = F.when(k >= n, 1.0).otherwise(quantile(1 - alpha, k + 1, F.greatest(n - k, F.lit(1.0))))
    return F.when(n > 0, low), F.when(n > 0, high)


def bonferroni(p: Column, tests: Column | int) -> Column:
    """p times the number of tests, 1 at most."""
    return F.least(p * tests, F.lit(1.0))
