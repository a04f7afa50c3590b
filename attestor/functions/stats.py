"""Exact statistics of pass counts and paired outcomes."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (modified Lentz); about sqrt(max(a, b)) steps."""
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    total = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return total


def beta_share(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function: the share of a beta distribution up to x."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def exact_p(gains: int, losses: int) -> float:
    """min(1, 2 * P(X <= the lesser count)) of a binomial with one half, in a number of steps that hardly grows with the counts."""
    n, least = gains + losses, min(gains, losses)
    return 1.0 if n == 2 * least else min(1.0, 2 * beta_share(n - least, least + 1, 0.5))


@F.pandas_udf(DoubleType())
def mcnemar(gains: pd.Series, losses: pd.Series) -> pd.Series:
    """Exact two-sided p of discordant pairs."""
    return pd.Series([exact_p(int(a), int(b)) if pd.notna(a) and pd.notna(b) else None for a, b in zip(gains, losses, strict=True)], dtype="float64")


def hoeffding(mean: Column, n: Column) -> tuple[Column, Column]:
    """95% interval of a mean of values in 0..1, clipped."""
    radius = F.sqrt(F.lit(math.log(40)) / (2 * F.nullif(n, F.lit(0))))
    return F.greatest(F.lit(0.0), mean - radius), F.least(F.lit(1.0), mean + radius)


def beta_quantile(share: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if beta_share(a, b, middle) < share else (low, middle)
    return (low + high) / 2


def binomial_interval(k: int, n: int, level: float = 0.95) -> tuple[float, float] | None:
    """Exact central interval for k passes of n; nothing for n = 0."""
    if not 0 <= k <= n:
        raise ValueError("passes must lie between 0 and the number of cases")
    if not n:
        return None
    alpha = (1 - level) / 2
    return 0.0 if k == 0 else beta_quantile(alpha, k, n - k + 1), 1.0 if k == n else beta_quantile(1 - alpha, k + 1, n - k)


@F.pandas_udf(StructType([StructField("low", DoubleType()), StructField("high", DoubleType())]))
def clopper_pearson(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    rows = [binomial_interval(int(a), int(b)) if pd.notna(a) and pd.notna(b) and b else (None, None) for a, b in zip(k, n, strict=True)]
    return pd.DataFrame(rows, columns=["low", "high"], dtype="float64")


def kappa(both: Column, only_a: Column, only_b: Column, neither: Column) -> Column:
    """Agreement beyond chance of two raters; nothing where chance alone agrees always."""
    n = (both + only_a + only_b + neither).cast("double")
    observed = (both + neither) / F.nullif(n, F.lit(0.0))
    chance = ((both + only_a) * (both + only_b) + (neither + only_a) * (neither + only_b)) / F.nullif(n * n, F.lit(0.0))
    return (observed - chance) / F.nullif(1 - chance, F.lit(0.0))


def paired_outcome(before_failed: Column, after_failed: Column, available: Column, deltas: Column, epsilon: float = 1e-12) -> Column:
    """What became of a case between two runs, from an array of differences (null where a side isn't scored).

    Failures come first: both-failed, failed, recovered; then unavailable (a run lacks the cutoff), not-scored (no
    difference is known), mixed (some higher, some lower), improved, worsened, unchanged.
    """
    known = F.filter(deltas, lambda d: d.isNotNull())
    higher, lower = F.exists(known, lambda d: d > epsilon), F.exists(known, lambda d: d < -epsilon)
    return (
        F.when(before_failed & after_failed, "both-failed").when(after_failed, "failed").when(before_failed, "recovered")
        .when(~available, "unavailable").when(F.size(known) == 0, "not-scored")
        .when(higher & lower, "mixed").when(higher, "improved").when(lower, "worsened").otherwise("unchanged")
    )
