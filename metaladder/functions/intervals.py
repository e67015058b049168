"""Score intervals for proportions and their differences, as Column expressions.

Counts of zero give nulls; the guard is needed because greatest() skips nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 95 % normal quantile, to the digits that results are compared at.
Z = 1.959964


def _n(n: Column) -> Column:
    return F.when(n > 0, n.cast("double"))


def rate(wins: Column, n: Column) -> Column:
    return wins / _n(n)


def wilson(wins: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Lower and upper bound of the score interval, clipped to [0, 1]."""
    m = _n(n)
    p = wins / m
    base = F.lit(1.0) + F.lit(z * z) / m
    centre = (p + F.lit(z * z) / (F.lit(2.0) * m)) / base
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / m + F.lit(z * z) / (F.lit(4.0) * m * m)) / base
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))


def newcombe(w1: Column, n1: Column, w2: Column, n2: Column, z: float = Z) -> tuple[Column, Column]:
    """Hybrid score interval of p1 - p2, not clipped."""
    p1, p2 = rate(w1, n1), rate(w2, n2)
    (l1, u1), (l2, u2) = wilson(w1, n1, z), wilson(w2, n2, z)
    d = p1 - p2
    square = lambda x: x * x
    return d - F.sqrt(square(p1 - l1) + square(u2 - p2)), d + F.sqrt(square(u1 - p1) + square(p2 - l2))


def widen(centre: Column, low: Column, high: Column, moved: Column, sd: Column, z: float = Z, clip: bool = True) -> tuple[Column, Column]:
    """The interval around ``moved``, each side widened by z * sd in quadrature."""
    extra = (F.lit(z) * sd) * (F.lit(z) * sd)
    lo = moved - F.sqrt((centre - low) * (centre - low) + extra)
    hi = moved + F.sqrt((high - centre) * (high - centre) + extra)
    if clip:
        inside = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
        lo, hi = inside(lo), inside(hi)
    return lo, hi


def with_interval(df: DataFrame, wins: str = "wins", n: str = "matches") -> DataFrame:
    """``df`` plus win_rate, ci_low, ci_high."""
    low, high = wilson(F.col(wins), F.col(n))
    return df.withColumns({"win_rate": rate(F.col(wins), F.col(n)), "ci_low": low, "ci_high": high})


def verdict(low: Column, high: Column, against: float = 0.5) -> Column:
    """``clear`` if the interval leaves ``against`` out, else ``lean``; null without an interval."""
    return F.when(low.isNull() | high.isNull(), F.lit(None).cast("string")).when((low > against) | (high < against), "clear").otherwise("lean")
