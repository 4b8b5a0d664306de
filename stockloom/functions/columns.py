"""Column helpers: nulls for what is not finite, correlations that never divide by zero, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def correlation(x: str, y: str, over=None) -> Column:
    """Pearson correlation over a group or window; NULL where either side is constant."""
    part = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return F.try_divide(part(F.covar_pop(x, y)), F.sqrt(part(F.var_pop(x)) * part(F.var_pop(y))))


def weighted_covariance(x: str, y: str, n: str) -> Column:
    """Population covariance of a group whose rows stand for ``n`` equal rows each; values should lie about their means.

    The variance of a constant is exactly 0.
    """
    both = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(n))
    mean = lambda c: F.sum(c * both) / F.sum(both)
    value = mean(F.col(x) * F.col(y)) - mean(F.col(x)) * mean(F.col(y))
    return F.when(F.min(x) == F.max(x), value * 0.0).otherwise(F.greatest(value, F.lit(0.0))) if x == y else value


def weighted_correlation(x: str, y: str, n: str) -> Column:
    """Pearson correlation of such a group; NULL where either side is constant."""
    return F.try_divide(weighted_covariance(x, y, n), F.sqrt(weighted_covariance(x, x, n) * weighted_covariance(y, y, n)))


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)
