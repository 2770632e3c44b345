"""Statistical functions Spark has no built-in for, as native column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int) -> Column:
    """Round half up in plain double arithmetic, so that every engine breaks exact ties alike. NaN and infinities stay: they are no whole numbers."""
    scale = float(10 ** digits)
    return F.when(F.isnan(x) | (F.abs(x) == math.inf), x.cast("double")).otherwise(F.floor(x * scale + 0.5) / scale)


def divide(x: Column, y: Column) -> Column:
    """x / y of doubles; by zero it is infinite, or NaN for NaN and zero, where ``/`` fails. Null if a side is."""
    by_zero = F.when(F.isnan(x) | (x == 0), F.lit(math.nan)).when(x.isNotNull(), F.signum(x) * math.inf)
    return F.when(y == 0, by_zero).otherwise(x / y)


def _pairs(x: Column, y: Column) -> tuple[Column, Column]:
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def _constant(x: Column) -> Column:
    """By extremes: a variance put together from partial means can miss zero by an error of rounding."""
    return F.min(x) == F.max(x)


def correlation(x: Column, y: Column) -> Column:
    """Correlation of the pairs without nulls: NaN where a side is constant, which ``corr`` fails on or answers with noise; null without pairs."""
    x, y = _pairs(x, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(_constant(x) | _constant(y), F.lit(float("nan"))).otherwise(F.try_divide(F.covar_pop(x, y), spread))


def slope(y: Column, x: Column) -> Column:
    """Slope of the pairs without nulls on ``x``: NaN where ``x`` is constant, null without pairs."""
    x, y = _pairs(x, y)
    return F.when(_constant(x), F.lit(float("nan"))).otherwise(F.regr_slope(y, x))


def x_log_y(x: Column, y: Column) -> Column:
    """x * ln(y) with 0 * ln(0) = 0 (F2)."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.ln(y))


def chi2_upper_2(x: Column) -> Column:
    """Upper tail of chi-square with two degrees of freedom."""
    return F.exp(-x / 2)


def chi2_upper_1(x: Column, terms: int = 340) -> Column:
    """Upper tail of chi-square with one degree of freedom.

    1 - erf(z) with z = sqrt(x / 2), by the all-positive series
    erf(z) = 2 z exp(-z^2) / sqrt(pi) * (1 + 2z^2/3 + (2z^2)^2/(3*5) + ...).
    The number of terms covers x up to 70; beyond it the tail is below 1e-16.
    """
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda acc, n: F.struct(
            (acc["term"] * x / (2 * n + 1)).alias("term"),
            (acc["total"] + acc["term"] * x / (2 * n + 1)).alias("total")),
        lambda acc: acc["total"])
    erf = F.sqrt(x / 2) * (2 / math.sqrt(math.pi)) * F.exp(-x / 2) * series
    return (F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double"))
            .when(x <= 0, F.lit(1.0))
            .when(x > 70, F.lit(0.0))
            .otherwise(F.greatest(F.lit(1.0) - erf, F.lit(0.0))))


def binomial_cdf(x: Column, n: Column, p: float) -> Column:
    """P(X <= x) for X ~ Binomial(n, p), terms built by their log ratio."""
    log_odds = math.log(p) - math.log1p(-p)
    start = n * math.log1p(-p)
    walk = F.aggregate(
        F.when(x >= 1, F.sequence(F.lit(1), F.least(x, n).cast("int"))).otherwise(F.array().cast("array<int>")),
        F.struct(start.cast("double").alias("lp"), F.exp(start).alias("cdf")),
        lambda acc, k: F.struct(
            (acc["lp"] + F.ln((n - k + 1) / k) + log_odds).alias("lp"),
            (acc["cdf"] + F.exp(acc["lp"] + F.ln((n - k + 1) / k) + log_odds)).alias("cdf")),
        lambda acc: acc["cdf"])
    return F.when(x < 0, F.lit(0.0)).otherwise(F.least(walk, F.lit(1.0)))


def fisher_bound(r: Column, n: Column, z: float) -> Column:
    """One end of the Fisher interval of a correlation; the sign of ``z`` picks the end (F6). Of three pairs it is open to -1 or 1."""
    return F.tanh(F.atanh(r) + divide(F.lit(float(z)), F.sqrt(n - 3)))


def whole_sum(x: Column) -> Column:
    """Sum that is null as soon as one value is: a book with an unpriced position has no value, not a smaller one."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))
