"""Tests on sufficient statistics as column expressions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(n: Column, total: Column) -> Column:
    return total / n


def sample_variance(n: Column, total: Column, squares: Column) -> Column:
    """From count, sum and sum of squares; at least 0."""
    return F.greatest((squares - total * total / n) / (n - 1), F.lit(0.0))


def standardized_increase(target: tuple[Column, Column, Column], reference: tuple[Column, Column, Column], margin: float = 0.0) -> Column:
    """Welch-type score of target mean over reference mean and margin; without spread, infinite if positive, else 0; null below two values."""
    gap = mean(*target[:2]) - mean(*reference[:2]) - margin
    error = F.sqrt(sample_variance(*target) / target[0] + sample_variance(*reference) / reference[0])
    flat = F.when(gap > 0, F.lit(float("inf"))).otherwise(0.0)
    return F.when((target[0] >= 2) & (reference[0] >= 2), F.when(error <= 1e-12, flat).otherwise(gap / error))


def upper_bound(n: Column, total: Column, squares: Column, confidence: float = 0.95) -> Column:
    """One-sided upper bound of the mean of paired differences."""
    z = NormalDist().inv_cdf(confidence)
    return mean(n, total) + z * F.sqrt(sample_variance(n, total, squares) / n)


def quantile(confidence: float) -> float:
    """The standard normal quantile, for thresholds."""
    return NormalDist().inv_cdf(confidence)


def log_sum_exp(xs: Column) -> Column:
    """Of an array of doubles."""
    top = F.array_max(xs)
    return top + F.ln(F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def softmax(xs: Column) -> Column:
    total = log_sum_exp(xs)
    return F.transform(xs, lambda x: F.exp(x - total))


def close(a: Column, b: Column) -> Column:
    """Equal but for rounding."""
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)
