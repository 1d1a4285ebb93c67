"""Forecast losses as aggregate expressions over a forecast p, a truth y and, where weighted, a place t of n."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fill import divide_or_zero


def linear_weights(t: Column, n: int) -> Column:
    """From 0.1 to 1 over n places."""
    return 0.1 + 0.9 * t / max(n - 1, 1)


def exponential_weights(t: Column, n: int) -> Column:
    """From 1 to e over n places."""
    return F.exp(t / max(n - 1, 1))


def first_exponential_weights(t: Column, n: int) -> Column:
    """1, then from 1 to e over the other places; 2.71 for a single place."""
    if n <= 1:
        return F.lit(2.71)
    return F.when(t == 0, 1.0).otherwise(F.exp((t - 1) / max(n - 2, 1)))


def weighted_mse(p: Column, y: Column, weight: Column) -> Column:
    return F.avg(weight * (p - y) * (p - y))


def mae(p: Column, y: Column) -> Column:
    return F.avg(F.abs(p - y))


def mape(p: Column, y: Column) -> Column:
    """In per cent; a zero truth adds nothing but counts in the mean."""
    return 100 * F.avg(divide_or_zero(F.abs(y - p), F.abs(y)))


def penalised_sign(p_scaled: Column, y_scaled: Column, p: Column, y: Column, factor: float = 10.0) -> Column:
    """Mean squared error of the scaled values, plus factor times the absolute error where the signs differ."""
    wrong = F.when(F.signum(p) != F.signum(y), F.abs(y - p)).otherwise(0.0)
    return F.avg((p_scaled - y_scaled) * (p_scaled - y_scaled)) + F.avg(factor * wrong)


def quantile(p: dict[float, Column], y: Column) -> Column:
    """Mean pinball loss over rows and quantiles; p has a forecast for each quantile."""
    if any(not 0 < q < 1 for q in p):
        raise ValueError("quantiles lie between 0 and 1")
    parts = [F.avg(F.when(y - f >= 0, q * (y - f)).otherwise((q - 1) * (y - f))) for q, f in p.items()]
    return sum(parts[1:], parts[0]) / len(parts)


def linear_weight_array(n: int) -> list[float]:
    return [0.1 + 0.9 * t / max(n - 1, 1) for t in range(n)]


def exponential_weight_array(n: int) -> list[float]:
    return [math.exp(t / max(n - 1, 1)) for t in range(n)]
