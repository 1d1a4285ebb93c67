"""Kernel-weighted rolling features with fixed parameters.

The row j rows back has the weight 3 ** -((3 * j / window) ** gamma); the weights of a frame are divided by their sum plus
1e-8. Early rows weigh what there is (no padding); pad with windows.lookback_padded first for the padded variant.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import EVENTS, SeriesSpec, over_series

K, EPS = 3.0, 1e-8
#: Whole windows that a feature in numpy gets at once.
BLOCK = 8192


def kernel(distance: np.ndarray, gamma: float) -> np.ndarray:
    return K ** -((K * distance) ** gamma)


def weights(length: int, window: float, gamma: float) -> list[float]:
    """Of a frame's rows, the newest last."""
    return [K ** -((K * j / window) ** gamma) for j in range(length - 1, -1, -1)]


def _weighted(a: Column, w: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, w, f), F.lit(0.0), lambda s, t: s + t)


def moments(df: DataFrame, window: float, gamma: float = 3.0, lookback: int = 32, spec: SeriesSpec = EVENTS, prefix: str = "kern_") -> DataFrame:
    """df with the weighted mean, variance, skewness and (non-excess) kurtosis over the last ``lookback`` rows.

    Skewness and kurtosis are null where the variance is 0. A frame with a missing value gives null.
    """
    full = F.array(*[F.lit(v) for v in weights(lookback, window, gamma)])
    frame = spec.frame(lookback)
    staged = df.withColumn("_a", F.collect_list(F.col(spec.value).cast("double")).over(frame)).withColumn("_n", F.count(F.lit(1)).over(frame))
    raw = F.slice(full, F.lit(lookback + 1) - F.size("_a"), F.size("_a"))
    staged = staged.withColumn("_w", raw).withColumn("_sum", _weighted(F.col("_w"), F.col("_w"), lambda a, _: a))
    staged = staged.withColumn("_w", F.transform("_w", lambda v: v / (F.col("_sum") + EPS)))
    mean = _weighted(F.col("_a"), F.col("_w"), lambda a, w: a * w)
    # a single row is its own mean
    staged = staged.withColumn("_m", F.when(F.size("_a") == 1, F.element_at("_a", 1)).otherwise(mean))
    central = lambda p: _weighted(F.col("_a"), F.col("_w"), lambda a, w: F.pow(a - F.col("_m"), F.lit(float(p))) * w)
    staged = staged.withColumns({f"_m{p}": central(p) for p in (2, 3, 4)})
    whole = F.size("_a") == F.col("_n")
    out = {
        "avg": F.col("_m"), "var": F.col("_m2"),
        "skew": F.try_divide(F.col("_m3"), F.pow("_m2", F.lit(1.5))), "kurt": F.try_divide(F.col("_m4"), F.col("_m2") * F.col("_m2")),
    }
    return staged.select(*df.columns, *[F.when(whole, c).alias(prefix + k) for k, c in out.items()])


def ewma(df: DataFrame, alpha: float, spec: SeriesSpec = EVENTS, lookback: int | None = None) -> DataFrame:
    """df with ``ewma`` and ``ewma_slope``, its change from the row before (0 at first); ewma starts at the first value.

    The average is a weighted sum over the rows so far, whose weights below 1e-15 are left out: the frame is a fixed number of
    rows, so a series of any length takes bounded memory. Missing values count as 0.
    """
    n = lookback or max(2, math.ceil(-15 * math.log(10) / math.log1p(-alpha)) + 1) if 0 < alpha < 1 else 2
    frame = spec.frame(n)
    falling = F.array(*[F.lit((1 - alpha) ** j) for j in range(n - 1, -1, -1)])
    x = F.coalesce(F.col(spec.value).cast("double"), F.lit(0.0))
    staged = df.withColumns({"_a": F.collect_list(x).over(frame), "_i": F.row_number().over(spec.w)})
    w = F.slice(falling, F.lit(n + 1) - F.size("_a"), F.size("_a"))
    total = alpha * _weighted(F.col("_a"), w, lambda a, b: a * b)
    start = F.when(F.col("_i") <= n, (1 - alpha) * F.element_at("_a", 1) * F.element_at(w, 1)).otherwise(0.0)
    staged = staged.withColumn("ewma", total + start)
    slope = F.coalesce(F.col("ewma") - F.lag("ewma").over(spec.w), F.lit(0.0))
    return staged.withColumn("ewma_slope", slope).select(*df.columns, "ewma", "ewma_slope")


def rescaled_hurst(a: np.ndarray, gamma: float = 3.0, ranges: tuple[int, ...] = (16, 32, 64, 128)) -> np.ndarray | float:
    """For each row: the slope of log R/S against log range, with the ranges as kernel windows over the whole row."""
    n = a.shape[-1]
    if n < 2:
        return np.zeros(a.shape[:-1])[()]
    ratios = []
    for r in ranges:
        w = kernel(np.arange(n - 1, -1, -1) / r, gamma)
        w = w / (w.sum() + EPS)
        from_mean = a - (a * w).sum(-1, keepdims=True)
        ratios.append(np.ptp(np.cumsum(from_mean * w, -1), axis=-1) / ((from_mean**2 * w).sum(-1) + EPS))
    c = np.log(ranges) - np.log(ranges).mean()
    return np.tensordot(c, np.log(np.maximum(ratios, EPS)), 1) / (c**2).sum()


def dft_magnitude(a: np.ndarray, window: float, gamma: float, period: float, smoothness: float, min_period: float = 1.0) -> np.ndarray | float:
    """For each row: the magnitudes of the kernel-weighted spectrum, averaged with a Gaussian weight around the bin of the period."""
    n = a.shape[-1]
    if n <= 1:
        return np.zeros(a.shape[:-1])[()]
    w = kernel(np.arange(n - 1, -1, -1) / (window + EPS), gamma)
    size = np.abs(np.fft.rfft(a * w / (w.sum() + EPS)))
    at = 0.0 if period < min_period else n / (period + EPS)
    f = np.exp(-((np.arange(size.shape[-1]) - at) ** 2) / (2 * (smoothness**2 + EPS)))
    return (size * f).sum(-1) / (f.sum() + EPS)


def array_features(df: DataFrame, features: dict[str, Callable[[np.ndarray], np.ndarray]], lookback: int = 128, spec: SeriesSpec = EVENTS) -> DataFrame:
    """The key, order and value of df with one column per feature, a function of the last ``lookback`` values; all in one pass.

    A feature gets windows of one length, one a row: those at a series' start one by one, then the whole ones a few thousand at a time.
    """
    columns = [*spec.key, *spec.order, spec.value]
    schema = df.select(*columns).withColumns({k: F.lit(0.0) for k in features}).schema

    def per_series(_: tuple, pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        x = pdf[spec.value].to_numpy(float, na_value=np.nan)
        short = [x[None, : i + 1] for i in range(min(lookback - 1, len(x)))]
        whole = sliding_window_view(x, lookback) if len(x) >= lookback else np.empty((0, lookback))
        rest = [whole[i : i + BLOCK] for i in range(0, len(whole), BLOCK)]
        return {k: np.concatenate([np.reshape(f(a), -1) for a in (*short, *rest)]) for k, f in features.items()}

    return over_series(df.select(*columns), schema, per_series, spec)


@dataclass(frozen=True)
class Parameter:
    """A learnable parameter as it is scored: raw is mapped into (low, high) by a sigmoid."""

    low: float
    high: float
    raw: float = 0.0

    @property
    def value(self) -> float:
        return self.low + (self.high - self.low) / (1 + math.exp(-self.raw))


@dataclass(frozen=True)
class FeatureConfig:
    """One feature of the layer: kind is a moment (avg, var, skew, kurt), ewma, ewma_slope, hurst or dft."""

    name: str
    kind: str
    params: dict = field(default_factory=dict)

    def get(self, name: str) -> float:
        if name not in self.params:
            raise KeyError(name)
        p = self.params[name]
        return p.value if isinstance(p, Parameter) else p

    def __str__(self) -> str:
        return f"{self.name}: {self.kind}(" + ", ".join(f"{k}={self.get(k):g}" for k in self.params) + ")"


def feature_layer(df: DataFrame, configs: list[FeatureConfig], spec: SeriesSpec = EVENTS, lookback: int = 128, normalise: bool = True) -> DataFrame:
    """df followed by one column per configured feature, each with mean 0 and variance 1 over all rows if ``normalise``."""
    out, names = df, []
    for c in configs:
        if c.kind in ("avg", "var", "skew", "kurt"):
            made = moments(out, c.get("window_size"), c.params.get("gamma", 3.0) if not isinstance(c.params.get("gamma"), Parameter) else c.get("gamma"), lookback, spec, "_k_")
            out = made.withColumn(c.name, F.col(f"_k_{c.kind}")).drop("_k_avg", "_k_var", "_k_skew", "_k_kurt")
        elif c.kind in ("ewma", "ewma_slope"):
            made = ewma(out, c.get("alpha"), spec)
            out = made.withColumn("_v", F.col(c.kind)).drop("ewma", "ewma_slope").withColumnRenamed("_v", c.name)
        elif c.kind in ("hurst", "dft"):
            if c.kind == "hurst":
                f = lambda a: rescaled_hurst(a)
            else:
                args = (c.get("window_size"), c.get("gamma"), c.get("center_period"), c.get("frequency_smoothness"))
                f = lambda a, args=args: dft_magnitude(a, *args)
            made = array_features(out, {c.name: f}, lookback, spec)
            out = out.join(made.drop(spec.value), [*spec.key, *spec.order])
        else:
            raise ValueError(f"unknown feature: {c.kind}")
        names.append(c.name)
    return batch_norm(out, names) if normalise else out


def batch_norm(df: DataFrame, names: list[str], eps: float = 1e-5) -> DataFrame:
    """The columns less their mean over all rows, divided by the root of their population variance plus eps."""
    stats = df.agg(*[f(n).alias(f"_{k}_{n}") for n in names for k, f in (("m", F.avg), ("v", F.var_pop))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({n: (F.col(n) - F.col(f"_m_{n}")) / F.sqrt(F.col(f"_v_{n}") + eps) for n in names}).select(*df.columns)
