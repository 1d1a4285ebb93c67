"""Rolling features that need numpy, all computed in one pass over each series, for all windows of a length at once.

A window with a missing value gives no result; results are filled forward, then back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import EVENTS, SeriesSpec, over_series

EPS = 1e-10
#: Values of windows that are held at once.
CELLS = 4_000_000


def hann(n: int) -> np.ndarray:
    return np.ones(1) if n == 1 else 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))


def spectrum(x: np.ndarray) -> np.ndarray:
    """For each row: summed magnitudes of the Hann-windowed spectrum between the mean and the Nyquist bin."""
    n = x.shape[1]
    if n < 2:
        return np.zeros(len(x))
    return np.abs(np.fft.fft(x * hann(n), axis=1)[:, 1 : n // 2]).sum(1)


def hurst(x: np.ndarray, min_lag: int = 2, max_lag: int = 20) -> np.ndarray:
    """For each row: the slope of the log rescaled range of lagged differences against log lag; 0.5 where it can't be told."""
    n, out = x.shape[1], np.full(len(x), 0.5)
    lags = np.arange(min_lag, min(max_lag, n // 2))
    if n < max_lag or not len(lags):
        return out
    ratio = np.empty((len(x), len(lags)))
    for j, lag in enumerate(lags):
        d = x[:, lag:] - x[:, :-lag]
        s = d.std(1)
        ratio[:, j] = np.where(s > 0, np.ptp(d, axis=1) / np.where(s > 0, s, 1), 0)
    with np.errstate(divide="ignore"):
        y = np.log(ratio)
    good = np.isfinite(y).all(1) & (x.std(1) > 0)
    good[good] = y[good].std(1) > 0
    c = np.log(lags) - np.log(lags).mean()
    out[good] = (y[good] * c).sum(1) / (c**2).sum()
    return out


def binned(x: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Each value's bin among equal ones between its row's least and greatest value, and the rows' bin widths; equal values lie in bins of a range of 1."""
    lo, hi = x.min(1, keepdims=True), x.max(1, keepdims=True)
    flat = lo == hi
    lo, hi = np.where(flat, lo - 0.5, lo), np.where(flat, hi + 0.5, hi)
    return np.minimum(np.floor((x - lo) / (hi - lo) * bins), bins - 1).astype(np.int64), (hi - lo)[:, 0] / bins


def entropy_rate(x: np.ndarray, lag: int = 1, bins: int = 10) -> np.ndarray:
    """For each row: -sum of j * log2(j / m): j the joint density of past and future, m the past's density laid along the future's axis."""
    rows, n = x.shape
    if n <= lag:
        return np.zeros(rows)
    (past, wide), (future, high) = binned(x[:, :-lag], bins), binned(x[:, lag:], bins)
    row, m = np.arange(rows)[:, None], n - lag
    joint = np.bincount(((row * bins + past) * bins + future).ravel(), minlength=rows * bins * bins).reshape(rows, bins, bins)
    marginal = np.bincount((row * bins + past).ravel(), minlength=rows * bins).reshape(rows, bins)
    j = joint / (m * wide * high)[:, None, None] + EPS
    p = marginal / (m * wide)[:, None] + EPS
    return -(j * np.log2(j / p[:, None, :])).sum((1, 2))


#: Kind: (function of the windows of one length, the fewest rows that give a result).
KINDS = {
    "fft": (spectrum, 1),
    "hurst": (hurst, 1),
    "entropy_rate": (entropy_rate, 2),
}


def over_windows(x: np.ndarray, window: int, kind: str, fill: bool = True) -> np.ndarray:
    """The feature of every trailing window, shorter ones at the start included, filled forward and back unless told not to."""
    f, least = KINDS[kind]
    out = np.full(len(x), np.nan)
    for n in range(least, min(window, len(x) + 1)):
        if not np.isnan(x[:n]).any():
            out[n - 1] = f(x[None, :n])[0]
    if len(x) >= window:
        views = sliding_window_view(x, window)
        good = ~np.isnan(views).any(1)
        for part in np.array_split(np.flatnonzero(good), 1 + int(good.sum()) * window // CELLS):  # copies of the windows, a few at a time
            if len(part):
                out[window - 1 + part] = f(views[part])
    return pd.Series(out).ffill().bfill().to_numpy() if fill else out


def heavy(df: DataFrame, kinds: list[str], window: int, spec: SeriesSpec = EVENTS, fill: bool = True, more: tuple[str, ...] = ()) -> DataFrame:
    """The key, order, value (and ``more``) columns of df with one column per kind; one shuffle by the key, one Arrow pass."""
    columns = [*spec.key, *spec.order, spec.value, *more]
    schema = df.select(*columns).withColumns({k: F.lit(0.0) for k in kinds}).schema

    def per_series(_: tuple, pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        x = pdf[spec.value].to_numpy(float, na_value=np.nan)
        return {k: over_windows(x, window, k, fill) for k in kinds}

    return over_series(df.select(*columns), schema, per_series, spec)
