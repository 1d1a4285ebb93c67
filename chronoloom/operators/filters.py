"""State-space filters as folds over each series, in numpy.

A recurrence needs the rows of a series in order, so a series is one task; only the columns it needs are shuffled. Random
filters are seeded by the seed and the key, so that reruns and retried tasks agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fill import first_valid
from .series import EVENTS, SeriesSpec, over_series


def fold(df: DataFrame, f: Callable[[np.ndarray, np.random.Generator], np.ndarray], out: str, spec: SeriesSpec = EVENTS, seed: int = 0) -> DataFrame:
    """df's key, order and value columns with f's estimate for each row of a series; f gets the values with NaN for null."""
    columns = [*spec.key, *spec.order, spec.value]
    schema = df.select(*columns).withColumn(out, F.lit(0.0)).schema

    def per_series(key: tuple, pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        rng = np.random.default_rng([seed, zlib.crc32(repr(tuple(map(str, key))).encode())])
        return {out: f(pdf[spec.value].to_numpy(float, na_value=np.nan), rng)}

    return over_series(df.select(*columns), schema, per_series, spec)


def first_value(z: np.ndarray) -> float:
    valid = z[~np.isnan(z)]
    return float(valid[0]) if len(valid) else 0.0


class Kalman:
    """The linear filter: predict() and update(z), each giving the state's first component."""

    def __init__(self, x0: np.ndarray, p0: np.ndarray, f: np.ndarray, q: np.ndarray, h: np.ndarray, r: np.ndarray):
        self.x, self.p = np.array(x0, float).reshape(-1), np.array(p0, float)
        self.f, self.q, self.h, self.r = np.array(f, float), np.array(q, float), np.atleast_2d(h).astype(float), np.atleast_2d(r).astype(float)

    def predict(self) -> float:
        self.x = self.f @ self.x
        self.p = self.f @ self.p @ self.f.T + self.q
        return float(self.x[0])

    def update(self, z: float) -> float:
        if not np.isnan(z):
            gain = self.p @ self.h.T @ np.linalg.inv(self.h @ self.p @ self.h.T + self.r)
            self.x = self.x + gain @ (z - self.h @ self.x)
            self.p = self.p - gain @ self.h @ self.p
        return float(self.x[0])

    def run(self, z: np.ndarray) -> np.ndarray:
        out = np.empty(len(z))
        for i, v in enumerate(z):
            self.predict()
            out[i] = self.update(v)
        return out


#: Fixed values of the local linear trend preset.
TREND = {
    "p0": [[1.0, 0.0], [0.0, 2.0]],
    "f": [[1.0, 1.0], [0.0, 1.0]],
    "q": [[0.01, 0.0], [0.0, 0.001]],
    "h": [[1.0, 0.0]],
    "r": [[0.1]],
}


def trend_step(s: tuple[float, ...], z: float) -> tuple[float, ...]:
    """One row of the local linear trend preset, without matrices: level, trend and the covariance's three distinct entries."""
    x, v, a, b, c = s
    x, a, b, c = x + v, a + 2 * b + c + 0.01, b + c, c + 0.001
    if z != z:
        return x, v, a, b, c
    ka, kb, miss = a / (a + 0.1), b / (a + 0.1), z - x
    return x + ka * miss, v + kb * miss, (1 - ka) * a, (1 - ka) * b, c - kb * b


def trend_start(first: float) -> tuple[float, ...]:
    return first, 0.0, 1.0, 0.0, 2.0


def local_trend(z: np.ndarray) -> np.ndarray:
    s, out = trend_start(first_value(z)), []
    for v in z.tolist():
        s = trend_step(s, v)
        out.append(s[0])
    return np.array(out, float)


def kalman(df: DataFrame, spec: SeriesSpec = EVENTS, **model: list) -> DataFrame:
    """The filtered level of every row; without a model, the local linear trend from the first value."""
    if model:
        return fold(df, lambda z, _: Kalman(**model).run(z), "level", spec)
    return fold(df, lambda z, _: local_trend(z), "level", spec)


def kalman_final(df: DataFrame, spec: SeriesSpec = EVENTS) -> DataFrame:
    """Only the last filtered state of each series (level, trend), as a fold over its ordered values in the JVM."""
    ordered = F.sort_array(F.collect_list(F.struct(*spec.order, F.col(spec.value).alias("_z"))))
    rows = df.withColumn("_first", first_valid(F.col(spec.value), spec.w)).groupBy(*spec.key).agg(ordered.alias("_rows"), F.max("_first").alias("_first"))
    names = ("x", "v", "a", "b", "c")  # level, trend, and the covariance's three distinct entries

    def state(**parts: Column) -> Column:
        return F.struct(*[parts[n].cast("double").alias(n) for n in names])

    def step(s: Column, row: Column) -> Column:
        level, trend = s["x"] + s["v"], s["v"]
        a, b, c = s["a"] + 2 * s["b"] + s["c"] + 0.01, s["b"] + s["c"], s["c"] + 0.001
        ka, kb, miss = a / (a + 0.1), b / (a + 0.1), row["_z"] - level
        seen = state(x=level + ka * miss, v=trend + kb * miss, a=(1 - ka) * a, b=(1 - ka) * b, c=c - kb * b)
        return F.when(row["_z"].isNull(), state(x=level, v=trend, a=a, b=b, c=c)).otherwise(seen)

    start = state(x=F.col("_first"), v=F.lit(0.0), a=F.lit(1.0), b=F.lit(0.0), c=F.lit(2.0))
    return rows.select(*spec.key, F.aggregate("_rows", start, step).alias("_s")).select(*spec.key, F.col("_s.x").alias("level"), F.col("_s.v").alias("trend"))


def sine_drift(state: np.ndarray) -> np.ndarray:
    """The example of a nonlinear model."""
    return state + 0.1 * np.sin(state)


def ensemble(z: np.ndarray, rng: np.random.Generator, x0: np.ndarray, p0: np.ndarray, q: np.ndarray, r: np.ndarray, members: int = 64, model: Callable | None = None) -> np.ndarray:
    """Stochastic ensemble filter: the first component is observed with noise; missing values only move the ensemble. (T, d) means."""
    d = len(x0)
    states = rng.multivariate_normal(x0, p0, members)
    out = np.empty((len(z), d))
    for t, v in enumerate(z):
        states = (model(states) if model else states) + rng.multivariate_normal(np.zeros(d), q, members)
        if not np.isnan(v):
            cov = np.cov(states, rowvar=False).reshape(d, d)
            gain = cov[:, 0] / (cov[0, 0] + r[0][0])
            noisy = v + rng.normal(0, np.sqrt(r[0][0]), members)
            states = states + (noisy - states[:, 0])[:, None] * gain
        out[t] = states.mean(0)
    return out


def sobol(n: int, d: int, rng: np.random.Generator) -> np.ndarray:
    """n points of a digitally shifted Sobol sequence in [0, 1)^d, for up to eight dimensions."""
    # Degree, coefficients and first direction numbers of the primitive polynomials (Joe and Kuo).
    known = [(1, 0, [1]), (2, 1, [1, 3]), (3, 1, [1, 3, 1]), (3, 2, [1, 1, 1]), (4, 1, [1, 1, 3, 3]), (4, 4, [1, 3, 5, 13]), (5, 2, [1, 1, 5, 5, 17])]
    if d > len(known) + 1:
        raise ValueError("too many dimensions")
    bits = 30
    out = np.empty((n, d))
    gray = np.arange(n) ^ (np.arange(n) >> 1)
    for j in range(d):
        if j == 0:
            v = [1 << (bits - 1 - i) for i in range(bits)]
        else:
            s, a, m = known[j - 1]
            v = [m[i] << (bits - 1 - i) for i in range(s)]
            for i in range(s, bits):
                x = v[i - s] ^ (v[i - s] >> s)
                for k in range(1, s):
                    if a >> (s - 1 - k) & 1:
                        x ^= v[i - k]
                v.append(x)
        x = np.full(n, rng.integers(0, 1 << bits))
        for i in range(bits):
            x ^= np.where(gray >> i & 1, v[i], 0)
        out[:, j] = x / (1 << bits)
    return out


class Particles:
    """Particle filter: a Gaussian random walk with Gaussian likelihood, or ("gbm") geometric motion with Student's t; resampled each step."""

    #: Fixed values of the geometric motion and the likelihood.
    DRIFT, VOLATILITY, FREEDOM = 0.01, 0.1, 3

    def __init__(self, n: int, bounds: list[tuple[float, float]], process: float, measurement: float, rng: np.random.Generator, motion: str = "walk"):
        lo, hi = np.array(bounds, float).T
        self.x = lo + sobol(n, len(bounds), rng) * (hi - lo)
        self.process, self.measurement, self.rng, self.motion = process, measurement, rng, motion

    def predict(self) -> None:
        noise = self.rng.standard_normal(self.x.shape)
        if self.motion == "gbm":
            self.x = self.x * np.exp(self.DRIFT - self.VOLATILITY**2 / 2 + self.VOLATILITY * noise)
        else:
            self.x = self.x + self.process * noise

    def update(self, z: float | np.ndarray) -> None:
        far = ((self.x - z) ** 2).sum(1)
        if self.motion == "gbm":
            log = -0.5 * (self.FREEDOM + self.x.shape[1]) * np.log1p(far / self.FREEDOM)
        else:
            log = -0.5 * far / self.measurement**2
        weight = np.exp(log - log.max())  # scaled, so that far particles don't all vanish
        self.x = self.x[self.rng.choice(len(self.x), len(self.x), p=weight / weight.sum())]

    def run(self, z: np.ndarray) -> np.ndarray:
        out = np.empty((len(z), self.x.shape[1]))
        for t, v in enumerate(z):
            self.predict()
            if not np.isnan(v).any():
                self.update(v)
            out[t] = self.x.mean(0)
        return out


#: The affine process of (level, trend, volatility, mean) and the noise of the unscented filters.
PROCESS = np.array([[0.9, 1.0, 0.0, 0.1], [-0.01, 0.95, 0.0, 0.01], [0.0, 0.0, 0.9, 0.0], [0.01, 0.0, 0.0, 0.99]])
OFFSET = np.array([0.0, 0.0, 0.02, 0.0])
Q4 = np.array([0.01, 0.001, 0.001, 0.001])
P4 = np.array([0.1, 0.01, 0.001, 0.1])


def process_function(state: np.ndarray) -> np.ndarray:
    return PROCESS @ state + OFFSET


def measurement_function(state: np.ndarray) -> float:
    return float(state[0])


class FinancialUKF:
    """Unscented filter over n dimensions of four variables, variable-major: all levels, all trends and so on.

    ``literal`` lays the covariances out dimension-major instead, beside a variable-major state, so that for more than one dimension
    noise goes to other variables than it is meant for; it is there for those who need that layout's numbers.

    The process is affine, so the unscented transform is exact in closed form: with S the matrix whose rows are the sigma
    offsets (the lower Cholesky factor, or the root of the diagonal where there is none), C = A S'S A', the predicted
    covariance is C + Q, and the gain comes from C alone with R added to its observed part.
    """

    def __init__(self, first: np.ndarray, scale_floor: float = 1e-12, literal: bool = False):
        n = self.n = len(first)
        scale = max(float(np.std(first)), scale_floor) if n > 1 else 1.0
        self.x = np.concatenate([first, np.zeros(n), np.full(n, 0.1), first])
        spread = lambda v: np.diag(np.tile(v, n) if literal else np.repeat(v, n)) * scale
        self.p, self.q = spread(P4), spread(Q4)
        self.r = np.eye(n) * 0.1 * scale
        self.a, self.c = np.kron(PROCESS, np.eye(n)), np.repeat(OFFSET, n)

    def root(self) -> np.ndarray:
        try:
            return np.linalg.cholesky(self.p)
        except np.linalg.LinAlgError:
            return np.diag(np.sqrt(np.maximum(np.diag(self.p), 0)))

    def step(self, z: np.ndarray) -> np.ndarray:
        s = self.root()
        spread = self.a @ s.T @ s @ self.a.T
        self.x, self.p = self.a @ self.x + self.c, spread + self.q
        seen = np.flatnonzero(~np.isnan(z))
        if len(seen):
            pyy = spread[np.ix_(seen, seen)] + self.r[np.ix_(seen, seen)]
            gain = np.linalg.solve(pyy, spread[:, seen].T).T
            self.x = self.x + gain @ (z[seen] - self.x[seen])
            self.p = self.p - gain @ pyy @ gain.T
        return self.x[: self.n]


def robust_ukf(z: np.ndarray, literal: bool = False) -> np.ndarray:
    """Filtered levels of (T, n) measurements with gaps."""
    if z.ndim != 2:
        raise ValueError("measurements have two dimensions")
    ukf = FinancialUKF(np.array([first_value(z[:, j]) for j in range(z.shape[1])]), literal=literal)
    return np.array([ukf.step(row) for row in z]).reshape(z.shape)


class RobustUKF:
    """The one-dimensional filter whose noise follows its innovations; with the symmetric root of P, S'S is P itself."""

    WINDOW = 30

    def __init__(self, z: np.ndarray):
        clean = z[~np.isnan(z)]
        self.scale = float(clean.std()) if len(clean) > 1 else 1.0
        first = float(clean[0]) if len(clean) else 0.0
        self.x = np.array([first, 0.0, 0.1, first]) if len(clean) else np.zeros(4)
        self.p = np.diag([0.1 * self.scale, 0.01 * self.scale, 0.1, 0.1 * self.scale])
        self.q, self.r = np.diag(Q4) * self.scale, 0.1 * self.scale
        self.innovations: list[float] = []

    def step(self, z: float) -> float:
        spread = PROCESS @ self.p @ PROCESS.T
        self.x, self.p = PROCESS @ self.x + OFFSET, spread + self.q
        if not np.isnan(z):
            pyy, pxy = spread[0, 0] + self.r, spread[:, 0]
            gain, miss = pxy / pyy, z - self.x[0]
            self.x, self.p = self.x + gain * miss, self.p - pyy * np.outer(gain, gain)
            self.adapt(miss)
        return float(self.x[0])

    def adapt(self, miss: float) -> None:
        self.innovations = [*self.innovations[-(self.WINDOW - 1) :], miss]
        if len(self.innovations) > 1:
            sd = float(np.std(self.innovations))
            self.r = max(0.5 * sd, 0.01 * self.scale)
            self.q = self.q * (1.5 if abs(miss) > 3 * sd else 0.99)


def robust_financial(z: np.ndarray) -> np.ndarray:
    """Zeros for a series without a value other than 0; a constant series as it is; else the robust filter's levels."""
    clean = z[~np.isnan(z)]
    if not len(clean) or not clean.any():
        return np.zeros(len(z))
    if (clean == clean[0]).all():
        return z
    ukf = RobustUKF(z)
    return np.array([ukf.step(v) for v in z])


def ensemble_filter(df: DataFrame, members: int = 64, model: Callable | None = None, spec: SeriesSpec = EVENTS, seed: int = 0) -> DataFrame:
    """A two-state ensemble filter from each series' first value."""

    def run(z: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        return ensemble(z, rng, np.array([first_value(z), 0.0]), np.diag([1.0, 1.0]), np.diag([0.1, 0.01]), [[0.5]], members, model)[:, 0]

    return fold(df, run, "level", spec, seed)


def particle_filter(df: DataFrame, n: int = 128, motion: str = "walk", process: float = 10.0, measurement: float = 20.0, spec: SeriesSpec = EVENTS, seed: int = 0) -> DataFrame:
    """A one-state particle filter, its particles between each series' least and greatest value at first."""

    def run(z: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        lo, hi = (float(np.nanmin(z)), float(np.nanmax(z))) if not np.isnan(z).all() else (0.0, 1.0)
        return Particles(n, [(lo, hi if hi > lo else lo + 1)], process, measurement, rng, motion).run(z)[:, 0]

    return fold(df, run, "level", spec, seed)


def multivariate_ukf(df: DataFrame, values: list[str], spec: SeriesSpec = EVENTS) -> DataFrame:
    """The unscented filter over several columns at once; each gets a column with _level after its name."""
    columns = [*spec.key, *spec.order, *values]
    schema = df.select(*columns).withColumns({f"{v}_level": F.lit(0.0) for v in values}).schema

    def per_series(_: tuple, pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        out = robust_ukf(pdf[values].to_numpy(float, na_value=np.nan))
        return {f"{v}_level": out[:, j] for j, v in enumerate(values)}

    return over_series(df.select(*columns), schema, per_series, spec)
