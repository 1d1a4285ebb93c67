"""Rolling and pointwise features as window expressions.

Features are asked for together and computed in four projections over one window specification, so that a series is
shuffled and sorted once: lags, frames, shifts of frames, fills.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fill import fb
from .series import EVENTS, SeriesSpec

EPS = 1e-10


@dataclass(frozen=True)
class Feature:
    """A feature by kind; see KINDS. args: window, horizon, lag, shift, base (a column) or eps, as the kind needs."""

    kind: str
    name: str = ""
    args: dict = field(default_factory=dict)

    @property
    def alias(self) -> str:
        return self.name or self.kind


def _lag_name(i: int, what: str) -> str:
    return f"_{what}{i}"


#: Kinds whose result isn't filled.
UNFILLED = ("log_relative", "log_returns", "detrend", "future_change", "future_change_vol")


def rolling(df: DataFrame, features: list[Feature], spec: SeriesSpec = EVENTS, fill: bool = True) -> DataFrame:
    """df with one column per feature. Missing values are null; integers are computed as doubles. Without ``fill``, results are
    left as the frames give them."""
    x = F.col(spec.value).cast("double")
    w = spec.w
    lags: dict[str, Column] = {}
    frames: dict[str, Column] = {}
    shifts: dict[str, Column] = {}
    final: dict[str, Column] = {}
    for i, f in enumerate(features):
        a, out = f.args, f"_r{i}"
        n = a.get("window", 0)
        fr = spec.frame(n) if n else None
        filled = True
        if f.kind == "mean":
            frames[out] = F.avg(x).over(fr)
        elif f.kind == "std":
            frames[f"_s{i}"] = F.stddev_samp(x).over(fr)
            k = a.get("shift", 0)
            shifts[out] = F.lag(f"_s{i}", k).over(w) if k > 0 else F.lead(f"_s{i}", -k).over(w) if k < 0 else F.col(f"_s{i}")
        elif f.kind == "rsi":
            lags[f"_d{i}"] = x - F.lag(x).over(w)
            d = F.col(f"_d{i}")
            gain, loss = F.avg(F.when(d > 0, d).otherwise(0.0)).over(fr), F.avg(F.when(d < 0, -d).otherwise(0.0)).over(fr)
            frames[out] = 100 - 100 / (1 + gain / (loss + EPS))
        elif f.kind == "lag_change":
            frames[out] = x - F.lag(x, a.get("lag", 1)).over(w)
        elif f.kind == "zscore":
            frames[out] = (x - F.avg(x).over(fr)) / (F.stddev_samp(x).over(fr) + EPS)
        elif f.kind == "price_ratio":
            frames[out] = F.try_divide(x, F.col(a["base"]) + EPS)
        elif f.kind == "log_relative":
            ratio = F.try_divide(x, F.col(a["base"]) + a.get("eps", 1e-4))
            # Spark's logarithm of 0 is null; here it is -infinity, and missing only where the ratio is missing or negative
            frames[out], filled = F.when(ratio == 0, F.lit(-math.inf)).otherwise(F.ln(ratio)), False
        elif f.kind == "log_returns":
            eps = a.get("eps", 1e-4)
            ratio = F.ln(F.abs(F.try_divide(x, F.lag(x).over(w) + eps)) + eps)
            frames[out], filled = F.when(F.row_number().over(w) == 1, 0.0).otherwise(ratio), False
        elif f.kind == "detrend":
            # the mean is filled forward first, as the mean feature is
            frames[f"_m{i}"] = F.avg(x).over(fr)
            shifts[out], filled = x - fb(F.col(f"_m{i}"), w), False
        elif f.kind == "slope":
            lags[f"_n{i}"] = F.row_number().over(w).cast("double")
            whole = F.count(x).over(fr) == F.count(F.lit(1)).over(fr)
            frames[out] = F.when(whole, F.coalesce(F.regr_slope(x, F.col(f"_n{i}")).over(fr), F.lit(0.0)))
        elif f.kind == "integral":
            frames[out] = F.sum(x).over(fr)
        elif f.kind == "skew":
            m, g = F.count(x).over(fr), F.skewness(x).over(fr)
            flat = F.max(x).over(fr) == F.min(x).over(fr)
            frames[out] = F.when(m < 3, F.lit(None)).when(flat, 0.0).otherwise(g * F.sqrt(m * (m - 1.0)) / F.greatest(m - 2, F.lit(1)))
        elif f.kind == "autocorr":
            k = a.get("lag", 1)
            lags[f"_p{i}"] = F.lag(x, k).over(w)
            pairs = spec.frame(n - k)
            p, q = F.when(x.isNotNull(), F.col(f"_p{i}")), F.when(F.col(f"_p{i}").isNotNull(), x)
            frames[out] = F.try_divide(F.covar_pop(p, q).over(pairs), F.stddev_pop(p).over(pairs) * F.stddev_pop(q).over(pairs))
        elif f.kind == "future_change":
            # the mean of the next horizon - 1 values, with ``change`` less the value itself
            ahead = F.avg(x).over(w.rowsBetween(1, _horizon(a) - 1))
            frames[out], filled = ahead - x if a.get("change") else ahead, False
        elif f.kind == "future_change_vol":
            ahead = w.rowsBetween(1, _horizon(a))
            frames[out], filled = (F.avg(x).over(ahead) - x) / (1 + F.stddev_pop(x).over(ahead)), False
        elif f.kind in ("entropy", "fractal"):
            frames[f"_a{i}"] = F.collect_list(x).over(fr)
            frames[f"_c{i}"] = F.count(F.lit(1)).over(fr)
            made = histogram_entropy(F.col(f"_a{i}"), a.get("bins", 10)) if f.kind == "entropy" else box_dimension(F.col(f"_a{i}"))
            shifts[out] = F.when(F.size(f"_a{i}") == F.col(f"_c{i}"), made)
        else:
            raise ValueError(f"unknown feature: {f.kind}")
        shifts.setdefault(out, F.col(out))
        final[f.alias] = fb(F.col(out), w) if filled and fill else F.col(out)
    staged = df
    for stage in (lags, frames, {k: v for k, v in shifts.items()}):
        if stage:
            staged = staged.withColumns(stage)
    return staged.select(*df.columns, *[c.alias(k) for k, c in final.items()])


def _horizon(args: dict) -> int:
    if args["horizon"] <= 1:
        raise ValueError("horizon must exceed 1")
    return args["horizon"]


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once."""
    return F.transform(F.array(value), f)[0]


def _spanned(values: Column, f: Callable[[Column, Column, Column], Column]) -> Column:
    """f(values, least, greatest), each evaluated once."""
    of = F.struct(values.alias("v"), F.array_min(values).alias("low"), F.array_max(values).alias("high"))
    return _let(of, lambda m: f(m["v"], m["low"], m["high"]))


def histogram_entropy(values: Column, bins: int) -> Column:
    """-sum of h * log2(h + 1e-10) over the densities h of the occupied bins; 0 for equal values."""

    def summed(v: Column, low: Column, high: Column) -> Column:
        place = F.transform(v, lambda a: F.least(F.floor(F.try_divide(a - low, high - low) * bins), F.lit(bins - 1)))
        density = lambda p, b: F.size(F.filter(p, lambda q: q == b)) / (F.size(p) * (high - low) / bins)
        term = lambda p, b: _let(density(p, b), lambda d: d * F.log2(d + EPS))
        total = _let(place, lambda p: -F.aggregate(F.transform(F.array_distinct(p), lambda b: term(p, b)), F.lit(0.0), lambda s, t: s + t))
        return F.when(low == high, 0.0).otherwise(total)

    return _spanned(values, summed)


def box_dimension(values: Column, scales: tuple[int, ...] = (2, 4, 8)) -> Column:
    """The slope of log occupied boxes against log 1/width, boxes counted from the least value.

    Fewer than four values, or the same count at all widths, give 1. Edges end with the last that lies below the greatest value
    plus the width; a value beyond the last edge isn't counted, one on it belongs to the last box. No occupied box at some
    width gives null.
    """
    counted = _spanned(values, lambda v, low, high: F.array(*[_boxes(v, low, high, s) for s in scales]))
    return _let(counted, lambda c: _slope_of([c[k] for k in range(len(scales))], F.size(values), scales))


def _slope_of(counts: list[Column], size: Column, scales: tuple[int, ...]) -> Column:
    logs = [F.when(c > 0, F.ln(F.greatest(c, F.lit(1.0)))) for c in counts]
    inverse = [math.log(1 / s) for s in scales]
    mean = sum(inverse) / len(inverse)
    slope = sum((i - mean) * c for i, c in zip(inverse, logs, strict=True)) / sum((i - mean) ** 2 for i in inverse)
    same = counts[0] == counts[1]
    for c in counts[2:]:
        same &= counts[0] == c
    return F.when(size < 4, 1.0).when(same & (counts[0] > 0), 1.0).otherwise(slope)


def _boxes(values: Column, low: Column, high: Column, width: int) -> Column:
    last = F.ceil((high + width - low) / width).cast("int") - 1  # boxes between the edges low, low + width, ...

    def box(v: Column) -> Column:
        b = F.floor((v - low) / width).cast("int")
        return F.when(b == last, last - 1).otherwise(b)

    return F.size(F.array_distinct(F.filter(F.transform(values, box), lambda b: (b >= 0) & (b < last)))).cast("double")
