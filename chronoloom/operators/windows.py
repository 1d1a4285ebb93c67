"""Lookback/horizon windows over series, as frames: no join but where windows are asked for by time.

Long form is one row per (window, side, offset); array form has x and y columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import uniform
from .series import EVENTS, SeriesSpec


def array_windows(df: DataFrame, lookback: int, horizon: int, spec: SeriesSpec = EVENTS) -> DataFrame:
    """Each row as a center, with x the lookback rows before it and y the horizon rows from it on."""
    w = spec.w
    return df.withColumns({
        "x_window": F.collect_list(spec.value).over(w.rowsBetween(-lookback, -1)),
        "y_window": F.collect_list(spec.value).over(w.rowsBetween(0, horizon - 1)),
    })


def long_form(windows: DataFrame, center: str, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """One row per value: the center, side ``x`` or ``y``, offset from 0, value."""
    both = F.concat(
        F.transform("x_window", lambda v, i: F.struct(F.lit("x").alias("side"), i.cast("long").alias("pos"), v.alias("value"))),
        F.transform("y_window", lambda v, i: F.struct(F.lit("y").alias("side"), i.cast("long").alias("pos"), v.alias("value"))),
    )
    return windows.select(*keys, F.col(center).alias("center"), F.explode(both).alias("v")).select(*keys, "center", "v.*")


def by_centers(df: DataFrame, centers: DataFrame, lookback_ms: int, lookahead_ms: int, spec: SeriesSpec = EVENTS, bucket_ms: int | None = None) -> DataFrame:
    """Long windows around the times in centers (key, center): rows in [c - lookback, c) and [c, c + lookahead).

    Centers whose window leaves the series' first and last time are skipped. A center meets the buckets of time that its
    window touches, each row its own bucket: an equi-join on key and bucket, with the exact bounds left to check, so the
    cost follows the result and no side is broadcast.
    """
    ts = spec.order[0]
    ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))
    rows = df.withColumn("_ms", ms)
    ends = rows.groupBy(*spec.key).agg(F.min("_ms").alias("_a"), F.max("_ms").alias("_b"))
    size = bucket_ms or max(lookback_ms, lookahead_ms)
    c = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("center"))
    asked = centers.withColumn("_c", c).join(ends, list(spec.key)).filter((F.col("_c") - lookback_ms >= F.col("_a")) & (F.col("_c") + lookahead_ms <= F.col("_b")))
    first, last = F.floor((F.col("_c") - lookback_ms) / size), F.floor((F.col("_c") + lookahead_ms - 1) / size)
    asked = asked.select(*spec.key, "center", "_c", F.explode(F.sequence(first, last)).alias("_bucket"))
    hit = rows.withColumn("_bucket", F.floor(F.col("_ms") / size)).join(asked, [*spec.key, "_bucket"])
    hit = hit.filter((F.col("_ms") >= F.col("_c") - lookback_ms) & (F.col("_ms") < F.col("_c") + lookahead_ms))
    side = F.when(F.col("_ms") < F.col("_c"), "x").otherwise("y")
    at = Window.partitionBy(*spec.key, "_c", "side").orderBy(*spec.order)
    out = hit.withColumn("side", side).withColumn("pos", (F.row_number().over(at) - 1).cast("long"))
    return out.select(*spec.key, "center", "side", "pos", F.col(spec.value).alias("value"))


def batch_by_centers(df: DataFrame, centers: DataFrame, lookback_ms: int, lookahead_ms: int, spec: SeriesSpec = EVENTS, bucket_ms: int | None = None) -> DataFrame:
    """The same in array form: for each center x_window and y_window, in order of time; a side without rows is an empty array."""
    rows = by_centers(df, centers, lookback_ms, lookahead_ms, spec, bucket_ms)
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("pos", "value"))))["value"]
    return rows.groupBy(*spec.key, "center").agg(of("x").alias("x_window"), of("y").alias("y_window"))


def contiguous(df: DataFrame, lookback_steps: int, horizon_steps: int, stride: int, step_ms: int, spec: SeriesSpec = EVENTS, restart: bool = False) -> DataFrame:
    """Array windows at the centers without a gap: the row lookback_steps before lies exactly so many steps back, the row
    horizon_steps ahead exactly so many ahead; every stride-th row from the first possible one is a center. With ``restart`` the
    stride begins anew after each gap, at the first row with a whole lookback, so that it skips nothing there."""
    w, ts = spec.w, spec.order[0]
    if restart:
        gap = F.coalesce(F.timestamp_diff("MILLISECOND", F.lag(ts).over(w), F.col(ts)) != step_ms, F.lit(False))
        df = df.withColumn("_gap", gap).withColumn("_run", F.sum(F.col("_gap").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")
        out = contiguous(df, lookback_steps, horizon_steps, stride, step_ms, SeriesSpec((*spec.key, "_run"), spec.order, spec.value))
        return out.drop("_run")
    n = F.row_number().over(w) - 1
    back = F.timestamp_diff("MILLISECOND", F.lag(ts, lookback_steps).over(w), F.col(ts))
    ahead = F.timestamp_diff("MILLISECOND", F.col(ts), F.lead(ts, horizon_steps).over(w))
    out = array_windows(df, lookback_steps, horizon_steps, spec).withColumns({"_n": n, "_back": back, "_ahead": ahead})
    good = (F.col("_back") == lookback_steps * step_ms) & (F.col("_ahead") == horizon_steps * step_ms) & (F.pmod(F.col("_n") - lookback_steps, F.lit(stride)) == 0)
    return out.filter(good).drop("_n", "_back", "_ahead")


def positional(df: DataFrame, lookback: int, horizon: int, mode: str, n_samples: int = 0, seed: int = 0, spec: SeriesSpec = EVENTS) -> DataFrame:
    """Array windows at centers between lookback and n - horizon: ``segments`` (stride lookback + horizon),
    ``continuous-output-coverage`` (stride horizon), or ``random`` (n_samples draws per series, with replacement)."""
    w = spec.w
    total = F.count(F.lit(1)).over(Window.partitionBy(*spec.key))
    out = array_windows(df, lookback, horizon, spec).withColumns({"_n": (F.row_number().over(w) - 1).cast("long"), "_total": total})
    valid = F.col("_n").between(F.lit(lookback), F.col("_total") - horizon)
    if mode == "random":
        spans = df.groupBy(*spec.key).agg(F.count(F.lit(1)).alias("_total")).filter(F.col("_total") >= lookback + horizon)
        draws = spans.select(*spec.key, "_total", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("sample"))
        pick = F.floor(uniform(*spec.key, "sample", seed=seed) * (F.col("_total") - horizon - lookback + 1)) + lookback
        return out.drop("_total").join(draws.select(*spec.key, "sample", pick.alias("_n")), [*spec.key, "_n"]).drop("_n")
    strides = {"segments": lookback + horizon, "continuous-output-coverage": horizon}
    if mode not in strides:
        raise ValueError(f"unknown mode: {mode}")
    return out.filter(valid & (F.pmod(F.col("_n") - lookback, F.lit(strides[mode])) == 0)).drop("_n", "_total")


def pairs(df: DataFrame, lookbacks: list[int], next_step: bool = True, target: str = "", spec: SeriesSpec = EVENTS) -> DataFrame:
    """Non-overlapping windows of each lookback: key, lookback, item, x_window and the target at the row after the window
    (next_step) or at its last row. The last admissible window is left out, as in the definition i < n - lookback - 1 - offset."""
    w = spec.w
    offset = int(next_step)
    rows = df.withColumns({
        "_n": F.row_number().over(w) - 1, "_total": F.count(F.lit(1)).over(Window.partitionBy(*spec.key)),
        "_y": F.lead(target or spec.value).over(w) if next_step else F.col(target or spec.value),
    })
    rows = rows.withColumn("lookback", F.explode(F.array(*[F.lit(n).cast("long") for n in lookbacks])))
    item = F.floor(F.col("_n") / F.col("lookback"))
    rows = rows.withColumn("item", item).filter(F.col("item") * F.col("lookback") < F.col("_total") - F.col("lookback") - 1 - offset)
    ordered = F.sort_array(F.collect_list(F.struct("_n", spec.value, "_y")))
    out = rows.groupBy(*spec.key, "lookback", "item").agg(ordered.alias("_rows"))
    return out.select(*spec.key, "lookback", "item", F.col(f"_rows.{spec.value}").alias("x_window"), F.element_at(F.col("_rows._y"), -1).alias("y"))


def split(df: DataFrame, ratio: float, gap: int = 0, spec: SeriesSpec = EVENTS) -> DataFrame:
    """df with ``part``: ``first`` before int(n * ratio) - 1, ``second`` from there on plus the gap, null between; a negative
    place counts from the end, as positions do."""
    n, total = F.row_number().over(spec.w) - 1, F.count(F.lit(1)).over(Window.partitionBy(*spec.key))
    k = F.floor(total * F.lit(ratio)) - 1
    start = k + gap
    cut, begin = F.when(k < 0, total + k).otherwise(k), F.when(start < 0, total + start).otherwise(start)
    return df.withColumn("part", F.when(n >= begin, "second").when(n < cut, "first"))


def collate(df: DataFrame, group: tuple[str, ...], x: str = "x_window") -> DataFrame:
    """x padded on the right with zeros to the longest of its group, and ``padded``, true where it was."""
    longest = F.max(F.size(x)).over(Window.partitionBy(*group))
    rest = F.col("_m") - F.col("_n")
    return df.withColumns({"_m": longest, "_n": F.size(x)}).withColumns({
        x: F.concat(F.col(x), F.array_repeat(F.lit(0.0), rest)),
        "padded": F.concat(F.array_repeat(F.lit(False), F.col("_n")), F.array_repeat(F.lit(True), rest)),
    }).drop("_m", "_n")


def lookback_padded(df: DataFrame, lookback: int, spec: SeriesSpec = EVENTS) -> DataFrame:
    """Each row with x_window, the lookback rows up to it, padded on the left with zeros."""
    a = F.collect_list(spec.value).over(spec.frame(lookback))
    return df.withColumn("_a", a).withColumn("x_window", F.concat(F.array_repeat(F.lit(0.0), lookback - F.size("_a")), F.col("_a"))).drop("_a")


def index_lookup(df: DataFrame, ranges: DataFrame, spec: SeriesSpec = EVENTS, seq: str = "seq", block: int = 1024, scale: Callable[[Column], Column] | None = None) -> DataFrame:
    """The values at [start, end) of each range (key, range_id, start, end), as x_window; an equi-join on key and block of places."""
    value = scale(F.col(spec.value)) if scale else F.col(spec.value)
    asked = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    rows = df.select(*spec.key, F.col(seq).alias("_s"), value.alias("_v"), F.floor(F.col(seq) / block).alias("_b"))
    hit = rows.join(asked, [*spec.key, "_b"]).filter((F.col("_s") >= F.col("start")) & (F.col("_s") < F.col("end")))
    ordered = F.sort_array(F.collect_list(F.struct("_s", "_v")))
    return hit.groupBy(*spec.key, "range_id", "start", "end").agg(ordered.alias("_r")).select(*spec.key, "range_id", "start", "end", F.col("_r._v").alias("x_window"))


def transform_windows(df: DataFrame, f: Callable[[Column], Column], x: str = "x_window") -> DataFrame:
    """A function of columns applied to each value of the windows."""
    return df.withColumn(x, F.transform(x, f))


def equal_lengths(df: DataFrame, x: str = "x_window") -> DataFrame:
    """df, which fails when it runs if its windows aren't of one length: stacking needs that."""
    first = df.agg(F.min(F.size(x)).alias("_lo"), F.max(F.size(x)).alias("_hi"))
    check = F.assert_true(F.coalesce(F.col("_lo") == F.col("_hi"), F.lit(True)), F.lit("windows differ in length"))
    return df.crossJoin(F.broadcast(first)).filter(check.isNull()).drop("_lo", "_hi")
