"""Epochs of batches: windows, segments and their schedule put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import digest
from . import panel as panels
from . import scalers, segments, windows
from .series import EVENTS, SeriesSpec


def epoch(df: DataFrame, lookbacks: list[int], batch_size: int, samples: int = 32, shortest: int = 8, longest: int = 128, next_step: bool = False, spec: SeriesSpec = EVENTS, seed: int = 0) -> DataFrame:
    """One epoch over a series: for each lookback ``samples`` segments of shortest..longest windows, in batches whose lanes connect."""
    items = windows.pairs(df, lookbacks, next_step, spec=spec)
    keys = (*spec.key, "lookback")
    drawn = segments.drawn(items, keys, samples, "uniform", shortest, longest, seed)
    return segments.batches(drawn.withColumn("seg_key", F.concat_ws("/", *keys, "seg_id")), batch_size, seed=seed)


def features(panel: DataFrame, inputs: list[str], slices: int, shortest: int, longest: int, imputed: list[str], seed: int = 0) -> DataFrame:
    """Random slices of a panel: ``imputed`` columns imputed, inputs standardised by the whole panel, and the symbol one-hot in sparse
    form: ``hot_at``, the place of its 1, and ``hot_size``, the number of symbols."""
    symbols = panels.numbered(panel, ["symbol_id"], "hot_at")
    size = symbols.agg(F.count(F.lit(1)).alias("hot_size"))  # one row
    cut = panels.impute(panels.sample(panel, slices, shortest, longest, seed), imputed)
    return scalers.standardise(cut, inputs, panel).join(symbols, "symbol_id").crossJoin(F.broadcast(size))


def one_hot(values: Column, at: Column, size: Column) -> Column:
    """The values and behind them ``size`` numbers, 1.0 at ``at`` (none where it is null) and else 0.0, as one array."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    hot = F.concat(zeros(at), F.array(F.lit(1.0)), zeros(size - at - 1))
    return F.concat(values, F.when(at.isNull(), zeros(size)).otherwise(hot))


def prepared(panel: DataFrame, inputs: list[str], target: str, slices: int, shortest: int, longest: int, seed: int = 0, most_symbols: int = 10_000) -> DataFrame:
    """Random slices of a panel: inputs imputed and standardised by the whole panel, and the symbol one-hot, as one array ``row``; the target as ``y_value``.

    The symbol's part of the array is as long as there are symbols; with more than ``most_symbols`` the query fails: take features() then.
    """
    cut = features(panel, inputs, slices, shortest, longest, inputs, seed)
    width = F.when(F.col("hot_size") <= most_symbols, F.col("hot_size")).otherwise(F.raise_error(F.lit("too many symbols for a dense one-hot array")).cast("long"))
    row = one_hot(F.array(*[F.coalesce(c, F.lit(0.0)) for c in inputs]), F.col("hot_at"), width)
    return cut.select("sample_id", "date_id", "symbol_id", "time_id", row.alias("row"), F.coalesce(target, F.lit(0.0)).alias("y_value"))


def lazy_epoch(panel: DataFrame, inputs: list[str], target: str, lookbacks: list[int], batch_size: int, slices: int = 32, shortest: int = 8, longest: int = 128, seed: int = 0) -> DataFrame:
    """One epoch over a panel: each slice is a segment of windows for each lookback that it holds.

    The symbol is one-hot in sparse form until the windows are in their batches; the last projection makes their arrays, of any number of symbols.
    """
    row = F.struct(F.array(*[F.coalesce(c, F.lit(0.0)) for c in inputs]).alias("values"), "hot_at", "hot_size")
    rows = features(panel, inputs, slices, shortest, longest, inputs, seed).select("sample_id", "time_id", row.alias("row"), F.coalesce(target, F.lit(0.0)).alias("y_value"))
    spec = SeriesSpec(("sample_id",), ("time_id",), "row")
    items = windows.pairs(rows, lookbacks, False, "y_value", spec)
    items = items.withColumn("seg_key", F.concat_ws("/", "sample_id", "lookback")).withColumnRenamed("item", "item_no")
    first = F.element_at("x_window", 1)
    zero = F.struct(F.transform(first["values"], lambda _: F.lit(0.0)).alias("values"), F.lit(None).cast("long").alias("hot_at"), first["hot_size"].alias("hot_size"))
    out = segments.batches(items, batch_size, seed=seed, zero=zero)
    return out.withColumn("x_window", F.transform("x_window", lambda r: one_hot(r["values"], r["hot_at"], r["hot_size"])))


def test_segment(panel: DataFrame, inputs: list[str], target: str, lookback: int, seed: int = 0) -> DataFrame:
    """One random run of ``lookback`` + 1 rows of one symbol and day: x_window of the first lookback rows, y of the last."""
    w = SeriesSpec(("date_id", "symbol_id"), ("time_id",)).w
    values = F.struct(F.array(*[F.coalesce(c, F.lit(0.0)) for c in inputs]).alias("row"), F.coalesce(target, F.lit(0.0)).alias("y"))
    ends = panel.withColumn("_r", F.collect_list(values).over(w.rowsBetween(-lookback, 0))).filter(F.size("_r") == lookback + 1)
    pick = F.min_by(F.struct("date_id", "symbol_id", "time_id", "_r"), digest("date_id", "symbol_id", "time_id", seed=seed))
    one = ends.agg(pick.alias("p")).filter("p is not null").select("p.*")
    return one.select("date_id", "symbol_id", (F.col("time_id") - lookback).alias("t0"), F.slice(F.col("_r.row"), 1, lookback).alias("x_window"), F.element_at(F.col("_r.y"), -1).alias("y"))
