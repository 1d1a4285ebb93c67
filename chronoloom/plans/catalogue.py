"""The named queries of the time-series operators and their SQL; each query takes (spark, sf_dir)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar, losses
from ..functions.fill import fb, rounded
from ..operators import filters, heavy, kernels, models, panel, scalers, segments, stopping, trainers, windows
from ..operators.long_series import numbered, rolling_long
from ..operators.rolling import Feature, rolling
from ..operators.series import EVENTS
from ..sources import scratch, synthetic, tables
from ..streaming import online
from . import nets, sql, ukf

Query = Callable[[SparkSession, str], DataFrame]
N = 12


def _feature(kind: str, missing: bool = False, digits: int = 6, base: bool = False, **args: object) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = tables.event_series(spark, sf_dir, 7 if missing else 0)
        if base:
            s = s.withColumn("base", F.lag("x").over(EVENTS.w))
            args["base"] = "base"
        return rolling(s, [Feature(kind, "r", args)]).select("series_id", "event_id", rounded(F.col("r"), digits).alias("y"))

    return run


def roll_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series, in chunks."""
    one = tables.table(spark, sf_dir, "events").select(F.lit(0).cast("long").alias("series_id"), "ts", "event_id", F.col("value").alias("x"))
    out = rolling_long(numbered(one, 86_400_000), [Feature("mean", args={"window": N}), Feature("zscore", args={"window": N})], N, 4096)
    return out.select("series_id", "event_id", rounded(F.col("mean")).alias("mean"), rounded(F.col("zscore")).alias("zscore"))


def _scaled(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(tables.event_series(spark, sf_dir)).select("series_id", "event_id", rounded(F.col("x"), 9).alias("y"))


def _heavy(kind: str, window: int) -> Query:
    return lambda spark, sf_dir: heavy.heavy(tables.event_series(spark, sf_dir), [kind], window).select("series_id", "event_id", rounded(F.col(kind)).alias("y"))


def _calendar(period: str, step: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cos, sin = calendar.cyclic(F.col("ts"), period, step)
        e = tables.table(spark, sf_dir, "events")
        return e.select("event_id", calendar.offset_ms(F.col("ts"), period, step).alias("offset_ms"), rounded(cos).alias("period_cos"), rounded(sin).alias("period_sin"))

    return run


def _long(df: DataFrame, center: str) -> DataFrame:
    return windows.long_form(df, center).withColumn("value", rounded(F.col("value")))


def win_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.hourly_grid(spark, sf_dir)
    centers = g.filter("seq % 24 = 0").select("series_id", F.col("ts").alias("center"))
    out = windows.by_centers(g, centers, 12 * 3_600_000, 6 * 3_600_000)
    return out.select("series_id", tables.hour_of(F.col("center")).alias("center"), "side", "pos", rounded(F.col("value")).alias("value"))


def win_batch_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables.hourly_grid(spark, sf_dir)
    centers = g.filter("seq % 24 = 0").select("series_id", F.col("ts").alias("center"))
    out = windows.batch_by_centers(g, centers, 12 * 3_600_000, 6 * 3_600_000)
    return windows.long_form(out, "center").withColumns({"center": tables.hour_of(F.col("center")), "value": rounded(F.col("value"))})


def win_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.lookback_padded(tables.event_series(spark, sf_dir), 8)
    return _values(windows.transform_windows(out, lambda v: v * 0.5 + 1).select("series_id", "event_id", "x_window"))


def win_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of one length, checked to be so, as one batch."""
    out = windows.pairs(tables.event_series(spark, sf_dir), [N])
    return _values(windows.equal_lengths(out).select("series_id", "lookback", "item", "x_window", "y"))


def win_dt_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(windows.contiguous(tables.hourly_grid(spark, sf_dir), 24, 6, 5, 3_600_000), "hour")


def win_dt_gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(windows.contiguous(tables.daily_orders(spark, sf_dir), 7, 3, 2, 86_400_000), "day")


def win_dt_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(windows.contiguous(tables.daily_orders(spark, sf_dir), 7, 3, 2, 86_400_000, restart=True), "day")


def _positional(mode: str, samples: int = 0) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = windows.positional(tables.hourly_grid(spark, sf_dir), 24, 6, mode, samples, 42)
        if mode != "random":
            return _long(out, "hour")
        drawn = out.withColumn("sample", F.col("sample").cast("long"))
        return windows.long_form(drawn, "hour", ("series_id", "sample")).withColumn("value", rounded(F.col("value")))

    return run


def _pairs(lookbacks: list[int], next_step: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = windows.pairs(tables.event_series(spark, sf_dir), lookbacks, next_step)
        return p.select("series_id", "lookback", "item", F.posexplode("x_window").alias("pos", "value"), "y").withColumn("pos", F.col("pos").cast("long"))

    return run


def win_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.split(tables.event_series(spark, sf_dir), 0.8, 2).filter("part is not null").select("series_id", "event_id", "part")


def _ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("seq", "x")))
    s = tables.event_series(spark, sf_dir).groupBy("series_id").agg(rows.alias("r"))
    return s.select("series_id", (F.col("series_id") % 8).alias("batch"), F.col("r.x").alias("x_window"))


def win_collate_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.collate(_ragged(spark, sf_dir), ("batch",))
    v = F.explode(F.transform(F.arrays_zip("x_window", "padded"), lambda z, i: F.struct(i.cast("long").alias("pos"), z["x_window"].alias("value"), z["padded"].alias("padded"))))
    return out.select("series_id", v.alias("v")).select("series_id", "v.*")


def win_lookback_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.lookback_padded(tables.event_series(spark, sf_dir), 8)
    return out.select("series_id", "event_id", F.posexplode("x_window").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


def win_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.event_series(spark, sf_dir)
    ids = s.select("series_id").distinct()
    start = (10 * F.col("range_id") + F.col("series_id") % 5).cast("long")
    ranges = ids.withColumn("range_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).withColumn("start", start).withColumn("end", F.col("start") + 8)
    out = windows.index_lookup(s, ranges)
    return out.select("series_id", "range_id", F.posexplode("x_window").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


def _values(df: DataFrame, column: str = "x_window") -> DataFrame:
    """A row for each value of an array, with its place."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(column).alias("pos", "value")).withColumns({"pos": F.col("pos").cast("long"), "value": rounded(F.col("value"))})


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pairs(tables.hourly_grid(spark, sf_dir), [4, 8, 12])


def _segments(how: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        items, keys = _items(spark, sf_dir), ("series_id", "lookback")
        a, b = (2, 10) if how == "uniform" else (6.0, 2.0)
        out = segments.partitioned(items, keys, 6.0, 2.0, 42) if how == "stochastic" else segments.drawn(items, keys, 8, how, a, b, 42)
        places = [F.col(c).cast("long").alias(c) for c in ("seg_id", "start", "length", "item_no")]
        return _values(out.select(*keys, *places, rounded(F.col("y")).alias("y"), "x_window"))

    return run


def seg_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.random_segments(tables.event_series(spark, sf_dir), 4, 16, 3, seed=42)
    return _values(out.select("series_id", *[F.col(c).cast("long").alias(c) for c in ("seg_id", "start", "length")], "x_window"))


def seg_lane_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = segments.drawn(_items(spark, sf_dir), ("series_id", "lookback"), 32, "uniform", 2, 10, 42)
    return segments.batches(drawn.withColumn("seg_key", F.concat_ws("/", "series_id", "lookback", "seg_id")), 8)


def panel_lazy_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trainers.features(tables.panel(spark, sf_dir), ["feature"], 32, 2, 12, ["feature", "responder"], 42)
    return out.select("sample_id", "date_id", "symbol_id", "time_id", rounded(F.col("feature")).alias("feature"), rounded(F.col("responder")).alias("responder"), "hot_at", "hot_size")


def panel_test_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trainers.test_segment(tables.panel(spark, sf_dir), ["feature"], "responder", 2, 42)
    return out.select("date_id", "symbol_id", "t0", F.posexplode("x_window").alias("pos", "row"), "y").select(
        "date_id", "symbol_id", "t0", F.col("pos").cast("long").alias("pos"), F.col("row")[0].alias("value"), "y"
    )


def kf_local_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.kalman(tables.event_series(spark, sf_dir)).select("series_id", "event_id", rounded(F.col("level")).alias("y"))


def kf_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.kalman(tables.event_series(spark, sf_dir, 7)).select("series_id", "event_id", rounded(F.col("level")).alias("y"))


def kf_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.kalman_final(tables.event_series(spark, sf_dir, 7)).select("series_id", rounded(F.col("level")).alias("level"), rounded(F.col("trend")).alias("trend"))


def kf_ukf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events").groupBy(tables.hour_of(F.col("ts")).alias("hour"))
    kinds = [r[0] for r in tables.table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]  # a handful of types
    wide = e.agg(*[F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in kinds])
    ts = F.timestamp_add("HOUR", F.col("hour"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    rows = wide.select(F.lit(0).cast("long").alias("series_id"), ts.alias("ts"), F.col("hour").alias("event_id"), *kinds)
    out = filters.multivariate_ukf(rows, kinds).drop("ts")
    return out.withColumns({c: rounded(F.col(c), 4) for k in kinds for c in (k, f"{k}_level")})


def _fold(f: Callable, missing: bool = False) -> Query:
    return lambda spark, sf_dir: filters.fold(tables.event_series(spark, sf_dir, 7 if missing else 0), f, "level").select("series_id", "event_id", rounded(F.col("level"), 4).alias("y"))


def _closed(f: Callable, n: int = 200) -> Query:
    return lambda spark, _: synthetic.closed(spark, n, f).withColumn("x", rounded(F.col("x")))


def _kernel(column: str) -> Query:
    return lambda spark, sf_dir: kernels.moments(tables.event_series(spark, sf_dir), 10.0, 3.0, 32).select("series_id", "event_id", rounded(F.col(f"kern_{column}")).alias("y"))


def _ewma(column: str) -> Query:
    return lambda spark, sf_dir: kernels.ewma(tables.event_series(spark, sf_dir), 1 / 3).select("series_id", "event_id", rounded(F.col(column)).alias("y"))


def _kernel_array(f: Callable[[np.ndarray], float]) -> Query:
    return lambda spark, sf_dir: kernels.array_features(tables.event_series(spark, sf_dir), {"y": f}).select("series_id", "event_id", rounded(F.col("y")).alias("y"))


def kern_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = kernels.Parameter
    configs = [
        kernels.FeatureConfig("avg", "avg", {"window_size": p(2, 32), "gamma": 3.0}), kernels.FeatureConfig("var", "var", {"window_size": p(2, 32), "gamma": 3.0}),
        kernels.FeatureConfig("smooth", "ewma", {"alpha": p(0.05, 0.95)}), kernels.FeatureConfig("slope", "ewma_slope", {"alpha": p(0.05, 0.95)}),
    ]
    out = kernels.feature_layer(tables.event_series(spark, sf_dir), configs, lookback=32)
    return out.select("series_id", "event_id", *[rounded(F.col(c.name)).alias(c.name) for c in configs])


def _loss(f: Callable[[], object]) -> Query:
    return lambda spark, sf_dir: tables.forecasts(spark, sf_dir).groupBy("series_id").agg(rounded(f()).alias("loss"))


def loss_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.forecasts(spark, sf_dir)
    running = F.avg(F.abs(F.col("p") - F.col("y"))).over(EVENTS.w)
    l = p.select("series_id", "seq", F.round(running, 9).alias("loss"))
    return stopping.stop_points(l, patience=3, min_delta=0.5).withColumn("best", rounded(F.col("best")))


def nn_pos_encoding(spark: SparkSession, _: str) -> DataFrame:
    d = 16
    rows = spark.range(50 * d).select(F.floor(F.col("id") / d).alias("pos"), (F.col("id") % d).alias("dim"))
    angle = F.col("pos") * F.exp((F.col("dim") - F.col("dim") % 2) * (-math.log(10000.0) / d))
    return rows.withColumn("value", rounded(F.when(F.col("dim") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))))


def _score(forward: Callable, weights: dict, shape: tuple[int, ...]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = tables.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        return _values(models.score(e, forward, weights, shape, "embedding").select("vec_id", "forecast"), "forecast")

    return run


def _featured(forward: Callable, weights: dict) -> Query:
    """The feature layer, windows of its rows, then the model: what the combined models do."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configs = [kernels.FeatureConfig("avg", "avg", {"window_size": 8.0, "gamma": 3.0}), kernels.FeatureConfig("smooth", "ewma", {"alpha": 0.3})]
        rows = kernels.feature_layer(tables.event_series(spark, sf_dir), configs, lookback=32)
        steps = rows.withColumn("row", F.array("x", "avg", "smooth"))
        steps = steps.withColumn("x_window", F.flatten(F.collect_list("row").over(EVENTS.frame(16))))
        steps = steps.filter(F.size("x_window") == 48).select("series_id", "event_id", "x_window")
        return _values(models.score(steps, forward, weights, (16, 3)).select("series_id", "event_id", "forecast"), "forecast")

    return run


def _stream(transform: Callable[[DataFrame], DataFrame], mode: str = "append") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        schema = tables.table(spark, sf_dir, "events").schema
        shape = lambda s: transform(s.select(F.col("user_id").alias("series_id"), "ts", "event_id", F.col("value").alias("x")))
        return online.replay(spark, f"{sf_dir}/event[s].parquet", schema, shape, scratch.folder(spark, "stream-out"), scratch.folder(spark, "stream-state"), files_per_batch=None, mode=mode)

    return run


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _stream(online.tumbling, "complete")(spark, sf_dir)
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": rounded(F.col("total"), 4), "mean": rounded(F.col("mean"), 4)})


LIN, FIRST = losses.linear_weights, losses.first_exponential_weights
P, Y, T = F.col, F.col, F.col

_S = sql.rnd
_AVG = f"avg(x) OVER ({sql.frame(N)})"
_KF_OUT = f" SELECT s.series_id, s.event_id, {_S('k.l')} AS y FROM s JOIN k ON s.series_id = k.series_id AND s.seq = k.seq"
_EWMA = f"WITH RECURSIVE {sql.events()}, k AS (SELECT series_id, event_id, seq, x AS e, 0.0::DOUBLE AS d FROM s WHERE seq = 0 UNION ALL SELECT s.series_id, s.event_id, s.seq, (1 - 1.0::DOUBLE / 3) * e + 1.0::DOUBLE / 3 * x, (1 - 1.0::DOUBLE / 3) * e + 1.0::DOUBLE / 3 * x - e FROM k JOIN s ON s.series_id = k.series_id AND s.seq = k.seq + 1)"
#: What the given tables hold; the query takes the types that it finds.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
MLP, LSTM = models.mlp_weights(64, 0.5, 2, 4), models.stateful_lstm_weights(4, 8, 2, 2)
ATTENTION, TRANSFORMER = models.stateful_lstm_weights(4, 8, 2, 1, True, "attention"), models.transformer_weights(16, 4, 2)
CNN, POOLED = models.cnn_lstm_weights(4, (8, 6), 8, 2), models.cnn_lstm_weights(4, (8, 6), 8, 2, pooling=True)
DECODER = models.transformer_weights(16, 4, 2, layers=2, bias=True)
CONV = models.conv_lstm_weights(1, [3, 2], [(3, 3), (3, 3)])
DFLSTM, DFDNN = models.stateful_lstm_weights(3, 8, 1), models.mlp_weights(48, 0.25, 1, 1)
_DIFF = f", d AS (SELECT *, x - lag(x) OVER ({sql.W}) AS d FROM s)"

#: name: (query, SQL or None)
CATALOGUE: dict[str, tuple[Query, str | None]] = {
    "pt_log_relative": (_feature("log_relative", base=True), sql.feature("ln(x / (base + 1e-4))", pre=f", {sql.BASE}", filled=False, source="b")),
    "pt_log_returns": (_feature("log_returns"), sql.feature("CASE WHEN seq = 0 THEN 0.0 ELSE ln(abs(x / (base + 1e-4)) + 1e-4) END", pre=f", {sql.BASE}", filled=False, source="b")),
    "pt_price_ratio": (_feature("price_ratio", base=True), sql.feature("x / (base + 1e-10)", pre=f", {sql.BASE}", source="b")),
    "pt_detrend": (_feature("detrend", window=N), sql.feature(f"x - {_AVG}", filled=False)),
    "pt_zero_centre_scale": (_scaled(lambda d: scalers.zero_centre(d, ["x"])), f"WITH {sql.events()} SELECT series_id, event_id, {_S('x / max(abs(x)) OVER ()', 9)} AS y FROM s"),
    "pt_fixed_factor_scale": (_scaled(lambda d: scalers.FixedFactorScaler(["x"], 0.37).transform(d)), f"WITH {sql.events()} SELECT series_id, event_id, {_S('x * 0.37::DOUBLE', 9)} AS y FROM s"),
    "pt_fixed_factor_inverse": (_scaled(lambda d: scalers.FixedFactorScaler(["x"], 0.37).inverse(d)), f"WITH {sql.events()} SELECT series_id, event_id, {_S('x / 0.37::DOUBLE', 9)} AS y FROM s"),
    "roll_mean": (_feature("mean", True, window=N), sql.feature(_AVG, sql.MISSING)),
    "roll_std": (_feature("std", True, window=N), sql.feature(f"stddev_samp(x) OVER ({sql.frame(N)})", sql.MISSING)),
    "roll_std_shift": (_feature("std", window=N, shift=3), sql.feature(f"lag(sd, 3) OVER ({sql.W})", pre=f", v AS (SELECT *, stddev_samp(x) OVER ({sql.frame(N)}) AS sd FROM s)", source="v")),
    "roll_std_lead": (_feature("std", window=N, shift=-2), sql.feature(f"lead(sd, 2) OVER ({sql.W})", pre=f", v AS (SELECT *, stddev_samp(x) OVER ({sql.frame(N)}) AS sd FROM s)", source="v")),
    "roll_rsi": (_feature("rsi", digits=4, window=N), sql.feature(f"100 - 100 / (1 + avg(CASE WHEN d > 0 THEN d ELSE 0.0 END) OVER ({sql.frame(N)}) / (avg(CASE WHEN d < 0 THEN -d ELSE 0.0 END) OVER ({sql.frame(N)}) + 1e-10))", pre=_DIFF, source="d", digits=4)),
    "roll_lag_change": (_feature("lag_change", lag=3), sql.feature(f"x - lag(x, 3) OVER ({sql.W})")),
    "roll_zscore": (_feature("zscore", window=N), sql.feature(f"(x - {_AVG}) / (stddev_samp(x) OVER ({sql.frame(N)}) + 1e-10)")),
    "roll_slope": (_feature("slope", window=N), sql.feature(f"coalesce(CASE WHEN isnan(g) THEN NULL ELSE g END, 0.0)", pre=f", v AS (SELECT *, regr_slope(x, seq) OVER ({sql.frame(N)}) AS g FROM s)", source="v")),
    "roll_integral": (_feature("integral", True, window=N), sql.feature(f"sum(x) OVER ({sql.frame(N)})", sql.MISSING)),
    "roll_skew": (_feature("skew", window=N, digits=4), sql.feature(f"CASE WHEN count(x) OVER ({sql.frame(N)}) >= 3 AND max(x) OVER ({sql.frame(N)}) = min(x) OVER ({sql.frame(N)}) THEN 0.0 ELSE skewness(x) OVER ({sql.frame(N)}) END", digits=4)),
    "roll_autocorr": (_feature("autocorr", window=N), sql.feature(f"covar_pop(p, x) OVER ({sql.frame(N - 1)}) / nullif(stddev_pop(p) OVER ({sql.frame(N - 1)}) * stddev_pop(CASE WHEN p IS NOT NULL THEN x END) OVER ({sql.frame(N - 1)}), 0)", pre=f", v AS (SELECT *, lag(x) OVER ({sql.W}) AS p FROM s)", source="v")),
    "roll_future_change": (_feature("future_change", horizon=6), sql.feature(f"avg(x) OVER ({sql.W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)", filled=False)),
    "roll_future_change_from": (_feature("future_change", horizon=6, change=True), sql.feature(f"avg(x) OVER ({sql.W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) - x", filled=False)),
    "roll_future_change_vol": (_feature("future_change_vol", horizon=6), sql.feature(f"(avg(x) OVER ({sql.W} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) - x) / (1 + stddev_pop(x) OVER ({sql.W} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING))", filled=False)),
    "roll_entropy": (_feature("entropy", window=N, digits=4), sql.entropy(N)),
    "roll_fractal_dim": (_feature("fractal", window=N), sql.fractal(N)),
    "roll_long": (roll_long, f"WITH s AS (SELECT 0::BIGINT AS series_id, event_id, ts, value AS x FROM events), r AS (SELECT *, {_AVG} AS m, (x - {_AVG}) / (stddev_samp(x) OVER ({sql.frame(N)}) + 1e-10) AS z FROM s) SELECT series_id, event_id, {_S('m')} AS mean, {_S(sql.fb('z'))} AS zscore FROM r"),
    "roll_hurst": (_heavy("hurst", 32), sql.hurst(32)),
    "roll_fft": (_heavy("fft", N), sql.fft(N)),
    "roll_entropy_rate": (_heavy("entropy_rate", N), sql.entropy_rate(N)),
    "cal_day": (_calendar("day", "15m"), sql.calendar("day", 900_000)),
    "cal_week": (_calendar("week", "1h"), sql.calendar("week", 3_600_000)),
    "cal_month": (_calendar("month", "1ms"), sql.calendar("month", 1)),
    "cal_year": (_calendar("year", "1d"), sql.calendar("year", 86_400_000)),
    "win_centers": (win_centers, sql.sides(12, 6, "c.seq % 24 = 0 AND c.hour - 12 >= c.mn AND c.hour + 6 <= c.mx")),
    "win_batch_centers": (win_batch_centers, sql.sides(12, 6, "c.seq % 24 = 0 AND c.hour - 12 >= c.mn AND c.hour + 6 <= c.mx")),
    "win_transform": (win_transform, f"WITH {sql.events()}, p AS (SELECT series_id, event_id, seq, unnest(range(8)) AS pos FROM s) SELECT p.series_id, p.event_id, p.pos, {_S('coalesce(s.x, 0.0) * 0.5 + 1')} AS value FROM p LEFT JOIN s ON s.series_id = p.series_id AND s.seq = p.seq - 7 + p.pos"),
    "win_stacked": (win_stacked, sql.pairs([N], 1)),
    "win_dt_contiguous": (win_dt_contiguous, sql.sides(24, 6, "c.hour - back = 24 AND ahead - c.hour = 6 AND (c.seq - 24) % 5 = 0")),
    "win_dt_gapped": (win_dt_gapped, sql.sides(7, 3, "c.day - back = 7 AND ahead - c.day = 3 AND (c.seq - 7) % 2 = 0", sql.DAYS, "day")),
    "win_dt_restart": (win_dt_restart, sql.sides(7, 3, "c.day - back = 7 AND ahead - c.day = 3 AND (c.place - 7) % 2 = 0", sql.RUNS, "day")),
    "win_segments": (_positional("segments"), sql.sides(24, 6, "c.seq BETWEEN 24 AND c.n - 6 AND (c.seq - 24) % 30 = 0")),
    "win_continuous": (_positional("continuous-output-coverage"), sql.sides(24, 6, "c.seq BETWEEN 24 AND c.n - 6 AND (c.seq - 24) % 6 = 0")),
    "win_random": (_positional("random", 20), sql.random_windows(24, 6, 20, 42)),
    "win_pairs_next": (_pairs([N], True), sql.pairs([N], 1)),
    "win_pairs_same": (_pairs([N], False), sql.pairs([N], 0)),
    "win_multiscale": (_pairs([8, 12, 16], True), sql.pairs([8, 12, 16], 1)),
    "win_split": (win_split, f"WITH {sql.events()}, k AS (SELECT *, floor(count(*) OVER (PARTITION BY series_id) * 0.8) - 1 AS k FROM s) SELECT series_id, event_id, CASE WHEN seq < k THEN 'first' ELSE 'second' END AS part FROM k WHERE seq < k OR seq >= k + 2"),
    "win_collate_pad": (win_collate_pad, f"WITH {sql.events()}, n AS (SELECT series_id, count(*) AS n, max(count(*)) OVER (PARTITION BY series_id % 8) AS m FROM s GROUP BY 1), p AS (SELECT series_id, n, unnest(range(m)) AS pos FROM n) SELECT p.series_id, p.pos, coalesce(s.x, 0.0) AS value, p.pos >= n AS padded FROM p LEFT JOIN s ON s.series_id = p.series_id AND s.seq = p.pos"),
    "win_lookback_pad": (win_lookback_pad, f"WITH {sql.events()}, p AS (SELECT series_id, event_id, seq, unnest(range(8)) AS pos FROM s) SELECT p.series_id, p.event_id, p.pos, coalesce(s.x, 0.0) AS value FROM p LEFT JOIN s ON s.series_id = p.series_id AND s.seq = p.seq - 7 + p.pos"),
    "win_index_lookup": (win_index_lookup, f"WITH {sql.events()}, r AS (SELECT DISTINCT series_id, unnest(range(3)) AS range_id FROM s), q AS (SELECT *, 10 * range_id + series_id % 5 AS a FROM r) SELECT q.series_id, q.range_id, s.seq - a AS pos, s.x AS value FROM q JOIN s ON s.series_id = q.series_id AND s.seq BETWEEN a AND a + 7"),
    "seg_stochastic": (_segments("stochastic"), sql.partition_segments(6.0, 2.0, 42)),
    "seg_uniform": (_segments("uniform"), sql.drawn_segments(8, "uniform", 2, 10, 42)),
    "seg_normal": (_segments("normal"), sql.drawn_segments(8, "normal", 6.0, 2.0, 42)),
    "seg_random": (seg_random, sql.random_segments(4, 16, 3, 42)),
    "seg_lane_batches": (seg_lane_batches, None),
    "seg_epoch": (lambda s, d: trainers.epoch(tables.hourly_grid(s, d), [4, 8, 12], 16, 32, 4, 16, seed=42), None),
    "panel_epoch": (lambda s, d: trainers.lazy_epoch(tables.panel(s, d), ["feature"], "responder", [1, 2], 8, 32, 4, 12, 42), None),
    "panel_test_segment": (panel_test_segment, sql.panel_segment(2, 42)),
    "panel_lazy_sample": (panel_lazy_sample, sql.panel_sample(32, 2, 12, 42)),
    "kf_local_trend": (kf_local_trend, sql.kalman("value") + _KF_OUT),
    "kf_missing": (kf_missing, sql.kalman(sql.MISSING) + _KF_OUT),
    "kf_final": (kf_final, sql.kalman(sql.MISSING) + f" SELECT series_id, {_S('arg_max(l, seq)')} AS level, {_S('arg_max(v, seq)')} AS trend FROM k GROUP BY 1"),
    "kf_ukf": (kf_ukf, ukf.many(EVENT_TYPES)),
    "kf_robust_ukf": (_fold(lambda z, _: filters.robust_financial(z), True), ukf.robust()),
    "kf_enkf": (lambda s, d: filters.ensemble_filter(tables.event_series(s, d, 7)).drop("ts"), None),
    "kf_enkf_nl": (lambda s, d: filters.ensemble_filter(tables.event_series(s, d), model=filters.sine_drift).drop("ts"), None),
    "kf_particle": (lambda s, d: filters.particle_filter(tables.event_series(s, d, 7)).drop("ts"), None),
    "kf_particle_gbm": (lambda s, d: filters.particle_filter(tables.event_series(s, d), motion="gbm").drop("ts"), None),
    "syn_linear": (_closed(synthetic.linear(0.5, 2.0)), sql.closed("0.5 * t + 2.0")),
    "syn_quadratic": (_closed(synthetic.quadratic(0.1, -2.0, 3.0)), sql.closed("0.1::DOUBLE * t * t - 2.0 * t + 3.0")),
    "syn_exponential": (_closed(synthetic.exponential(1.01, 2.0)), sql.closed("2.0 * pow(1.01, t)")),
    "syn_logistic": (_closed(synthetic.logistic(0.1, 50.0, 3.0)), sql.closed("3.0 / (1 + exp(-0.1 * (t - 50.0)))")),
    "syn_sinusoidal": (_closed(synthetic.sinusoidal(2.0, 0.07, 0.3)), sql.closed("2.0 * sin(2 * pi() * 0.07 * t + 0.3)")),
    "syn_compound_sine": (_closed(synthetic.compound_sine([1.0, 0.5], [0.05, 0.13])), sql.closed("sin(2 * pi() * 0.05 * t) + 0.5 * sin(2 * pi() * 0.13 * t)")),
    "syn_damped": (_closed(synthetic.damped_oscillator(2.0, 0.02, 0.05)), sql.closed("2.0 * exp(-0.02 * t) * sin(2 * pi() * 0.05 * t)")),
    "syn_logistic_season": (_closed(synthetic.logistic_with_seasonality(0.1, 50.0, 3.0, 0.2, 0.1)), sql.closed("3.0 / (1 + exp(-0.1 * (t - 50.0))) + 0.2 * sin(2 * pi() * 0.1 * t)")),
    "syn_step": (_closed(synthetic.steps(200)), sql.closed("CASE WHEN seq < 50 THEN 1.0 WHEN seq < 100 THEN 2.0 WHEN seq < 150 THEN 3.0 ELSE 4.0 END")),
    "syn_noise": (lambda s, _: synthetic.normal_noise(s, 1000, 2.0, 42).withColumn("x", rounded(F.col("x"))), sql.noise(2.0, 1000, 42)),
    "syn_chaotic": (lambda s, _: synthetic.generated(s, 30, synthetic.chaotic_logistic()).select("seq", rounded(F.col("x")).alias("x")), f"WITH RECURSIVE k AS (SELECT 0::BIGINT AS seq, 0.5::DOUBLE AS x UNION ALL SELECT seq + 1, 3.9::DOUBLE * x * (1 - x) FROM k WHERE seq < 29) SELECT seq, {_S('x')} AS x FROM k"),
    "syn_nar": (lambda s, _: synthetic.generated(s, 500, synthetic.nonlinear_autoregressive(noise_level=0.05), series=4), None),
    "syn_brownian": (lambda s, _: synthetic.brownian(s, 1000, 1.0, 42).withColumn("x", rounded(F.col("x"))), sql.noise(1.0, 1000, 42, summed=True)),
    "syn_fbm": (lambda s, _: synthetic.generated(s, 512, lambda n, rng: synthetic.fractional_brownian(np.linspace(0.3, 0.8, n), rng), series=4), None),
    "syn_multifractal": (lambda s, _: synthetic.generated(s, 512, synthetic.multifractal, series=4), None),
    "syn_composite": (lambda s, _: synthetic.generated(s, 600, synthetic.challenging(5), synthetic.PARTS, 4), None),
    "kern_avg": (_kernel("avg"), sql.kernel("avg")),
    "kern_var": (_kernel("var"), sql.kernel("v2")),
    "kern_skew": (_kernel("skew"), sql.kernel("v3 / nullif(pow(v2, 1.5), 0)")),
    "kern_kurt": (_kernel("kurt"), sql.kernel("v4 / nullif(v2 * v2, 0)")),
    "kern_ewma": (_ewma("ewma"), f"{_EWMA} SELECT series_id, event_id, {_S('e')} AS y FROM k"),
    "kern_ewma_slope": (_ewma("ewma_slope"), f"{_EWMA} SELECT series_id, event_id, {_S('d')} AS y FROM k"),
    "kern_hurst": (_kernel_array(kernels.rescaled_hurst), sql.kernel_hurst()),
    "kern_dft": (_kernel_array(lambda a: kernels.dft_magnitude(a, 32.0, 3.0, 8.0, 1.5)), sql.kernel_dft(32.0, 3.0, 8.0, 1.5)),
    "kern_layer": (kern_layer, sql.layer(17.0, 3.0, 0.5, 32)),
    "loss_wmse_lin": (_loss(lambda: losses.weighted_mse(P("p"), Y("y"), LIN(T("t"), 8))), sql.loss("avg((0.1 + 0.9 * t / 7) * (p - y) * (p - y))")),
    "loss_wmse_exp": (_loss(lambda: losses.weighted_mse(P("p"), Y("y"), losses.exponential_weights(T("t"), 8))), sql.loss("avg(exp(t / 7) * (p - y) * (p - y))")),
    "loss_wmse_first": (_loss(lambda: losses.weighted_mse(P("p"), Y("y"), FIRST(T("t"), 8))), sql.loss("avg(CASE WHEN t = 0 THEN 1.0 ELSE exp((t - 1) / 6) END * (p - y) * (p - y))")),
    "loss_sign": (_loss(lambda: losses.penalised_sign(F.col("p") / 100, F.col("y") / 100, F.col("p") - 100, F.col("y") - 100)), sql.loss("avg((p / 100 - y / 100) * (p / 100 - y / 100)) + avg(CASE WHEN sign(p - 100) <> sign(y - 100) THEN 10 * abs((y - 100) - (p - 100)) ELSE 0.0 END)")),
    "loss_mape": (_loss(lambda: losses.mape(P("p"), Y("y"))), sql.loss("100 * avg(coalesce(abs(y - p) / nullif(abs(y), 0), 0))")),
    "loss_mae": (_loss(lambda: losses.mae(P("p"), Y("y"))), sql.loss("avg(abs(p - y))")),
    "loss_quantile": (_loss(lambda: losses.quantile({q: F.col("p") * (0.5 + q) for q in (0.1, 0.5, 0.9)}, Y("y"))), sql.loss("(" + " + ".join(f"avg(CASE WHEN y - p * {0.5 + q} >= 0 THEN {q} * (y - p * {0.5 + q}) ELSE ({q} - 1) * (y - p * {0.5 + q}) END)" for q in (0.1, 0.5, 0.9)) + ") / 3")),
    "loss_early_stop": (loss_early_stop, sql.EARLY_STOP),
    "nn_pos_encoding": (nn_pos_encoding, f"SELECT p.range AS pos, d.range AS dim, {_S('CASE WHEN d.range % 2 = 0 THEN sin(p.range * exp(-(d.range - d.range % 2) * ln(10000.0) / 16)) ELSE cos(p.range * exp(-(d.range - d.range % 2) * ln(10000.0) / 16)) END')} AS value FROM range(50) p, range(16) d"),
    "nn_mlp": (_score(models.mlp, MLP, (16, 4)), nets.mlp(MLP)),
    "nn_lstm": (_score(lambda w, x: models.stateful_lstm(w, x)[0], LSTM, (16, 4)), nets.max_lstm(LSTM, 4)),
    "nn_lstm_attention": (_score(lambda w, x: models.stateful_lstm(w, x, "attention")[0], ATTENTION, (16, 4)), nets.attention_lstm(ATTENTION, 4)),
    "nn_cnn_lstm": (_score(lambda w, x: models.cnn_lstm(w, x)[0], CNN, (16, 4)), nets.cnn_lstm(CNN, 4, False)),
    "nn_cnn_lstm_pool": (_score(lambda w, x: models.cnn_lstm(w, x, True)[0], POOLED, (16, 4)), nets.cnn_lstm(POOLED, 4, True)),
    "nn_transformer": (_score(models.transformer, TRANSFORMER, (16, 4)), nets.transformer(TRANSFORMER, 4, 16, 4, 16)),
    "nn_decoder": (_score(models.decoder, DECODER, (16, 4)), nets.decoder(DECODER, 4, 16, 4)),
    "nn_convlstm": (_score(lambda w, x: models.conv_lstm(w, x)[0][0], CONV, (4, 1, 4, 4)), nets.conv_lstm(CONV, 1, 4, 4)),
    "nn_dflstm": (_featured(lambda w, x: models.stateful_lstm(w, x)[0], DFLSTM), nets.max_lstm(DFLSTM, 3, **nets.featured(8.0, 3.0, 0.3, 32, 16))),
    "nn_dfdnn": (_featured(models.mlp, DFDNN), nets.mlp(DFDNN, **nets.featured(8.0, 3.0, 0.3, 32, 16))),
    "stream_kalman": (_stream(online.kalman), sql.kalman("value") + f" SELECT s.series_id, s.event_id, {_S('k.l')} AS y FROM s JOIN k ON s.series_id = k.series_id AND s.seq = k.seq"),
    "stream_ewma": (_stream(lambda s: online.ewma(s, 1 / 3)), f"{_EWMA} SELECT series_id, event_id, {_S('e')} AS y FROM k"),
    "stream_rolling_mean": (_stream(lambda s: online.rolling_mean(s, N)), f"WITH {sql.events()} SELECT series_id, event_id, {_S(_AVG)} AS y FROM s"),
    "stream_tumbling": (stream_tumbling, sql.TUMBLING),
}


def _rounded_stream(q: Query) -> Query:
    return lambda spark, sf_dir: q(spark, sf_dir).select("series_id", "event_id", rounded(F.col("y")).alias("y"))


for _name in ("stream_kalman", "stream_ewma", "stream_rolling_mean"):
    CATALOGUE[_name] = (_rounded_stream(CATALOGUE[_name][0]), CATALOGUE[_name][1])


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in CATALOGUE.items() if s}
