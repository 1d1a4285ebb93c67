"""Features against pandas and numpy definitions, with gaps, constants, one row and no rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import filters, heavy, kernels
from chronoloom.operators.rolling import Feature, rolling

SCHEMA = "series_id long, ts timestamp_ntz, event_id long, x double"


def series(spark, *values):
    day = pd.Timestamp("2024-01-01")
    rows = [(k, (day + pd.Timedelta(hours=i)).to_pydatetime(), i, None if v is None else float(v)) for k, vs in enumerate(values) for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, SCHEMA)


def column(df, name, key=0):
    return df.filter(f"series_id = {key}").orderBy("event_id").toPandas()[name].to_numpy(float)


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=80).cumsum() + 50
    gaps = [None if i in (0, 1, 13, 40, 79) else float(v) for i, v in enumerate(x)]
    return list(map(float, x)), gaps


def test_against_pandas(spark, walk):
    full, gaps = walk
    made = rolling(series(spark, full, gaps), [Feature("mean", args={"window": 9}), Feature("std", args={"window": 9}), Feature("std", "shifted", {"window": 9, "shift": 2}), Feature("skew", args={"window": 9}), Feature("integral", args={"window": 9}), Feature("zscore", args={"window": 9}), Feature("autocorr", args={"window": 9, "lag": 2})]).cache()
    for key, values in enumerate((full, gaps)):
        s = pd.Series(values, dtype=float)
        r = s.rolling(9, min_periods=1)
        fill = lambda v: v.ffill().bfill().to_numpy()
        np.testing.assert_allclose(column(made, "mean", key), fill(r.mean()), rtol=1e-9)
        np.testing.assert_allclose(column(made, "std", key), fill(r.std()), rtol=1e-7)
        np.testing.assert_allclose(column(made, "shifted", key), fill(r.std().shift(2)), rtol=1e-7)
        np.testing.assert_allclose(column(made, "skew", key), fill(r.skew()), rtol=1e-5, atol=1e-7)
        np.testing.assert_allclose(column(made, "integral", key), fill(r.sum()), rtol=1e-9)
        np.testing.assert_allclose(column(made, "zscore", key), fill((s - r.mean()) / (r.std() + 1e-10)), rtol=1e-6, atol=1e-9)
    s = pd.Series(full)
    want = s.rolling(9, min_periods=3).apply(lambda w: pd.Series(w.to_numpy()).autocorr(2) if len(w) > 3 else np.nan).ffill().bfill()
    np.testing.assert_allclose(column(made, "autocorr")[4:], want.to_numpy()[4:], rtol=1e-6, atol=1e-9)


def test_log_relative_of_zero_and_below(spark):
    """As numpy has it: -infinity for a ratio of 0; missing for a negative one, a missing value and the first row."""
    made = rolling(series(spark, [2.0, 0.0, 3.0, None, 4.0, -1.0, 5.0]).selectExpr("*", "lag(x) over (partition by series_id order by event_id) as base"), [Feature("log_relative", args={"base": "base"})])
    want = [np.nan, -np.inf, np.log(3 / 1e-4), np.nan, np.nan, np.nan, np.nan]
    np.testing.assert_allclose(column(made, "log_relative"), want, rtol=1e-12)


def test_edges(spark):
    kinds = [Feature("mean", args={"window": 4}), Feature("rsi", args={"window": 4}), Feature("slope", args={"window": 4}), Feature("skew", args={"window": 4}), Feature("autocorr", args={"window": 4}), Feature("entropy", args={"window": 4}), Feature("fractal", args={"window": 4}), Feature("future_change", args={"horizon": 3}), Feature("detrend", args={"window": 4}), Feature("log_returns")]
    made = rolling(series(spark, [5.0], [3.0] * 6, [None] * 3), kinds)
    one = made.filter("series_id = 0").first()
    assert one["mean"] == 5 and one["slope"] == 0 and one["future_change"] is None and one["log_returns"] == 0
    constant = column(made, "skew", 1)
    assert (constant == 0).all() and (column(made, "entropy", 1) == 0).all() and (column(made, "slope", 1) == 0).all()
    assert np.isnan(column(made, "mean", 2)).all() and np.isnan(column(made, "autocorr", 1)).all()
    assert rolling(series(spark, []), kinds).count() == 0
    with pytest.raises(ValueError):
        rolling(series(spark, [1.0]), [Feature("future_change", args={"horizon": 1})])


def test_rsi_bounds_and_histograms(spark, walk):
    made = rolling(series(spark, walk[0]), [Feature("rsi", args={"window": 7}), Feature("entropy", args={"window": 20}), Feature("fractal", args={"window": 20})])
    rsi = column(made, "rsi")
    assert ((rsi >= 0) & (rsi <= 100)).all()
    x = np.array(walk[0])

    def entropy(w):
        if w.min() == w.max():
            return 0.0
        h = np.histogram(w, 10, density=True)[0]
        h = h[h > 0]
        return -(h * np.log2(h + 1e-10)).sum()

    def dimension(w):
        if len(w) < 4:
            return 1.0
        counts = [(np.histogram(w, np.arange(w.min(), w.max() + s, s))[0] > 0).sum() for s in (2, 4, 8)]
        if min(counts) == 0:
            return np.nan
        return 1.0 if len(set(counts)) == 1 else np.polyfit(np.log(1 / np.array([2, 4, 8])), np.log(counts), 1)[0]

    windows = [x[max(0, i - 19) : i + 1] for i in range(len(x))]
    np.testing.assert_allclose(column(made, "entropy"), [entropy(w) for w in windows], rtol=1e-9)
    np.testing.assert_allclose(column(made, "fractal"), pd.Series([dimension(w) for w in windows]).ffill().bfill(), rtol=1e-9)


def test_heavy(spark, walk):
    made = heavy.heavy(series(spark, walk[0], walk[1], [2.0] * 40), ["fft", "hurst", "entropy_rate"], 32)
    x = np.array(walk[0])
    last = x[-32:]
    assert column(made, "fft")[-1] == pytest.approx(np.abs(np.fft.fft(np.hanning(32) * last)[1:16]).sum())
    lags = np.arange(2, 16)
    ratio = [np.ptp(d) / d.std() for d in (last[k:] - last[:-k] for k in lags)]
    assert column(made, "hurst")[-1] == pytest.approx(np.polyfit(np.log(lags), np.log(ratio), 1)[0])
    assert not np.isnan(column(made, "hurst", 1)).any()
    assert (column(made, "hurst", 2) == 0.5).all() and column(made, "fft", 2)[-1] < 20
    joint = np.histogram2d(last[:-1], last[1:], bins=10, density=True)[0] + 1e-10
    past = np.histogram(last[:-1], bins=10, density=True)[0] + 1e-10
    assert column(made, "entropy_rate")[-1] == pytest.approx(-(joint * np.log2(joint / past[None, :])).sum())


def test_kernels(spark, walk):
    made = kernels.moments(series(spark, walk[0], walk[1]), 10.0, 3.0, 32)
    x = np.array(walk[0])
    a = x[-32:]
    w = 3.0 ** -((3 * np.arange(31, -1, -1) / 10) ** 3)
    w /= w.sum() + 1e-8
    m = (a * w).sum()
    v = ((a - m) ** 2 * w).sum()
    assert column(made, "kern_avg")[-1] == pytest.approx(m)
    assert column(made, "kern_var")[-1] == pytest.approx(v)
    assert column(made, "kern_kurt")[-1] == pytest.approx(((a - m) ** 4 * w).sum() / v**2)
    assert column(made, "kern_avg")[0] == x[0] and np.isnan(column(made, "kern_skew")[0])
    assert np.isnan(column(made, "kern_avg", 1)[14])  # a gap in the frame
    e, got = x[0], column(kernels.ewma(series(spark, walk[0]), 0.3), "ewma")
    for i, v in enumerate(x):
        e = v if i == 0 else 0.7 * e + 0.3 * v
        assert got[i] == pytest.approx(e, rel=1e-12)
    assert kernels.rescaled_hurst(x) == pytest.approx(kernels.rescaled_hurst(x + 0.0))
    assert kernels.dft_magnitude(np.ones(1), 4, 3, 2, 1) == 0.0
    layer = kernels.feature_layer(series(spark, walk[0]), [kernels.FeatureConfig("a", "avg", {"window_size": kernels.Parameter(2, 10)}), kernels.FeatureConfig("h", "dft", {"window_size": 8.0, "gamma": 3.0, "center_period": 4.0, "frequency_smoothness": 1.0})])
    a = column(layer, "a")
    assert layer.columns[-2:] == ["a", "h"] and abs(a.mean()) < 1e-9 and a.std() == pytest.approx(1, abs=1e-3)
    with pytest.raises(KeyError):
        kernels.FeatureConfig("a", "avg", {}).get("window_size")


def test_closed_form_ukf_equals_sigma_points():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(60, 1)).cumsum(0) + 10
    z[[5, 20, 21]] = np.nan
    got = filters.robust_ukf(z)[:, 0]
    # sigma points, with the rows of the Cholesky factor as offsets
    d, alpha, beta = 4, 1e-1, 2.0
    lam = alpha**2 * d - d
    wm = np.full(2 * d + 1, 1 / (2 * (d + lam)))
    wc = wm.copy()
    wm[0], wc[0] = lam / (d + lam), lam / (d + lam) + 1 - alpha**2 + beta
    x, p = np.array([z[0, 0], 0, 0.1, z[0, 0]]), np.diag(filters.P4)
    want = []
    for (v,) in z:
        u = np.linalg.cholesky((d + lam) * p)
        chi = np.array([filters.process_function(s) for s in [x, *(x + u), *(x - u)]])
        mean = wm @ chi
        e = chi - mean
        spread = e.T @ np.diag(wc) @ e
        x, p = mean, spread + np.diag(filters.Q4)
        if not np.isnan(v):
            gain = spread[:, 0] / (spread[0, 0] + 0.1)
            x, p = x + gain * (v - mean[0]), p - np.outer(gain, gain) * (spread[0, 0] + 0.1)
        want.append(x[0])
    np.testing.assert_allclose(got, want, rtol=1e-5)


def test_filters(spark, walk):
    full, gaps = walk
    level = column(filters.kalman(series(spark, full, gaps, [None] * 3)), "level", 1)
    assert not np.isnan(level).any()
    end = filters.local_trend(np.array([1.0, 2.0, 3.0, np.nan, np.nan, np.nan]))
    assert end[5] - end[4] == pytest.approx(end[4] - end[3])  # without values it goes straight on
    assert (filters.robust_financial(np.array([np.nan, 0.0])) == 0).all()
    assert filters.robust_financial(np.array([2.0, np.nan, 2.0]))[0] == 2
    assert len(filters.robust_financial(np.array(full))) == len(full)
    for f in (filters.ensemble_filter, filters.particle_filter):
        a, b = column(f(series(spark, full)), "level"), column(f(series(spark, full)), "level")
        assert (a == b).all() and np.abs(a[20:] - np.array(full)[20:]).mean() < 8
    points = filters.sobol(64, 3, np.random.default_rng(0))
    assert np.histogram(points[:, 2], 8, (0, 1))[0].tolist() == [8] * 8
    many = filters.robust_ukf(np.array([[1.0, 5.0], [np.nan, 5.5], [1.2, np.nan], [1.1, 5.2]]))
    assert many.shape == (4, 2) and not np.isnan(many).any()
    with pytest.raises(ValueError):
        filters.robust_ukf(np.ones(3))


def test_long_series_in_chunks(spark, walk):
    from chronoloom.operators.long_series import numbered, rolling_long

    kinds = [Feature("mean", args={"window": 5}), Feature("std", args={"window": 5, "shift": 2}), Feature("slope", args={"window": 6}), Feature("autocorr", args={"window": 6, "lag": 2}), Feature("lag_change", args={"lag": 3})]
    holes = [v if i < 20 or i > 45 else None for i, v in enumerate(walk[0])]
    df = series(spark, walk[0], walk[1], holes)
    placed = numbered(df, 7 * 3_600_000)
    assert [r.seq for r in placed.filter("series_id = 1").orderBy("event_id").collect()] == list(range(80))
    want, got = rolling(df, kinds), rolling_long(placed, kinds, 10, 16)
    for key in range(3):
        for f in kinds:
            np.testing.assert_allclose(column(got, f.alias, key), column(want, f.alias, key), rtol=1e-9, atol=1e-9)
    with pytest.raises(ValueError):
        rolling_long(placed, [Feature("future_change", args={"horizon": 3})], 10)


def test_long_series_ahead_and_in_numpy(spark, walk):
    """Features that look ahead, detrended ones, numpy's and kernels', chunk by chunk, with gaps longer than a chunk."""
    from chronoloom.operators.long_series import heavy_long, in_chunks, numbered, rolling_long

    kinds = [
        Feature("future_change", args={"horizon": 4}), Feature("future_change_vol", args={"horizon": 5}), Feature("detrend", args={"window": 5}),
        Feature("std", args={"window": 5, "shift": -3}), Feature("zscore", args={"window": 4}),
    ]
    holes = [v if i < 20 or i > 45 else None for i, v in enumerate(walk[0])]
    df = series(spark, walk[0], walk[1], holes, [None] * 30 + walk[0][:40])
    placed = numbered(df, 7 * 3_600_000)
    for want, got, names in (
        (rolling(df, kinds), rolling_long(placed, kinds, 10, 16, ahead=5), [f.alias for f in kinds]),
        (heavy.heavy(df, ["fft", "entropy_rate"], 12), heavy_long(placed, ["fft", "entropy_rate"], 12, 16).withColumn("event_id", F.col("seq")), ["fft", "entropy_rate"]),
        (kernels.moments(df, 10.0, 3.0, 12), in_chunks(placed, lambda d, s: kernels.moments(d, 10.0, 3.0, 12, s), 11, 0, 16), ["kern_avg", "kern_var"]),
    ):
        for key in range(4):
            for name in names:
                np.testing.assert_allclose(column(got, name, key), column(want, name, key), rtol=1e-9, atol=1e-9)
    with pytest.raises(ValueError, match="longer than a chunk"):
        rolling_long(placed, kinds, 100, 16, ahead=5)


def test_fill_is_linear_in_the_length_of_a_series(spark):
    """One series of 40,000 rows: filling takes no more than twice the time of not filling, give or take a second."""
    import time

    from pyspark.sql import functions as F

    one = spark.range(40_000).select(F.lit(0).cast("long").alias("series_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), F.col("id").alias("event_id"), F.when(F.col("id") % 3 > 0, F.rand(1)).alias("x"))
    one = one.repartition(4).cache()
    one.count()

    def seconds(fill):
        best = []
        for _ in range(3):
            began = time.time()
            rolling(one, [Feature("mean", args={"window": 12})], fill=fill).write.format("noop").mode("overwrite").save()
            best.append(time.time() - began)
        return min(best)

    assert seconds(True) <= 2 * seconds(False) + 1


def test_random_filters():
    """On a linear model the ensemble and the particles come near the exact filter; gaps only move them; both repeat with their seed."""
    rng = np.random.default_rng(7)
    z = rng.normal(0, 0.3, 300).cumsum() + rng.normal(0, 0.7, 300)
    z[50:55] = np.nan
    exact = filters.Kalman([filters.first_value(z), 0.0], np.eye(2), np.eye(2), np.diag([0.1, 0.01]), [[1.0, 0.0]], [[0.5]]).run(z)
    run = lambda seed, model=None: filters.ensemble(z, np.random.default_rng(seed), np.array([filters.first_value(z), 0.0]), np.eye(2), np.diag([0.1, 0.01]), [[0.5]], 2000, model)[:, 0]
    assert np.abs(run(0) - exact).mean() < 0.05 and (run(1) == run(1)).all()
    assert np.abs(run(0, lambda s: s) - exact).mean() < 0.05 and np.abs(run(0, filters.sine_drift) - exact).mean() > 0.05
    walk = filters.Kalman([0.0], [[25.0]], [[1.0]], [[0.09]], [[1.0]], [[0.49]]).run(z)
    made = lambda seed, motion: filters.Particles(4000, [(-10.0, 10.0)], 0.3, 0.7, np.random.default_rng(seed), motion).run(z)[:, 0]
    assert np.abs(made(0, "walk")[5:] - walk[5:]).mean() < 0.05 and (made(2, "walk") == made(2, "walk")).all()
    prices = 50 * np.exp(rng.normal(0.01, 0.1, 200).cumsum())
    levels = filters.Particles(4000, [(20.0, 80.0)], 0.3, 0.7, np.random.default_rng(0), "gbm").run(prices)[:, 0]
    assert np.abs(levels[5:] / prices[5:] - 1).mean() < 0.05


def test_ukf_layouts():
    """Variable-major, every dimension is a filter of its own but for the common scale; the literal layout mixes their noise."""
    rng = np.random.default_rng(8)
    z = rng.normal(size=(40, 3)).cumsum(0) + np.array([10.0, 20.0, 40.0])
    z[rng.random(z.shape) < 0.2] = np.nan
    first = np.array([filters.first_value(z[:, j]) for j in range(3)])
    got = filters.robust_ukf(z)
    for j in range(3):
        one = filters.FinancialUKF(first[j : j + 1])
        for name in "pqr":
            setattr(one, name, getattr(one, name) * first.std())
        np.testing.assert_allclose(got[:, j], [one.step(row[j : j + 1])[0] for row in z], rtol=1e-9)
    assert np.abs(filters.robust_ukf(z, literal=True) - got).max() > 1e-3
    np.testing.assert_allclose(filters.robust_ukf(z[:, :1], literal=True), filters.robust_ukf(z[:, :1]))


def test_kernel_arrays_by_length(spark, walk):
    """Whole windows in blocks give what each window gives alone."""
    f = {"h": kernels.rescaled_hurst, "d": lambda a: kernels.dft_magnitude(a, 16.0, 3.0, 8.0, 1.5)}
    made = kernels.array_features(series(spark, walk[0]), f, 20)
    x = np.array(walk[0])
    for k, g in f.items():
        np.testing.assert_allclose(column(made, k), [float(g(x[max(0, i - 19) : i + 1])) for i in range(len(x))], rtol=1e-9)


def test_series_across_arrow_batches(spark):
    """Series longer and shorter than a batch, one of them without a key: each is computed whole, in order."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import DoubleType

    from chronoloom.operators.series import EVENTS, over_series

    rows = spark.range(200).select(F.when(F.col("id") % 5 > 0, F.when(F.col("id") < 60, F.col("id") % 5).otherwise(1)).alias("series_id"), F.timestamp_seconds(F.lit(1000) - F.col("id")).cast("timestamp_ntz").alias("ts"), F.col("id").alias("event_id"), F.col("id").cast("double").alias("x"))
    schema = rows.withColumn("total", F.lit(0.0)).schema
    assert schema["total"].dataType == DoubleType()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = over_series(rows, schema, lambda key, pdf: {"total": pdf["x"].cumsum().to_numpy(float)}, EVENTS).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = rows.toPandas().sort_values("ts")
    want["total"] = want.groupby("series_id", dropna=False)["x"].cumsum()
    key = lambda d: d.sort_values("event_id")["total"].tolist()
    assert key(got) == key(want) and len(got) == 200
