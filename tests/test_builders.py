"""Windows, segments, batches, sources, models, losses, scalers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import calendar, losses
from chronoloom.operators import models, panel, scalers, segments, stopping, windows
from chronoloom.sources import synthetic
from tests.test_features import series


def test_collate_masks(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (0, [4.0]), (1, [5.0])], "batch int, x_window array<double>")
    out = {tuple(r.x_window): r.padded for r in windows.collate(df, ("batch",)).collect()}
    assert out == {(1, 2, 3): [False] * 3, (4, 0, 0): [False, True, True], (5,): [False]}
    with pytest.raises(Exception, match="differ"):
        windows.equal_lengths(df).collect()
    assert windows.equal_lengths(df.filter("size(x_window) = 1")).count() == 2


def test_windows_skip_gaps_and_ends(spark):
    df = series(spark, list(range(12))).filter("event_id <> 6")
    out = windows.contiguous(df, 2, 2, 1, 3_600_000).orderBy("event_id").collect()
    assert [r.event_id for r in out] == [2, 3, 9]  # 4 and 5 look ahead over the gap, 7 and 8 back
    assert out[0].x_window == [0, 1] and out[0].y_window == [2, 3]
    centers = spark.createDataFrame([(0, pd.Timestamp("2024-01-01 04:00").to_pydatetime()), (0, pd.Timestamp("2024-01-01 00:30").to_pydatetime())], "series_id long, center timestamp_ntz")
    got = windows.by_centers(series(spark, list(range(12))), centers, 2 * 3_600_000, 3_600_000).orderBy("side", "pos").collect()
    assert [(r.side, r.value) for r in got] == [("x", 2.0), ("x", 3.0), ("y", 4.0)]
    with pytest.raises(ValueError):
        windows.positional(df, 2, 2, "other")
    drawn = windows.positional(df, 2, 2, "random", 50, 1).collect()
    assert len(drawn) == 50 and all(len(r.x_window) == 2 and len(r.y_window) == 2 for r in drawn)


def test_split_counts_from_the_end_when_negative(spark):
    got = [r.part for r in windows.split(series(spark, [1, 2, 3]), 0.3).orderBy("event_id").collect()]
    n, k = 3, int(3 * 0.3) - 1
    assert got == ["second" if i >= n + k else "first" for i in range(n)]


def test_segments_partition_and_schedule(spark):
    items = spark.range(100).select(F.lit(1).alias("series_id"), F.col("id").alias("item"), F.array(F.col("id").cast("double")).alias("x_window"))
    cut = segments.partitioned(items, ("series_id",), 7.0, 3.0, 5).collect()
    assert sorted(r.item for r in cut) == list(range(100))
    drawn = segments.drawn(items, ("series_id",), 20, "normal", 5.0, 2.0, 5).toPandas()
    assert drawn.groupby("seg_id")["item"].apply(lambda s: np.ptp(s) == len(s) - 1).all()
    sizes = pd.DataFrame([(f"s{i}", 4 + 4 * (i % 3), 1 + i % 5) for i in range(17)], columns=["seg_key", "lookback", "n_items"])
    for shuffle in (False, True):
        plan = segments.schedule(sizes, 4, shuffle, 3)
        assert not plan.duplicated(["seg_key", "item_no"]).any() and len(plan) == sizes["n_items"].sum()
        for _, batch in plan.groupby("batch_no"):
            assert len(batch) <= 4 and batch["seg_key"].is_unique and sorted(batch["sort_pos"]) == list(range(len(batch)))
            assert batch.sort_values("sort_pos")["lookback"].is_monotonic_decreasing
        last = plan.sort_values("item_no").groupby("seg_key").tail(1)
        assert (last["connected"] == 0).all() and plan["connected"].sum() == len(plan) - len(sizes)
        steps = plan.sort_values(["seg_key", "item_no"]).groupby("seg_key")["batch_no"].diff().dropna()
        assert (steps == 1).all()
    full = items.select(F.concat_ws("/", F.floor(F.col("item") / 10)).alias("seg_key"), F.lit(1).alias("lookback"), (F.col("item") % 10).alias("item_no"), "x_window")
    assert segments.batches(full, 3).count() == 100


def test_nearest_fill():
    a = np.array([[1.0, 10.0], [1.1, np.nan], [5.0, 50.0], [0.9, 12.0]])
    assert panel.nearest_fill(a)[1, 1] == 11.0
    assert (panel.nearest_fill(np.array([[np.nan, 1.0], [np.nan, 2.0]]))[:, 0] == 0).all()


def test_calendar(spark):
    df = spark.createDataFrame([(pd.Timestamp("2024-02-29 12:34:56.789").to_pydatetime(),), (None,)], "ts timestamp_ntz")
    for period in ("day", "week", "month", "year"):
        c, s = calendar.cyclic(F.col("ts"), period, "15m")
        r = df.select(c.alias("c"), s.alias("s"), calendar.length_ms(F.col("ts"), period).alias("n")).collect()
        assert r[0].c ** 2 + r[0].s ** 2 == pytest.approx(1)
    assert df.select(calendar.length_ms(F.col("ts"), "month").alias("n")).first().n == 29 * 86_400_000
    assert df.select(calendar.length_ms(F.col("ts"), "year").alias("n")).first().n == 366 * 86_400_000
    assert df.select(calendar.offset_ms(F.col("ts"), "day", "15m").alias("n")).first().n == (12 * 4 + 2) * 900_000
    with pytest.raises(ValueError):
        calendar.length_ms(F.col("ts"), "decade")


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, -4.0), (2.0, None)], "a double, b double")
    model = scalers.ZeroCentreScaler(["a", "b"]).fit(df)
    assert model.scale == 4 and [r.a for r in model.transform(df).collect()] == [0.25, 0.5]
    assert [r.a for r in scalers.zero_centre(df, ["a", "b"]).collect()] == [0.25, 0.5]
    with pytest.raises(ValueError):
        scalers.ZeroCentreModel(["a"]).transform(df)
    fixed = scalers.FixedFactorScaler(["a"], 3.0)
    assert [r.a for r in fixed.inverse(fixed.transform(df)).collect()] == [1.0, 2.0]
    assert scalers.standardise(df, ["a"]).agg(F.stddev("a")).first()[0] == pytest.approx(1)
    assert [r.a_hot for r in scalers.one_hot(df, "a", [1.0, 2.0]).collect()] == [[1, 0], [0, 1]]


def test_losses_and_stopping(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (1, 2.0, 4.0)], "t long, p double, y double")
    p, y, t = F.col("p"), F.col("y"), F.col("t")
    got = df.agg(losses.mape(p, y).alias("a"), losses.mae(p, y).alias("b"), losses.quantile({0.5: p}, y).alias("c"), losses.weighted_mse(p, y, losses.linear_weights(t, 2)).alias("d")).first()
    assert tuple(got) == pytest.approx((25.0, 1.5, 0.75, (0.1 * 1 + 1.0 * 4) / 2))
    assert losses.linear_weight_array(1) == [0.1] and losses.exponential_weight_array(2)[1] == pytest.approx(math.e)
    with pytest.raises(ValueError):
        losses.quantile({1.5: p}, y)
    values = [5.0, 4.0, 4.2, 4.6, 4.7, 3.0, 9.0]
    stopper, at = stopping.EarlyStopper(2, 0.5), None
    for i, v in enumerate(values):
        if stopper.early_stop(v):
            at = i
            break
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "series_id long, seq long, loss double")
    r = stopping.stop_points(rows, patience=2, min_delta=0.5).first()
    assert r.stopped_at == at == 4 and r.best == 4.0


def test_synthetic(spark):
    same = lambda f: synthetic.generated(spark, 300, f, synthetic.PARTS, 2, 7).orderBy("series_id", "seq").toPandas()
    a, b = same(synthetic.challenging(5)), same(synthetic.challenging(5))
    assert a.equals(b) and a["hurst"].between(0.1, 0.9).all() and (a["volatility"] > 0).all() and not a.isna().any().any()
    rng = np.random.default_rng(0)
    smooth = np.concatenate([synthetic.fractional_noise(512, 0.9, rng) for _ in range(20)])
    rough = np.concatenate([synthetic.fractional_noise(512, 0.1, rng) for _ in range(20)])
    lag1 = lambda x: np.corrcoef(x[1:], x[:-1])[0, 1]
    assert lag1(smooth) == pytest.approx(2 ** (2 * 0.9 - 1) - 1, abs=0.1) and lag1(rough) == pytest.approx(2 ** (2 * 0.1 - 1) - 1, abs=0.1)
    walk = synthetic.brownian(spark, 500, 2.0, 1, block=64).orderBy("seq").toPandas()["x"].to_numpy()
    steps = synthetic.normal_noise(spark, 500, 2.0, 1).orderBy("seq").toPandas()["x"].to_numpy()
    np.testing.assert_allclose(walk, steps.cumsum(), rtol=1e-9)
    with pytest.raises(ValueError):
        synthetic.fractional_brownian(np.array([0.5, 1.0]), rng)
    assert np.isfinite(synthetic.multifractal(100, rng)).all()


def test_varying_exponent():
    """The noise is rough where the exponent is low and smooth where it is high, of variance 1, and scales."""
    rng = np.random.default_rng(3)
    x = np.stack([synthetic.fractional_brownian(np.linspace(0.2, 0.8, 512), rng) for _ in range(300)])
    near = lambda at: (x[:, at : at + 59] * x[:, at + 1 : at + 60]).mean()
    for at in (0, 226, 452):
        h = 0.2 + 0.6 * (at + 30) / 511
        assert near(at) == pytest.approx(2 ** (2 * h - 1) - 1, abs=0.05)
    assert x.var() == pytest.approx(1, abs=0.05)
    same = lambda **o: synthetic.fractional_brownian(np.full(64, 0.7), np.random.default_rng(1), **o)
    np.testing.assert_allclose(same(scale=3.0), 3 * same())
    np.testing.assert_allclose(same(walk=True), same().cumsum())
    assert len(synthetic.fractional_brownian(np.zeros(0), rng)) == 0


def test_composite_parts():
    rng = np.random.default_rng(4)
    for level in range(1, 6):
        d = synthetic.challenging(level, noise_level=0.0)(4000, rng)
        assert tuple(d) == synthetic.PARTS
        np.testing.assert_allclose(d["x"], sum(d[k] for k in ("base_dynamics", "fractal_noise", "trend", "nonlinear_ar", "jumps", "lrd_noise")))
        assert set(d["regime"]) == set(range(min(4, level + 1)))
        assert [bool(np.any(d[k])) for k in ("nonlinear_ar", "jumps", "lrd_noise")] == [level >= 2, level >= 4, level >= 5]
        assert (d["volatility"] == 1).all() == (level < 3)
    changes = np.flatnonzero(np.diff(d["regime"])) + 1
    assert 4000 / 60 / 2 < len(changes) < 4000 / 60 * 2
    logs = np.log(d["volatility"])
    assert np.corrcoef(logs[1:], logs[:-1])[0, 1] > 0.9


def test_models(spark):
    x = np.random.default_rng(0).normal(size=(3, 16, 4))
    w = models.stateful_lstm_weights(4, 8, 2, 2, True, "attention")
    assert models.stateful_lstm(w, x, "attention")[0].shape == (3, 2, 1)
    w = models.stateful_lstm_weights(4, 8, 2)
    whole, _ = models.stateful_lstm(w, x, "last")
    _, state = models.stateful_lstm(w, x[:, :9], "last")
    np.testing.assert_allclose(models.stateful_lstm(w, x[:, 9:], "last", state=state)[0], whole)  # carried state
    short, _ = models.lstm(w, "lstm", x, np.array([16, 5, 16]))
    np.testing.assert_allclose(short[1, :5], models.lstm(w, "lstm", x[1:2, :5])[0][0])
    assert (short[1, 5:] == 0).all()
    assert models.mlp(models.mlp_weights(64, 0.5, 2, 3), x).shape == (3, 3, 1)
    for pooling in (False, True):
        assert models.cnn_lstm(models.cnn_lstm_weights(4, (5, 6), 8, 2, pooling=pooling), x, pooling)[0].shape == (3, 2, 1)
    k = np.zeros((1, 4, 3))
    k[0, :, 1] = 1
    np.testing.assert_allclose(models.conv1d(x, k, np.zeros(1))[..., 0], x.sum(2))
    for forward, w in ((models.transformer, models.transformer_weights(16, 4, 2)), (models.decoder, models.transformer_weights(16, 4, 2, layers=2))):
        a = forward(w, x)
        moved = x.copy()
        moved[:, 10:] += 1
        np.testing.assert_allclose(forward(w, moved)[:, :10], a[:, :10])  # causal
        assert not np.allclose(forward(w, moved)[:, 10:], a[:, 10:])
    padded = np.zeros((3, 16), bool)
    padded[:, 3] = True
    hidden = x.copy()
    hidden[:, 3] += 5
    w = models.transformer_weights(16, 4, 2)
    np.testing.assert_allclose(models.decoder(w, hidden, padded=padded)[:, 4:], models.decoder(w, x, padded=padded)[:, 4:])
    q = np.random.default_rng(1).normal(size=(1, 1, 6, 4))
    np.testing.assert_allclose(models.rotary(q)[0, 0, 0], q[0, 0, 0])
    image = np.random.default_rng(2).normal(size=(2, 3, 1, 5, 4))
    outs, last = models.conv_lstm(models.conv_lstm_weights(1, [3, 2], [(3, 3), (1, 3)]), image, True)
    assert [o.shape for o in outs] == [(2, 3, 3, 5, 4), (2, 3, 2, 5, 4)] and len(last) == 2
    np.testing.assert_allclose(models.positions(4, 3)[1], [np.sin(1), np.cos(1), np.sin(0.01), np.cos(0.01)])
    df = spark.createDataFrame([(0, [1.0] * 8), (1, None), (2, [1.0])], "id long, x_window array<double>")
    got = {r.id: r.forecast for r in models.score(df, models.mlp, models.mlp_weights(8, 1.0, 0, 2), (2, 4)).collect()}
    assert len(got[0]) == 2 and got[1] is None and got[2] is None


def test_epochs(spark):
    """Every window of every segment has one place, in lanes that connect; panel rows hold the features and one 1 for the symbol."""
    from chronoloom.operators import trainers

    df = series(spark, [float(v) for v in range(200)]).withColumn("seq", F.col("event_id"))
    out = trainers.epoch(df, [4, 8], 3, 5, 2, 6, seed=1).toPandas()
    want = segments.drawn(windows.pairs(df, [4, 8], False), ("series_id", "lookback"), 5, "uniform", 2, 6, 1).toPandas()
    assert sorted(zip(out["lookback"], out["seg_id"], out["item_no"], out["item"])) == sorted(zip(want["lookback"], want["seg_id"], want["item_no"], want["item"]))
    for r in out.itertuples():
        first = r.item * r.lookback
        assert list(r.x_window) == [float(first + k) for k in range(r.lookback)] + [0.0] * (r.max_lookback - r.lookback) and r.y == first + r.lookback - 1
    assert not out.duplicated(["batch_no", "lane"]).any()
    panel_ = spark.createDataFrame([(d, s, t, float(s * t) if t % 3 else None, float(t)) for d in range(3) for s in (5, 7, 9) for t in range(12)], "date_id long, symbol_id long, time_id long, feature double, responder double")
    rows = trainers.prepared(panel_, ["feature"], "responder", 6, 4, 8, 1).collect()
    places = {}
    for r in rows:
        assert len(r.row) == 4 and sum(r.row[1:]) == 1 and r.y_value == r.time_id
        places.setdefault(r.symbol_id, set()).add(r.row[1:].index(1.0))
    assert all(len(p) == 1 for p in places.values()) and len({p for q in places.values() for p in q}) == len(places)
    with pytest.raises(Exception, match="too many symbols"):
        trainers.prepared(panel_, ["feature"], "responder", 6, 4, 8, 1, most_symbols=2).collect()
    lazy = trainers.lazy_epoch(panel_, ["feature"], "responder", [1, 2], 2, 6, 4, 8, 1).toPandas()
    assert len(lazy) > 0 and not lazy.duplicated(["batch_no", "lane"]).any() and all(len(w) == m for w, m in zip(lazy["x_window"], lazy["max_lookback"]))


def test_panel_epoch_of_many_symbols(spark):
    """More than 10,000 symbols: each window row is as wide as there are symbols, with one 1; padding is 0."""
    from chronoloom.operators import trainers

    symbols = 10_500
    panel_ = spark.range(symbols * 6).selectExpr("0L as date_id", "id div 6 as symbol_id", "id % 6 as time_id", "cast(id % 6 as double) as feature", "cast(id % 6 as double) as responder")
    out = trainers.lazy_epoch(panel_, ["feature"], "responder", [1, 2], 2, 4, 4, 6, 1).toPandas()
    assert set(out["lookback"]) == {1, 2}
    places = {}
    for r in out.itertuples():
        assert len(r.x_window) == r.max_lookback and all(len(v) == 1 + symbols for v in r.x_window)
        held = [np.flatnonzero(np.asarray(v)[1:] == 1.0).tolist() for v in r.x_window[: r.lookback]]
        assert all(len(h) == 1 for h in held) and all(sum(v[1:]) == 1.0 for v in r.x_window[: r.lookback])
        assert all(not np.any(v) for v in r.x_window[r.lookback :])
        places.setdefault(r.sample_id, set()).update(h[0] for h in held)
    assert len(places) == 4 and all(len(p) == 1 for p in places.values())


def test_keys_are_numbered_without_gaps(spark):
    keys = spark.range(500).select((F.col("id") % 50).alias("a"), F.floor(F.col("id") / 100).alias("b"))
    got = panel.numbered(keys, ["a", "b"], "n").toPandas()
    assert sorted(got["n"]) == list(range(250)) and not got.duplicated(["a", "b"]).any()
    draws = panel.sample(spark.createDataFrame([(d, s, t) for d in range(4) for s in range(5) for t in range(9)], "date_id long, symbol_id long, time_id long"), 4000, 2, 5, 3)
    share = draws.select("sample_id", "date_id", "symbol_id").distinct().groupBy("date_id", "symbol_id").count().toPandas()["count"]
    assert len(share) == 20 and share.sum() == 4000 and share.between(140, 260).all()  # each of 20 keys 200 times, give or take


def test_synthetic_recursions():
    rng = np.random.default_rng(5)
    x = synthetic.nonlinear_autoregressive(3, 2, [0.1, 0.2, 0.3])(50, np.random.default_rng(1))
    w = np.random.default_rng(1).random(2 * 3 + 3) - 0.5
    for i in range(3, 50):
        a, b, c = x[i - 3 : i]
        want = math.tanh(sum(p * q for p, q in zip(w, (a, b, c, a * a, b * b, c * c, a * b, a * c, b * c))))
        assert x[i] == pytest.approx(want)
    heavy = np.concatenate([synthetic.multifractal(512, rng, 0.5, 0.6) for _ in range(40)])
    light = np.concatenate([synthetic.multifractal(512, rng, 0.5, 0.0) for _ in range(40)])
    kurtosis = lambda v: ((v - v.mean()) ** 4).mean() / v.var() ** 2
    assert kurtosis(light) == pytest.approx(3, abs=0.3) and kurtosis(heavy) > 4


def test_decoder():
    """Against plain loops: one position, head and layer at a time."""
    w = models.transformer_weights(8, 2, 2, layers=2, bias=True, seed=3)
    x = np.random.default_rng(0).normal(size=(2, 5, 2))
    lin = lambda n, v: w[f"{n}.w"] @ v + w[f"{n}.b"]
    norm = lambda n, v: (v - v.mean()) / math.sqrt(v.var() + 1e-5) * w[f"{n}.s"] + w[f"{n}.b"]
    gelu = lambda v: np.array([0.5 * a * (1 + math.erf(a / math.sqrt(2))) for a in v])

    def turned(v, t):
        d = len(v)
        angle = [t / 10000 ** (2 * (i % (d // 2)) / d) for i in range(d)]
        return np.array([v[i] * math.cos(angle[i]) + (-v[i + 1] if i % 2 == 0 else v[i - 1]) * math.sin(angle[i]) for i in range(d)])

    for row, got in zip(x, models.decoder(w, x, 2), strict=True):
        y = [lin("project", v) for v in row]
        for k in range(2):
            b = f"block{k}"
            z = [norm(f"{b}.norm1", v) for v in y]
            q, ks, v = ([lin(f"{b}.{p}", a) for a in z] for p in "qkv")
            for t in range(5):
                seen = []
                for h in (slice(0, 4), slice(4, 8)):
                    e = np.array([math.exp(turned(q[t][h], t) @ turned(ks[u][h], u) / 2) for u in range(t + 1)])
                    seen.append(sum(a * v[u][h] for u, a in enumerate(e / e.sum())))
                y[t] = y[t] + lin(f"{b}.o", np.concatenate(seen))
            y = [a + lin(f"{b}.down", gelu(lin(f"{b}.up", norm(f"{b}.norm2", a)))) for a in y]
        np.testing.assert_allclose(got, [lin("out", a) for a in y], rtol=1e-9)
