"""Segments of consecutive windows, and their schedule into batches whose lanes carry state.

Draws come from digests of the key, the lookback, the draw and a seed, so reruns agree.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import normal, uniform

#: Segments that one task schedules.
EPOCH = 100_000


def lengths(items: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def cut(items: DataFrame, segments: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The items of each segment (keys, seg_id, start, length), with item_no, their place in it."""
    places = segments.withColumn("item", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)))
    return items.join(places, [*keys, "item"]).withColumn("item_no", F.col("item") - F.col("start"))


def drawn(items: DataFrame, keys: tuple[str, ...], samples: int, how: str, a: float, b: float, seed: int = 0) -> DataFrame:
    """``samples`` segments for each key: lengths ``uniform`` in [a, b) or the absolute value of a ``normal`` of mean a and
    deviation b, cut to 1..n; starts uniform among those that fit."""
    spans = lengths(items, keys).withColumn("seg_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    of = [*keys, "seg_id"]
    length = a + uniform(*of, seed=seed) * (b - a) if how == "uniform" else F.abs(a + b * normal(*of, seed=seed))
    spans = spans.withColumn("length", F.least(F.greatest(F.floor(length), F.lit(1)), F.col("n")))
    start = F.floor(uniform(*of, seed=seed + 7) * (F.col("n") - F.col("length") + 1))
    return cut(items, spans.withColumn("start", start).drop("n"), keys)


def partitioned(items: DataFrame, keys: tuple[str, ...], mean: float, deviation: float, seed: int = 0) -> DataFrame:
    """All items of each key cut into consecutive segments of int(abs(normal)) items; draws of 0 are dropped."""
    spans = lengths(items, keys)
    # enough draws to cover n items: each is at least 0, and on average not below mean
    enough = F.ceil(F.col("n") / max(mean, 1.0) * 2 + 16)
    draws = spans.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), enough)))
    draws = draws.withColumn("length", F.when(F.col("draw") == enough, F.col("n")).otherwise(F.floor(F.abs(mean + deviation * normal(*keys, "draw", seed=seed))))).filter("length > 0")
    w = Window.partitionBy(*keys).orderBy("draw")
    draws = draws.withColumn("start", F.sum("length").over(w) - F.col("length")).filter("start < n")
    draws = draws.withColumn("length", F.least("length", F.col("n") - F.col("start"))).withColumn("seg_id", F.row_number().over(w) - 1)
    return cut(items, draws.drop("n", "draw"), keys)


def random_segments(df: DataFrame, min_steps: int, max_steps: int, samples: int, keys: tuple[str, ...] = ("series_id",), seed: int = 0) -> DataFrame:
    """Runs of rows (places in ``seq``) of random length in [min_steps, max_steps] and random start, as x_window."""
    items = df.withColumnRenamed("seq", "item")
    rows = drawn(items, keys, samples, "uniform", min_steps, max_steps + 1, seed)
    ordered = F.sort_array(F.collect_list(F.struct("item_no", "x")))
    return rows.groupBy(*keys, "seg_id", "start", "length").agg(ordered.alias("_r")).select(*keys, "seg_id", "start", "length", F.col("_r.x").alias("x_window"))


SCHEDULE = "batch_no long, lane long, seg_key string, item_no long, connected int, lookback long, max_lookback long, sort_pos long"


def schedule(segments: pd.DataFrame, batch_size: int, shuffle: bool = False, seed: int = 0) -> pd.DataFrame:
    """Where each item of each segment (seg_key, lookback, n_items) goes.

    Lanes are filled with segments by falling lookback, short ones first (or shuffled). Each batch takes the next item of each
    lane; a lane whose segment ends gets the next segment, or closes. After each batch the lanes are sorted, stably, by
    falling lookback: sort_pos is an item's place then. connected is 1 while the segment goes on.
    """
    order = segments[segments["n_items"] > 0]
    if shuffle:
        order = order.sample(frac=1, random_state=seed).sort_values("lookback", ascending=False, kind="stable")
    else:
        order = order.sort_values(["lookback", "n_items", "seg_key"], ascending=[False, True, True], kind="stable")
    waiting = list(order[["seg_key", "lookback", "n_items"]].itertuples(index=False, name=None))[::-1]
    lanes = [[*waiting.pop(), 0] for _ in range(min(batch_size, len(waiting)))]
    out, batch = [], 0
    while lanes:
        most = max(lane[1] for lane in lanes)
        ranked = sorted(range(len(lanes)), key=lambda i: -lanes[i][1])
        place = {i: p for p, i in enumerate(ranked)}
        following = []
        for i in ranked:
            key, lookback, n, at = lanes[i]
            going = at + 1 < n
            out.append((batch, i, key, at, int(going), lookback, most, place[i]))
            if going:
                following.append([key, lookback, n, at + 1])
            elif waiting:
                following.append([*waiting.pop(), 0])
        lanes, batch = following, batch + 1
    return pd.DataFrame(out, columns=["batch_no", "lane", "seg_key", "item_no", "connected", "lookback", "max_lookback", "sort_pos"])


def batches(items: DataFrame, batch_size: int, shuffle: bool = False, seed: int = 0, epochs: int | None = None, zero: Column | None = None) -> DataFrame:
    """Segment items (seg_key, lookback, item_no, x_window, y) with their place in the batches; x_window is padded on the
    right to the longest lookback of its batch, with ``zero`` (0.0; an array where the windows' values are arrays).

    Only the segments' sizes are scheduled, in one task for each epoch's worth (``epochs`` groups by hash of the segment, each with
    batches of its own; by default as many as make about EPOCH segments each); the items themselves meet their places by an equi-join.
    """
    sizes = items.groupBy("seg_key", "lookback").agg(F.count(F.lit(1)).alias("n_items"))
    if epochs is None:
        epochs = 1 + sizes.count() // EPOCH
    sizes = sizes.withColumn("epoch", F.pmod(F.xxhash64("seg_key"), F.lit(epochs)))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        return schedule(pdf, batch_size, shuffle, seed).assign(epoch=pdf["epoch"].iloc[0])

    places = sizes.groupBy("epoch").applyInPandas(plan, SCHEDULE + ", epoch long").drop("lookback")
    out = items.join(places, ["seg_key", "item_no"])
    return out.withColumn("x_window", F.concat("x_window", F.array_repeat(F.lit(0.0) if zero is None else zero, (F.col("max_lookback") - F.size("x_window")).cast("int"))))
