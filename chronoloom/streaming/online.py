"""Online forms: keyed folds with state, and event-time windows with a watermark.

A fold is sensitive to order: each micro-batch is sorted by (ts, tiebreak) within its key, and rows that come later than
a key's last row are dropped (``late="drop"``) or folded in as they come (``late="fold"``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.filters import trend_start, trend_step

OUT = "series_id long, ts timestamp, event_id long, x double, y double"


def _keyed(stream: DataFrame, step: Callable[[list[float] | None, float], tuple[list[float], float]], late: str) -> DataFrame:
    """y for each row: step(state, x) gives the new state, a list of doubles, and the row's y; state is None at first."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last_ts, last_id = (list(state.get[0]), state.get[1], state.get[2]) if state.exists else (None, -(1 << 62), -(1 << 62))
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        us = pdf["ts"].to_numpy("datetime64[us]").astype(np.int64)
        kept, ys = [], []
        for i, (t, e, x) in enumerate(zip(us, pdf["event_id"], pdf["x"].to_numpy(float, na_value=np.nan), strict=True)):
            if late == "drop" and (t, e) <= (last_ts, last_id):
                continue
            held, y = step(held, float(x))
            last_ts, last_id = int(t), int(e)
            kept.append(i)
            ys.append(y)
        if held is not None:
            state.update(([float(v) for v in held], last_ts, last_id))
        yield pdf.iloc[kept].assign(series_id=key[0], y=np.array(ys, float))[["series_id", "ts", "event_id", "x", "y"]]

    rows = stream.select("series_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "x")
    return rows.groupBy("series_id").applyInPandasWithState(fold, OUT, "held array<double>, last_ts long, last_id long", "append", GroupStateTimeout.NoTimeout)


def kalman(stream: DataFrame, late: str = "drop") -> DataFrame:
    """The local linear trend's level, row by row. A series that begins with missing values waits for its first one at 0."""

    def step(held: list[float] | None, x: float) -> tuple[list[float], float]:
        if held is None:
            held = trend_start(0.0 if np.isnan(x) else x)
        held = trend_step(tuple(held), x)
        return list(held), held[0]

    return _keyed(stream, step, late)


def ewma(stream: DataFrame, alpha: float, late: str = "drop") -> DataFrame:
    def step(held: list[float] | None, x: float) -> tuple[list[float], float]:
        y = x if held is None else (1 - alpha) * held[0] + alpha * x
        return [y], y

    return _keyed(stream, step, late)


def rolling_mean(stream: DataFrame, window: int, late: str = "drop") -> DataFrame:
    """The mean of the last ``window`` values, from a ring of them kept as state: frames of rows aren't allowed on streams."""

    def step(held: list[float] | None, x: float) -> tuple[list[float], float]:
        ring = [*(held or []), x][-window:]
        good = [v for v in ring if not np.isnan(v)]
        return ring, float(np.mean(good)) if good else float("nan")

    return _keyed(stream, step, late)


def tumbling(stream: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Count, sum and mean of x per series and event-time window; a window is out once the watermark has passed it."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return rows.groupBy("series_id", F.window("ts", width).alias("w")).agg(F.count("x").alias("n"), F.sum("x").alias("total"), F.avg("x").alias("mean")).select("series_id", F.col("w.start").alias("start"), "n", "total", "mean")


def replay(spark, path: str, schema: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int | None = 1, mode: str = "append") -> DataFrame:
    """Run a stream over the Parquet files that a path (a folder or a glob) names until all are read, into Parquet; the result as a DataFrame.

    Without files_per_batch all files are one batch, so that no row is late, whatever the order of the files.
    In complete mode each batch overwrites the result, so that the last one leaves all windows, open ones too.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    source = reader.parquet(path)
    writer = transform(source).writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    else:
        writer = writer.format("parquet").option("path", out)
    writer.start().awaitTermination()
    return spark.read.parquet(out)
