"""Early stopping: as an object for a driver's loop, and as a fold over stored losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EarlyStopper:
    """Stops when ``patience`` losses in all have risen above the best by more than min_delta; a loss below the best by more than it
    sets the count back, one in between does nothing."""

    def __init__(self, patience: int = 1, min_delta: float = 0.0):
        self.patience, self.min_delta, self.best, self.count = patience, min_delta, float("inf"), 0

    def early_stop(self, loss: float) -> bool:
        if loss < self.best - self.min_delta:
            self.best, self.count = loss, 0
        elif loss > self.best + self.min_delta:
            self.count += 1
            return self.count >= self.patience
        return False


def stop_points(losses: DataFrame, key: str = "series_id", order: str = "seq", loss: str = "loss", patience: int = 1, min_delta: float = 0.0) -> DataFrame:
    """For each key the place of the first loss at which training stops, null if it doesn't, and the best loss until then."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(loss).alias("l"))))

    def state(best, count, at):
        return F.struct(best.cast("double").alias("best"), count.cast("int").alias("count"), at.cast("long").alias("at"))

    def step(s, r):
        lower, higher = r["l"] < s["best"] - min_delta, r["l"] > s["best"] + min_delta
        count = F.when(lower, 0).when(higher, s["count"] + 1).otherwise(s["count"])
        at = F.when(higher & (count >= patience), r["o"])
        return F.when(s["at"].isNotNull(), s).otherwise(state(F.when(lower, r["l"]).otherwise(s["best"]), count, at))

    start = state(F.lit(float("inf")), F.lit(0), F.lit(None))
    out = losses.groupBy(key).agg(rows.alias("_r")).select(key, F.aggregate("_r", start, step).alias("_s"))
    return out.select(key, F.col("_s.at").alias("stopped_at"), F.col("_s.best").alias("best"))
