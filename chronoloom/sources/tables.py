"""Series read from the star-schema tables: per-user event values, an hourly grid, daily orders, a panel.

A series is a DataFrame of series_id, ts, event_id (the tiebreak), seq (its place, from 0) and x.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def not_nan(x: Column) -> Column:
    """NaN stands for a missing value in arrays; here that is null."""
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def event_series(spark: SparkSession, sf_dir: str, missing_every: int = 0) -> DataFrame:
    """Each user's event values in order of time; with missing_every, the values of the events that it divides are missing."""
    x = not_nan(F.col("value"))
    if missing_every:
        x = F.when(F.col("event_id") % missing_every != 0, x)
    order = Window.partitionBy("series_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), "ts", "event_id", x.alias("x"))
    return rows.withColumn("seq", (F.row_number().over(order) - 1).cast("long"))


def hour_of(ts: Column) -> Column:
    """Whole hours since 1970, without any time zone."""
    return F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts).cast("long")


def hourly_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id 0, hour, ts, seq and x: the events' summed values for each hour from first to last, 0 where none fell.

    The grid grows with the time covered, not with the events, which are summed before.
    """
    sums = table(spark, sf_dir, "events").groupBy(hour_of(F.col("ts")).alias("hour")).agg(F.sum("value").alias("v"))
    ends = sums.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    spine = ends.select("a", F.explode(F.sequence("a", "b")).alias("hour"))
    joined = spine.join(sums, "hour", "left")
    ts = F.timestamp_add("HOUR", F.col("hour"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return joined.select(F.lit(0).cast("long").alias("series_id"), "hour", ts.alias("ts"), F.col("hour").alias("event_id"), (F.col("hour") - F.col("a")).alias("seq"), F.coalesce("v", F.lit(0.0)).alias("x"))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id 0, day (since 1970), ts, seq and x: orders per day, without the days on which there was none."""
    day = F.datediff(F.col("o_orderdate"), F.lit("1970-01-01")).cast("long")
    days = table(spark, sf_dir, "orders").groupBy(day.alias("day")).agg(F.count("*").cast("double").alias("x"))
    seq = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("day")) - 1  # one row per day
    ts = F.timestamp_add("DAY", F.col("day"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return days.select(F.lit(0).cast("long").alias("series_id"), "day", ts.alias("ts"), F.col("day").alias("event_id"), seq.cast("long").alias("seq"), "x")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date_id, symbol_id, time_id, feature and responder: a day, a user, the user's place in the day, its value and the next."""
    date = F.datediff(F.col("ts"), F.lit("2024-01-01")).cast("long")
    rows = table(spark, sf_dir, "events").select(date.alias("date_id"), F.col("user_id").alias("symbol_id"), "ts", "event_id", F.col("value").alias("feature"))
    w = Window.partitionBy("date_id", "symbol_id").orderBy("ts", "event_id")
    return rows.select("date_id", "symbol_id", (F.row_number().over(w) - 1).cast("long").alias("time_id"), "feature", F.lead("feature").over(w).alias("responder"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The naive forecast of each series: p the value before, y the value, t the place modulo 8."""
    w = Window.partitionBy("series_id").orderBy("ts", "event_id")
    rows = event_series(spark, sf_dir).withColumn("p", F.lag("x").over(w))
    return rows.filter("p is not null").select("series_id", "event_id", "ts", "seq", "p", F.col("x").alias("y"), (F.col("seq") % 8).alias("t"))
