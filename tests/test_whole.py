"""Registered queries over tables that the given ones don't resemble."""

import pytest
from pyspark.sql import functions as F

from chronoloom.plans.catalogue import CATALOGUE

GIVEN = "/root/testdata/sf0.001"


def test_every_event_type_is_filtered(spark, tmp_path):
    events = spark.read.parquet(f"{GIVEN}/events.parquet")
    kinds = [f"type{i:02d}" for i in range(20)]
    many = events.withColumn("event_type", F.concat(F.lit("type"), F.lpad((F.col("event_id") % 20).cast("string"), 2, "0")))
    many.write.parquet(f"{tmp_path}/events.parquet")
    got = CATALOGUE["kf_ukf"][0](spark, str(tmp_path))
    assert [c for c in got.columns if c.endswith("_level")] == [f"{k}_level" for k in kinds]
    assert got.filter(" or ".join(f"{k}_level is null or isnan({k}_level)" for k in kinds)).count() == 0 < got.count()


def test_tumbling_has_the_open_windows(spark):
    events = spark.read.parquet(f"{GIVEN}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = events.groupBy(F.col("user_id").alias("series_id"), F.window("ts", "1 hour").alias("w")).agg(F.count("value").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    got = CATALOGUE["stream_tumbling"][0](spark, GIVEN).select("series_id", "start", "n", F.round("total", 4).alias("total"))
    as_rows = lambda df: sorted(map(tuple, df.collect()))
    assert as_rows(got) == as_rows(want.select("series_id", "w.start", "n", "total"))


@pytest.mark.parametrize("name", ["stream_kalman", "stream_ewma", "stream_rolling_mean", "stream_tumbling"])
def test_files_out_of_order(spark, tmp_path, name):
    """A table of several files, the later rows in the older file, gives what one file gives."""
    events = spark.read.parquet(f"{GIVEN}/events.parquet")
    middle = events.agg(F.sort_array(F.collect_list("ts"))[500]).first()[0]
    for part in (F.col("ts") >= middle, F.col("ts") < middle):
        events.filter(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    as_rows = lambda path: sorted(map(repr, CATALOGUE[name][0](spark, str(path)).withColumns({c: F.round(c, 4) for c in ("total", "mean") if name == "stream_tumbling"}).collect()))
    got, want = as_rows(tmp_path), as_rows(GIVEN)
    assert got == want and len(got) > 900
