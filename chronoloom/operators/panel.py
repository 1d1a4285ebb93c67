"""Random slices of a panel partitioned by date: draws name keys by number, one join fetches their rows.

The date filter reaches the files where the panel is partitioned by date_id; nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import uniform

#: Hexadecimal digits of the buckets in which keys are numbered.
DIGITS = 3


def nearest_fill(a: np.ndarray, k: int = 2) -> np.ndarray:
    """Missing cells as the mean of the k nearest rows that have the column, near by the columns that both rows have.

    A column without any value becomes 0; a row with nothing in common with any other takes the column's mean.
    """
    a = a.copy()
    a[:, np.isnan(a).all(0)] = 0.0
    missing = np.isnan(a)
    if not missing.any():
        return a
    out, known = a.copy(), ~missing
    for i in np.flatnonzero(missing.any(1)):
        both = known & known[i]
        n = both.sum(1)
        gap = np.where(both, a - a[i], 0.0)
        far = np.where(n > 0, np.sqrt((gap**2).sum(1) * a.shape[1] / np.maximum(n, 1)), np.inf)
        far[i] = np.inf
        for j in np.flatnonzero(missing[i]):
            donors = np.flatnonzero(known[:, j] & np.isfinite(far))
            chosen = donors[np.argsort(far[donors], kind="stable")[:k]]
            out[i, j] = a[chosen, j].mean() if len(chosen) else a[known[:, j], j].mean()
    return out


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The distinct keys with a number from 0 on, in order of a digest's first digits, then of the keys.

    Keys are numbered in each of 16 ** DIGITS buckets, then the buckets' counts are summed: no task sees all keys.
    """
    rows = df.select(*keys).distinct().withColumn("_b", F.substring(F.md5(F.concat_ws("/", *[F.col(k).cast("string") for k in keys])), 1, DIGITS))
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per bucket
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*keys)) - 1
    return rows.withColumn("_i", inside).join(counts.select("_b", before.alias("_before")), "_b").select(*keys, (F.col("_before") + F.col("_i")).cast("long").alias(name))


def sample(panel: DataFrame, samples: int, min_length: int, max_length: int, seed: int = 0) -> DataFrame:
    """``samples`` slices: a date, one of its symbols, and a run of time_ids of random start and length, drawn by digest.

    Every draw names one of the (date, symbol) keys by its number, so each is equally likely, and meets it by an equi-join.
    """
    keys = numbered(panel, ["date_id", "symbol_id"], "_at")
    total = keys.agg(F.count(F.lit(1)).alias("_total"))  # one row
    draws = panel.sparkSession.range(samples).withColumnRenamed("id", "sample_id").crossJoin(F.broadcast(total)).filter("_total > 0")
    draws = draws.withColumn("_at", F.floor(uniform("sample_id", seed=seed + 2) * F.col("_total")).cast("long")).drop("_total")
    named = keys.join(F.broadcast(draws), "_at").drop("_at")  # as many rows as samples were asked for
    ends = panel.join(F.broadcast(named.select("date_id", "symbol_id").distinct()), ["date_id", "symbol_id"]).groupBy("date_id", "symbol_id").agg(F.min("time_id").alias("lo"), F.max("time_id").alias("hi"))
    picked = named.join(ends, ["date_id", "symbol_id"])
    length = F.floor(min_length + uniform("sample_id", seed=seed) * (max_length - min_length))
    start = F.col("lo") + F.floor(uniform("sample_id", seed=seed + 1) * F.greatest(F.col("hi") - F.col("lo") - length + 1, F.lit(1)))
    picked = picked.withColumn("t0", start).withColumn("t1", F.least(start + length, F.col("hi"))).drop("lo", "hi")
    rows = panel.join(F.broadcast(picked), ["date_id", "symbol_id"])  # as many rows as samples were asked for
    return rows.filter(F.col("time_id").between(F.col("t0"), F.col("t1"))).drop("t0", "t1")


def impute(slices: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """The slices with their missing cells filled, slice by slice."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time_id", kind="stable")
        return pdf.assign(**dict(zip(columns, nearest_fill(pdf[columns].to_numpy(float, na_value=np.nan), k).T, strict=True)))

    return slices.groupBy("sample_id").applyInPandas(fill, slices.schema)
