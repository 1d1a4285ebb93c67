"""Rolling features over series too long for one task: chunks of rows with an overlap.

Rows are numbered in two steps (counts per bucket of time, then places inside a bucket), so no task orders a whole series.
Each chunk of ``chunk_rows`` rows also gets the rows around it that its frames reach; fills beyond a chunk's ends come
from one row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .heavy import heavy
from .rolling import UNFILLED, Feature, rolling
from .series import EVENTS, SeriesSpec


def numbered(df: DataFrame, bucket_ms: int, spec: SeriesSpec = EVENTS) -> DataFrame:
    """df with ``seq``, each row's place in its series from 0; bucket_ms should hold some thousand rows."""
    ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(spec.order[0]))
    rows = df.withColumn("_bucket", F.floor(ms / bucket_ms))
    counts = rows.groupBy(*spec.key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*spec.key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(*spec.key, "_bucket").orderBy(*spec.order)) - 1
    placed = rows.withColumn("_at", inside).join(counts.select(*spec.key, "_bucket", before.alias("_before")), [*spec.key, "_bucket"])
    return placed.withColumn("seq", F.col("_before") + F.col("_at")).drop("_bucket", "_at", "_before")


def in_chunks(df: DataFrame, apply: Callable[[DataFrame, SeriesSpec], DataFrame], reach: int, ahead: int = 0, chunk_rows: int = 100_000, spec: SeriesSpec = EVENTS) -> DataFrame:
    """apply(df, spec) chunk by chunk, for df with ``seq``; the result has _chunk, the row's chunk.

    Each chunk also has the ``reach`` rows before it and the ``ahead`` rows after it, so that frames of that size are whole; apply
    gets a spec in which a chunk is a series, and keeps the columns of its input. Neither may exceed chunk_rows.
    """
    if max(reach, ahead) > chunk_rows:
        raise ValueError("frames are longer than a chunk")
    chunk, at = F.floor(F.col("seq") / chunk_rows), F.col("seq") % chunk_rows
    copy = lambda c, halo: F.struct(c.alias("chunk"), F.lit(halo).alias("halo"))
    copies = F.array(copy(chunk, False), F.when(at >= chunk_rows - reach, copy(chunk + 1, True)), F.when((at < ahead) & (chunk > 0), copy(chunk - 1, True)))
    spread = df.withColumn("_c", F.explode(F.array_compact(copies))).select(*df.columns, F.col("_c.chunk").alias("_chunk"), F.col("_c.halo").alias("_halo"))
    return apply(spread, SeriesSpec((*spec.key, "_chunk"), ("seq",), spec.value)).filter("not _halo").drop("_halo")


def filled(raw: DataFrame, names: list[str], spec: SeriesSpec = EVENTS) -> DataFrame:
    """The columns of chunks filled over the whole series: the last value so far, before the first value the first one to come."""
    part = SeriesSpec((*spec.key, "_chunk"), ("seq",), spec.value)
    w = part.w
    # the forward fill leaves only the gap at the series' start, before its first value of all
    local = raw.withColumns({f"_l_{n}": F.last(n, True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for n in names} | {f"_f_{n}": F.first(n, True).over(part.all) for n in names})
    ends = raw.groupBy(*spec.key, "_chunk").agg(*[f(n, "seq").alias(f"_{k}_{n}") for n in names for k, f in (("first", lambda n, s: F.min_by(n, F.when(F.col(n).isNotNull(), F.col(s)))), ("last", lambda n, s: F.max_by(n, F.when(F.col(n).isNotNull(), F.col(s)))))])
    chunks = Window.partitionBy(*spec.key).orderBy("_chunk")
    carried = ends.select(
        *spec.key, "_chunk",
        *[F.last(f"_last_{n}", True).over(chunks.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_past_{n}") for n in names],
        *[F.first(f"_first_{n}", True).over(chunks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"_next_{n}") for n in names],
    )
    full = local.join(carried, [*spec.key, "_chunk"])
    return full.withColumns({n: F.coalesce(f"_l_{n}", f"_past_{n}", f"_f_{n}", f"_next_{n}") for n in names}).select(*raw.columns)


def _ahead(f: Feature) -> int:
    return f.args.get("horizon", 0) if f.kind in ("future_change", "future_change_vol") else max(0, -f.args.get("shift", 0))


def rolling_long(df: DataFrame, features: list[Feature], reach: int, chunk_rows: int = 100_000, spec: SeriesSpec = EVENTS, ahead: int = 0) -> DataFrame:
    """What rolling() gives, for df with ``seq``; reach is the number of rows that the longest feature looks back (window plus
    lag or shift), ahead the number that one looks ahead (its horizon, or a shift below 0)."""
    if any(_ahead(f) > ahead for f in features):
        raise ValueError("a feature looks further ahead than the chunks do")
    # a detrended value is what is left of the filled mean
    asked = [Feature("mean", f.alias, f.args) if f.kind == "detrend" else f for f in features]
    raw = in_chunks(df, lambda d, part: rolling(d, asked, part, fill=False), reach, ahead, chunk_rows, spec)
    names = [f.alias for f in features if f.kind not in UNFILLED or f.kind == "detrend"]
    out = filled(raw, names, spec) if names else raw
    x = F.col(spec.value).cast("double")
    return out.withColumns({f.alias: x - F.col(f.alias) for f in features if f.kind == "detrend"}).select(*df.columns, *[f.alias for f in features])


def heavy_long(df: DataFrame, kinds: list[str], window: int, chunk_rows: int = 100_000, spec: SeriesSpec = EVENTS) -> DataFrame:
    """What heavy() gives, for df with ``seq``, with ``seq`` and without the columns of order."""
    raw = in_chunks(df, lambda d, part: heavy(d, kinds, window, part, False, ("_halo",)), window - 1, 0, chunk_rows, spec)
    return filled(raw, kinds, spec).drop("_chunk")
