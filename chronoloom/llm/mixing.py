"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1, piecewise linear between shared knots. The integral of the
schedule, scaled to the source's target, is its cumulative token demand; the position of a document is the time at
which that demand reaches the tokens that the source has given before it, found by inverting the integral. Documents
are range-sorted by position.

Targets: sources in order of code point, null last, have the weights ``weights``, repeating, and share ``share`` times
all sizes. A target stops at ``most`` times its source's size; the excess is shared anew by weight until none is above
(the level at which this ends is found directly, from the sources in order of their cap per weight).

Defined results: a null text has size 0; a source of size 0 gets target 0. The order of a source's documents comes from
a digest of id and text, so reruns agree; identical rows are told apart arbitrarily. The document at the end of a
target is cut. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, n_words, save

WEIGHTS = (5.0, 2.0, 1.0)
#: Knots of the schedule, and for each weight in turn the factor by which it is multiplied there.
KNOTS = (0.0, 0.5, 1.0)
FACTORS = ((1.4, 1.0, 0.6), (1.0, 1.0, 1.0), (0.6, 1.0, 1.4))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, rank, weight and target, from the rows' source and size.

    The windows run over one row per source, in one task: a hundred million sources are some gigabytes, which it sorts on disk.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("rank", rank)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    everything, order = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    total = share * F.sum("source_size").over(everything)
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (total - capped) / open_weight)
    # the level holds from the first source, in this order, whose cap isn't below it
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"]
    return per.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))).select("source", "source_size", "source_rows", "rank", "weight", "target")


def inverse_demand(given: Column, kind: Column, knots: tuple = KNOTS, factors: tuple = FACTORS) -> Column:
    """The time at which a source of this kind (its rank modulo the kinds) has been asked for a share ``given`` of its target."""
    out = None
    for k, f in enumerate(factors):
        area = [0.0]
        for a, b, v, w in zip(knots, knots[1:], f, f[1:]):
            area.append(area[-1] + (b - a) * (v + w) / 2)
        wanted = F.least(F.greatest(given, F.lit(0.0)), F.lit(1.0)) * area[-1]
        time = F.lit(knots[-1])
        for i in reversed(range(len(f) - 1)):
            rest, slope = wanted - area[i], (f[i + 1] - f[i]) / (knots[i + 1] - knots[i])
            inside = rest / f[i] if slope == 0 else (F.sqrt(F.greatest(f[i] ** 2 + 2 * slope * rest, F.lit(0.0))) - f[i]) / slope
            time = F.when(wanted <= area[i + 1], knots[i] + inside).otherwise(time)
        out = F.when(kind == k, time) if out is None else out.when(kind == k, time)
    return out


def plan(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, knots: tuple = KNOTS, factors: tuple = FACTORS, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken and position, range-sorted by position.

    The words that a source gives before a document are summed in two steps: a source of n rows has about sqrt(n) cells of
    about sqrt(n) rows, by digest; cells are summed first, then rows in their cell. No task gathers a source.
    """
    return _placed(docs.select("doc_id", "source", "text"), weights, share, most, knots, factors, seed).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "position"
    ).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def _placed(docs: DataFrame, weights: tuple, share: float, most: float, knots: tuple, factors: tuple, seed: str) -> DataFrame:
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"/{seed}/"), F.coalesce("text", F.lit(""))))
    rows = save(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), digest.alias("digest")), "mix-rows")
    per = save(targets(rows, weights, share, most), "mix-targets")
    by_source = F.col("r.source").eqNullSafe(F.col("s.source"))
    rows = rows.alias("r").join(per.withColumn("cells", F.ceil(F.sqrt("source_rows"))).alias("s"), by_source)
    fraction = F.conv(F.substring("digest", 1, 12), 16, 10).cast("long") / float(16**12)
    rows = rows.select("r.*", "source_size", "target", "rank", F.floor(fraction * F.col("cells")).alias("cell"))
    cells = rows.groupBy("rank", "cell").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("rank").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("rank", "cell", before.alias("cell_start"))
    inside = F.sum("size").over(Window.partitionBy("rank", "cell").orderBy("digest", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    rows = rows.withColumn("inside", inside).join(cells, ["rank", "cell"]).withColumn("start", F.col("cell_start") + F.col("inside"))
    goal = F.round("target").cast("long")
    # pass p of the source over its documents puts this one at start + p * source_size; of each it takes what the target still wants
    take = lambda p: F.least(F.greatest(goal - (F.col("start") + p * F.col("source_size")), F.lit(0)), F.col("size"))
    passes = [take(p) for p in range(max(1, -int(-most // 1)))]
    given = F.when(F.col("target") > 0, F.col("start") / F.col("target")).otherwise(0.0)
    return rows.withColumn("takes", F.array(*passes)).withColumn("taken", F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x)).withColumn(
        "position", inverse_demand(given, F.col("rank") % len(factors), knots, factors)
    )


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, knots: tuple = KNOTS, factors: tuple = FACTORS, seed: str = "mix") -> DataFrame:
    """The mixed documents with their columns: each as often as it is taken, the last one of a source cut, in the order of position.

    Documents that nothing is taken of, empty ones among them, are left out.
    """
    key = lambda: F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"/{seed}/"), F.coalesce("text", F.lit(""))))
    placed = _placed(docs.select("doc_id", "source", "text"), weights, share, most, knots, factors, seed)
    given = lambda p: F.when(F.col("target") > 0, (F.col("start") + p * F.col("source_size")) / F.col("target")).otherwise(0.0)
    kinds = len(factors)
    copies = placed.select(
        F.col("digest").alias("_digest"), F.coalesce(F.col("source"), F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"), F.col("size").alias("_size"),
        F.posexplode("takes").alias("_pass", "_take"), "start", "source_size", "target", "rank",
    ).filter("_take > 0")
    copies = copies.withColumn("_position", inverse_demand(given(F.col("_pass")), F.col("rank") % kinds, knots, factors))
    copies = copies.select("_digest", "_source", "_none", "_size", "_position", "_take")
    full = docs.select(F.struct("*").alias("row"), key().alias("_digest"), F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"))
    # identical rows have one digest: the first of them stands for all, with the copies of all
    first = full.dropDuplicates(["_digest", "_source", "_none"])
    out = first.join(copies, ["_digest", "_source", "_none"])
    words = F.regexp_extract_all("row.text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.when(F.col("_take") < F.col("_size"), F.array_join(F.slice(words, F.lit(1), F.col("_take").cast("int")), "")).otherwise(F.col("row.text"))
    out = out.select(F.col("row").withField("text", cut).alias("row"), "_position", "_digest")
    return out.repartitionByRange("_position", "_digest").sortWithinPartitions("_position", "_digest").select("row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '/mix/' || coalesce(text, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM d GROUP BY source),
w AS (SELECT *, CASE rnk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
t AS (SELECT source, rnk, source_size, least(cap, coalesce((SELECT arg_min(lvl, (cap / weight, rnk)) FROM l WHERE lvl * weight <= cap) * weight, cap)) AS target FROM l),
r AS (SELECT d.*, t.source_size, t.target, t.rnk,
             sum(size) OVER (PARTITION BY t.rnk ORDER BY digest, doc_id ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN target > 0 THEN least(1.0, start / target) ELSE 0.0 END AS given FROM r)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (least(greatest(round(target)::BIGINT - start, 0), size) + least(greatest(round(target)::BIGINT - start - source_size, 0), size))::BIGINT AS taken, source,
       round(CASE rnk % 3
         WHEN 0 THEN CASE WHEN given <= 0.6 THEN (sqrt(1.96 - 1.6 * given) - 1.4) / -0.8 ELSE 0.5 + (sqrt(greatest(1.0 - 1.6 * (given - 0.6), 0)) - 1.0) / -0.8 END
         WHEN 1 THEN given
         ELSE CASE WHEN given <= 0.4 THEN (sqrt(0.36 + 1.6 * given) - 0.6) / 0.8 ELSE 0.5 + (sqrt(1.0 + 1.6 * (given - 0.4)) - 1.0) / 0.8 END END, 6) AS position
FROM p
"""
