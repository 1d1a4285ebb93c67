"""Sharding by bytes: Karmarkar-Karp differencing over indivisible groups of rows with equal texts.

Law ``bytes``. Rows with equal texts share a shard. Each group with over 1/(64 * shards) of all bytes stands by
itself (there are fewer than 64 * shards of them); all others meet in ``bins`` bins by the hash of their text, so
that the driver differences a bounded list of weights, however large the table is.

Defined results: a null text counts as empty (8 bytes, CRC 0) and shares the shard of the empty texts. Rows with
one doc_id but different texts are placed by their texts; identical rows get different slots. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save

OVERHEAD = 8


def difference(weights: list[int], parts: int) -> list[int]:
    """The part of each weight, by Karmarkar-Karp differencing.

    Each weight begins as a partition of one full and else empty parts. The two partial partitions of the largest
    spread are combined again and again, the largest part of one with the smallest of the other.
    """
    if not weights:
        return []
    parent = list(range(len(weights)))
    tie = count()
    # (-spread, tie, [(sum, a member or -1)] in falling order)
    heap = [(-w, next(tie), [(w, i)] + [(0, -1)] * (parts - 1)) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = []
        for (x, i), (y, j) in zip(a, reversed(b), strict=True):
            if i >= 0 and j >= 0:
                parent[j] = i
            merged.append((x + y, i if i >= 0 else j))
        merged.sort(key=lambda p: -p[0])
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], next(tie), merged))
    part = {member: k for k, (_, member) in enumerate(heap[0][2]) if member >= 0}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    return [part[root(i)] for i in range(len(weights))]


def salted(rows: DataFrame, groups: DataFrame, limit: int) -> DataFrame:
    """rows with ``salt``: null, but for rows of which more than ``limit`` share both id and text; those are dealt by their row_id.

    Only texts with so many rows are looked at; fewer than rows / limit pairs of id and text are broadcast.
    """
    texts = groups.filter(F.col("n") > limit).select("text_hash")
    many = rows.join(F.broadcast(texts), "text_hash", "left_semi").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    hot = F.broadcast(many.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")))
    same = (F.col("text_hash") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return rows.join(hot, same, "left").withColumn("salt", F.when(F.col("_text").isNotNull(), F.col("row_id"))).drop("_id", "_text")


def shard_by_bytes(docs: DataFrame, shards: int = 24, bins: int = 4096, cell_rows: int = 512) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row, with the text's hash as text_hash.

    Slots count each shard's rows in the order of cells (by a hash of the id and the text) and ids in them: the rows of a cell are
    numbered in one task, the cells of a shard by their counts, so no task sees a whole shard. Rows that share both id and text
    have one cell, unless there are very many.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = save(
        docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("row_id")),
        "shard-rows",
    )
    groups = save(rows.groupBy("text_hash").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    total, n = groups.agg(F.sum("bytes"), F.sum("n")).first()
    large = F.col("bytes") > (total or 0) // (64 * shards)
    bin_of = F.pmod("text_hash", F.lit(bins)).cast("int")
    alone = [(r[0], r[1]) for r in groups.filter(large).select("text_hash", "bytes").orderBy("text_hash").collect()]
    binned = [(r[0], r[1]) for r in groups.filter(~large).groupBy(bin_of.alias("bin")).agg(F.sum("bytes").alias("bytes")).orderBy("bin").collect()]
    part = difference([w for _, w in alone + binned], shards)
    own = spark.createDataFrame([(k, p) for (k, _), p in zip(alone, part, strict=False)], "text_hash long, own int")
    bins_df = spark.createDataFrame([(k, p) for (k, _), p in zip(binned, part[len(alone) :], strict=True)], "bin int, binned int")
    cells = max(1, (n or 0) // (shards * cell_rows))
    placed = (
        salted(rows, groups, max(cell_rows, (n or 0) // 1000)).withColumn("bin", bin_of).join(F.broadcast(own), "text_hash", "left").join(F.broadcast(bins_df), "bin", "left")
        .select("doc_id", "size", "text_crc32", "text_hash", F.coalesce("own", "binned").alias("shard"), F.pmod(F.xxhash64("doc_id", "text_hash", "salt"), F.lit(cells)).alias("cell"))
    )
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("shard", "cell", before.alias("first"))
    at = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_hash")) - 1
    return placed.withColumn("at", at).join(first, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "text_hash",
    )
