"""Exact dedup with a persistent digest index, bucketed and sorted by digest.

Texts are equal when identical after lower-casing A-Z only. The index is a folder of runs, each a Parquet table of one row per
text, with one file per bucket, sorted by digest. A batch is reduced to one row per text and anti-joined with the runs by sort-merge
joins, for which a run needs neither a shuffle nor a sort; what is new is appended as another run. When there are MOST_RUNS of
them they are merged into one. All runs of an index have as many buckets as the first one, which follow from the number of texts
expected.

Defined results: a null text counts as empty. Of equal texts the row with the largest doc_id stays, a null id being
the smallest; of rows that also share the id, one stays. An empty table gives an empty result and leaves the index as
it was. Other columns are ignored.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, join_groups, new_path, save, settings

#: Runs that are merged into one.
MOST_RUNS = 8
#: Texts to a bucket, and the most buckets that Spark allows.
PER_BUCKET, MOST_BUCKETS = 2_000_000, 100_000
#: The order of a bucket's one file is used in joins.
ORDERED = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased; lower() does just that to a text of ASCII only, and faster."""
    t = F.coalesce(text, F.lit(""))
    other = t
    for c in string.ascii_uppercase:
        other = F.replace(other, F.lit(c), F.lit(c.lower()))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(other)


class DigestIndex:
    """The digests of all texts seen so far, in a folder that outlives the session.

    A run is a folder named run-<number>-<buckets>-<id>; it counts once Spark's writer has marked it as a success.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, expected: int | None = None):
        self.spark, self.path, self.expected = spark, path or new_path(spark, "digests"), expected
        self.where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self.store = self.where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.names: dict[str, str] = {}
        found = self.runs()
        self.buckets = int(found[0].split("-")[2]) if found else buckets

    def runs(self) -> list[str]:
        """The runs' folders, oldest first."""
        if not self.store.exists(self.where):
            return []
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found = [x.getPath().getName() for x in self.store.listStatus(self.where)]
        whole = [x for x in found if x.startswith("run-") and self.store.exists(path(f"{self.path}/{x}/_SUCCESS"))]
        return sorted(whole, key=lambda x: int(x.split("-")[1]))

    def run(self, folder: str) -> DataFrame:
        if folder not in self.names:
            self.names[folder] = f"digests_{uuid.uuid4().hex}"
            self.spark.sql(
                f"CREATE TABLE {self.names[folder]} (text_sha256 STRING, keep_id BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'"
            )
        return self.spark.table(self.names[folder])

    def table(self) -> DataFrame:
        out = self.spark.createDataFrame([], "text_sha256 string, keep_id long, batch string")
        for r in self.runs():
            out = out.unionByName(self.run(r))
        return out

    def size_for(self, texts: int) -> None:
        """Settles the number of buckets of a new index."""
        if self.buckets is None:
            self.buckets = min(MOST_BUCKETS, max(8, -(-(self.expected or 4 * texts) // PER_BUCKET)))

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The rows of groups whose digest isn't in the index."""
        if runs := self.runs():
            groups = groups.repartition(self.buckets, "text_sha256")
            for r in runs:
                groups = groups.join(self.run(r).hint("merge"), "text_sha256", "left_anti")
        return groups

    def seen(self, groups: DataFrame) -> DataFrame:
        """The rows of groups whose digest is in the index, with first_id, the id that stayed then."""
        out = groups.limit(0).withColumn("first_id", F.lit(None).cast("long"))
        for r in self.runs():
            mine = groups.repartition(self.buckets, "text_sha256")
            out = out.unionByName(mine.join(self.run(r).hint("merge").select("text_sha256", F.col("keep_id").alias("first_id")), "text_sha256"))
        return out.dropDuplicates(["text_sha256"])  # a merge that was cut off leaves a text in two runs

    def append(self, new: DataFrame, batch: str) -> None:
        """Add digests that aren't in the index, as a run; then merge the runs if there are many."""
        runs = self.runs()
        number = 1 + int(runs[-1].split("-")[1]) if runs else 0
        self._write(new.select("text_sha256", "keep_id", F.lit(batch).alias("batch")), number)
        if len(runs) + 1 >= MOST_RUNS:
            old = self.runs()
            self._write(self.table().dropDuplicates(["text_sha256"]), number + 1)
            for r in old:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(r, 'digests_none')}")
                self.store.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{r}"), True)

    def _write(self, rows: DataFrame, number: int) -> None:
        folder, name = f"run-{number:06d}-{self.buckets}-{uuid.uuid4().hex[:8]}", f"digests_{uuid.uuid4().hex}"
        out = rows.repartition(self.buckets, "text_sha256").write.format("parquet").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256")
        out.option("path", f"{self.path}/{folder}").saveAsTable(name)
        self.names[folder] = name


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row_id and text_sha256 of every row, saved: the texts are read once."""
    return save(docs.select("doc_id", F.monotonically_increasing_id().alias("row_id"), F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256).alias("text_sha256")), "digest-rows")


def dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    group_size counts the batch. A text that an earlier batch brought in is kept nowhere in this one, and keep_id is the
    id that stayed then. All new texts of the batch are in the index afterwards. A batch has a name of its own: a new one
    unless given, and one that the index holds already is refused.
    """
    index = index or DigestIndex(docs.sparkSession)
    if batch is None:
        batch = uuid.uuid4().hex
    elif not index.table().filter(F.col("batch") == batch).isEmpty():
        raise ValueError(f"the index already holds a batch {batch!r}")
    rows = digests(docs)
    groups = save(
        rows.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row_id")).alias("stays"), F.count("*").alias("group_size"))
        .select("text_sha256", F.col("stays.doc_id").alias("keep_id"), F.col("stays.row_id").alias("keep_row"), "group_size"),
        "digest-groups",
    )
    index.size_for(groups.count())
    with settings(docs.sparkSession, ORDERED):
        new = save(index.unseen(groups), "digest-new")
        old = index.seen(groups).select("text_sha256", F.col("first_id").alias("keep_id"), F.lit(None).cast("long").alias("keep_row"), "group_size")
        settled = save(new.unionByName(old), "digest-settled")
    if not new.isEmpty():
        index.append(new, batch)
    drop(groups)
    drop(new)
    return join_groups(rows, settled, "text_sha256", "group_size").select(
        "doc_id", "keep_id", F.col("group_size").cast("long"), F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(False)).alias("kept"), "text_sha256"
    )


SQL = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
