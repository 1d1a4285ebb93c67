"""Helpers that several corpus operators share: scratch tables, word rules, hot keys."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, everywhere in this package unless an operator says otherwise: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as bytes, for Python code.
SPACE = b" \t\n\v\f\r"

_scratch: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and all runs in one process, a new one."""
    there = spark.sparkContext.getCheckpointDir()
    if there:
        return there
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(configured or "file://" + tempfile.mkdtemp(prefix="shared-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver's Python ends, or by drop()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again.

    The table survives lost executors, unlike a local checkpoint, and keeps the plan of an iterative operator short.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove a table made by save() that no later result reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _scratch:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM may have gone first
            return


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what is run inside, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def as_text(name: str) -> Column:
    """A long column as a string: pandas would turn longs beside nulls into floating point."""
    return F.col(name).cast("string").alias(name)


def as_long(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.col(name).cast("long"))


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: str, parts: int = 1000) -> DataFrame:
    """rows left-joined with groups, which has one row per key (a string), its number of rows in n and other columns.

    Groups with over a parts-th of the rows (fewer than parts of them) are broadcast, so that no task gathers a hot
    group: its rows go through the shuffle under salted keys that match nothing. The others are joined by the key.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    limit = max(1, total // parts)
    others = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(n) > limit).select(F.col(key).alias("_hot"), F.struct(*others).alias("_a"))
    rest = groups.filter(F.col(n) <= limit).select(F.col(key).alias("_key"), F.struct(*others).alias("_b"))
    salted = F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.concat(F.lit("~"), F.floor(F.rand(7) * 1_000_000).cast("string")))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salted", salted)
    out = out.join(rest, F.col("_salted") == F.col("_key"), "left").withColumn("_g", F.coalesce("_a", "_b"))
    return out.select(*[F.col(c) for c in rows.columns], *[F.col(f"_g.{c}").alias(c) for c in others])


#: First hashes that may stand for several things; n things give n**2 / 2**65 of them.
MOST_COLLISIONS = 1_000_000


def apart(seen: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Gives things that share their first hash ids of their own: a function of rows with id and check, two hashes, which drops check.

    seen has the ids and checks of all of them. The ids concerned are few, 270 of 10**11, and are broadcast; more than
    MOST_COLLISIONS of them is an error.
    """
    doubled = save(seen.groupBy("id").agg(F.min("check").alias("a"), F.max("check").alias("b")).filter("a < b").select(F.col("id").alias("_doubled")), "collisions")
    n = doubled.count()
    if n > MOST_COLLISIONS:
        raise ValueError(f"{n} hashes stand for several things each")

    def told(rows: DataFrame) -> DataFrame:
        if not n:
            return rows.drop("check")
        own = F.when(F.col("_doubled").isNotNull(), F.xxhash64("id", "check")).otherwise(F.col("id"))
        return rows.join(F.broadcast(doubled), F.col("id") == F.col("_doubled"), "left").withColumn("id", own).drop("check", "_doubled")

    return told


def may_contain(rows: DataFrame, key: str, ids: DataFrame, name: str, most_bits: int = 1 << 25) -> DataFrame:
    """rows with one more column, whether their key (a long) may be among the one column of ids, which should be saved; a few others may too.

    A bitmap over the keys modulo its size is broadcast in words of 64 bits, at most ``most_bits`` (half a million words). It only
    spares a shuffle rows that the join after it would drop; with more ids than bits it lets all pass.
    """
    bits = 1 << 15
    while bits < most_bits and bits < 16 * ids.count():
        bits <<= 1
    slot = lambda c: F.pmod(F.col(c), F.lit(bits).cast("long"))
    bit = lambda s: F.col(s).bitwiseAND(F.lit(63).cast("long")).cast("int")
    held = ids.select(slot(ids.columns[0]).alias("_of")).groupBy(F.shiftright("_of", 6).alias("_word"))
    words = held.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit("_of"))).alias("_bits"))
    marked = rows.withColumn("_slot", slot(key)).join(F.broadcast(words), F.shiftright("_slot", 6) == F.col("_word"), "left")
    return marked.select(*rows.columns, F.coalesce(F.getbit("_bits", bit("_slot")) == 1, F.lit(False)).alias(name))


def might_contain(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key may be among ids, see may_contain."""
    return may_contain(rows, key, ids, "_may").filter("_may").drop("_may")
