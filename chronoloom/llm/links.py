"""From buckets of similar items to their components: candidate links by leaders, and distributed union-find.

No step lists all pairs of a bucket or gathers one in a task: bucket members meet leaders by joins, which adaptive
execution splits where a bucket is hot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, might_contain, save


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every id in edges (a, b): comp is the smallest id that links reach from it.

    Alternating large-star and small-star steps: each id's larger neighbours, then its smaller ones, are linked to the
    smallest of its neighbourhood, until nothing changes. Then every edge leads to its component's smallest id.
    """
    e = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    state = _mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # the least larger-star link of u: what is smaller than u now meets there
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = save(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "edges")
        drop(e)
        e, before, state = new, state, _mark(new)
        if state == before:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps after more links (a, b): only the components that the links touch are put together anew."""
    of = lambda c: comps.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}"))
    touched = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    up = components(touched)
    old = comps.join(up.select(F.col("id").alias("comp"), F.col("comp").alias("up")), "comp", "left").select("id", F.coalesce("up", "comp").alias("comp"))
    return save(old.unionByName(up.join(comps.select("id"), "id", "left_anti")), "components")


#: A verifier keeps the true links (a, b) of candidate pairs; a comparer finds those between the items of two blocks.
Tools = tuple[DataFrame, Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]


def link(members: DataFrame, tools: Callable[[DataFrame], Tools], block: int = 96) -> DataFrame:
    """(id, comp) of the ids that have a verified link, from the buckets' members (key, id), no row twice.

    First every member is held against its bucket's most central member, the one whose buckets are the largest: in a group of
    copies that is the original or close to it, and most of the group is then one component. What a bucket's other members hold
    outside of their largest component is then compared with all of them, in blocks of about ``block`` members against blocks of
    as many: no row is made for a pair, and no task sees a whole bucket. So every pair of a bucket is in one component or has
    been compared.

    tools(ids) gives, for all ids that can occur, a table of items (id and what comparing needs), the verifier of pairs and
    the comparer of rows with the arrays ``left`` and ``right`` of items, their components and their ``earlier`` buckets: two items that
    share one of those are compared there.
    """
    ends = save(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    active = save(might_contain(members, "key", ends.select("key")).join(ends, "key"), "bucket-members")
    items, verify, compare = tools(active.select("id").distinct())
    central = active.groupBy("id").agg(F.sum(F.log2("n")).alias("score"))
    leaders = active.select("key", "id").join(central, "id").groupBy("key").agg(F.max(F.struct("score", "id")).alias("l")).select("key", F.col("l.id").alias("leader"))
    rest = save(active.select("key", "id").join(leaders, "key").filter("id != leader"), "bucket-rests")
    links = save(verify(rest.select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")).distinct()), "links")
    comps = save(components(links), "components")

    # the leaders have met everyone; what is left to compare is the others with each other
    buckets = active.groupBy("id").agg(F.collect_list("key").alias("keys"))  # as many as there are bands
    m = rest.select("key", "id").join(comps, "id", "left").join(buckets, "id")
    m = save(m.select("key", "id", F.coalesce("comp", "id").alias("comp"), F.filter("keys", lambda k: k < F.col("key")).alias("earlier")), "bucket-components")
    per = m.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp")).alias("most"), F.sum("c").alias("n"))
    open_ = save(per.filter("most.c < n").select("key", F.col("most.comp").alias("main"), F.ceil(F.col("n") / block).alias("nr"), F.ceil((F.col("n") - F.col("most.c")) / block).alias("nl")), "open-buckets")
    inside = m.join(open_, "key")
    right = inside.withColumn("r", F.pmod(F.xxhash64("id", "key"), F.col("nr")))
    left = inside.filter("comp != main").withColumn("l", F.pmod(F.xxhash64("key", "id"), F.col("nl")))
    gathered = lambda d, no, name: d.select("key", no, "id", "comp", "earlier").join(items, "id").groupBy("key", no).agg(F.collect_list(F.struct("comp", "earlier", *items.columns)).alias(name))
    blocks = open_.select("key", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("l"), "nr").select("key", "l", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("r"))
    met = blocks.join(gathered(left, "l", "left"), ["key", "l"]).join(gathered(right, "r", "right"), ["key", "r"])
    more = save(compare(met).distinct(), "links")
    out = comps if more.isEmpty() else merged(comps, more)
    for table in (ends, active, rest, links, m, open_, more):
        drop(table)
    return out
