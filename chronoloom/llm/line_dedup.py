"""Fuzzy line dedup by MinHash, with DataFrame functions only.

Lines (split at \\n) are compared by their sets of character shingles and are duplicates at a Jaccard similarity of
``similarity`` or more, or linked by a chain of such lines. One line of each component stays: the one with the least document id,
then the least place.

Shingles: one begins at each place of a line, ``shingle`` characters (code points) long; a shorter line is one shingle as a whole.

Signature: every shingle of a line is hashed once; the high half of the hash deals it to one of ``bands * rows`` bins, and the
least low half in each bin is a MinHash of the line. Hashes so high that ``DEPTH`` lower ones are expected in their bin aren't looked at;
a bin without a lower one (1.8 % at a depth of 4, and many bins of a short line) counts as empty. Band j holds the minima of
the first ``rows`` bins from bin ``j * rows`` on, round the circle, that aren't empty. Two lines agree in a band with probability
similarity ** rows, so 8 bands of 3 find a pair at 0.8 with 0.997. Equal lines have one signature: the minima of all lines are found by one
aggregation by line, most of it before the shuffle.

Lines that share a band are candidates. A bitmap of their shingles rules out most of those that are too far apart, and none
else (``may_be_alike``); of the others the Jaccard similarity is found exactly, over all their shingles, which are made anew from the
lines: those take less room in a shuffle.

A line is identified by a 64-bit hash; a second one of 64 bits tells lines with the same first hash apart (``common.apart``).

Defined results: a null text counts as empty. Blank lines (nothing but ASCII white space) are kept always; every other line is compared,
however short. Rows with the same id and text count as one document and get one verdict. An empty table gives an empty result.
Other columns are ignored, or kept by dedup_lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, drop, may_contain, save
from .links import Tools, link

SHINGLE, SIMILARITY, BANDS, ROWS, DEPTH = 8, 0.8, 8, 3, 4
#: Words of 64 bits in the sketch of a line that may have a partner.
WORDS = 32


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, doc_hash, line_no, line, compared, id and check (two hashes of the line)."""
    text = F.coalesce("text", F.lit(""))
    hashed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("doc_hash"))  # below the explode: once a document
    out = hashed.select("doc_id", "doc_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return out.select("*", F.col("line").rlike(r"[^\x20\x09-\x0D]").alias("compared"), line_hash(F.col("line")).alias("id"), F.xxhash64(F.lit("check"), F.col("line")).alias("check"))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once."""
    return F.transform(F.array(value), f)[0]


# Two bytes a character, or four where a line has characters beyond the first plane, so that a shingle is found without counting characters.
# A shingle is hashed in two bytes a character either way.


def _wide(line: Column) -> Column:
    return F.octet_length(F.encode(line, "UTF-16BE")) > 2 * F.length(line)


def _narrowed(shingle_bytes: Column) -> Column:
    return F.encode(F.decode(shingle_bytes, "UTF-32"), "UTF-16BE")


def at_places(line: Column, shingle: int) -> Column:
    """The different hashes of the line's shingles."""

    def hashes(b: Column, unit: int, of: Callable[[Column], Column]) -> Column:
        begins = F.sequence(F.lit(1), F.greatest(F.octet_length(b) - (unit * shingle - 1), F.lit(1)), F.lit(unit))
        return F.transform(begins, lambda i: F.xxhash64(of(F.substring(b, i, F.lit(unit * shingle)))))

    narrow = bound(F.encode(line, "UTF-16BE"), lambda b: hashes(b, 2, lambda x: x))
    wide = bound(F.encode(line, "UTF-32"), lambda b: hashes(b, 4, _narrowed))
    return F.array_distinct(F.when(_wide(line), wide).otherwise(narrow))


def places_of(n: Column, shingle: int) -> Column:
    """The number of shingles of a line of n characters."""
    return F.greatest(n - (shingle - 1), F.lit(1))


def shingled(rows: DataFrame, keys: list[str], shingle: int) -> DataFrame:
    """keys, places (the number of shingles) and h, a shingle's hash; one row per shingle, in generated code."""
    encoded = rows.select(*keys, "line", F.length("line").alias("n"), F.encode("line", "UTF-16BE").alias("narrow"))
    encoded = encoded.select(*keys, "n", "line", "narrow", (F.octet_length("narrow") > 2 * F.col("n")).alias("wide"))
    encoded = encoded.select(*keys, "wide", places_of(F.col("n"), shingle).alias("places"), F.when(F.col("wide"), F.encode("line", "UTF-32")).otherwise(F.col("narrow")).alias("b"))
    unit = F.when(F.col("wide"), 4).otherwise(2)
    at = encoded.select(*keys, "b", "wide", "places", F.explode(F.sequence(F.lit(1), (F.col("places") - 1) * unit + 1, unit)).alias("i"))
    piece = F.when(F.col("wide"), _narrowed(F.substring("b", F.col("i"), F.lit(4 * shingle)))).otherwise(F.substring("b", F.col("i"), F.lit(2 * shingle)))
    # the condition always holds; what isn't deterministic keeps filters above, which would hash each piece a second time
    return at.select(*keys, "places", F.when(F.spark_partition_id() >= 0, F.xxhash64(piece)).otherwise(F.lit(0)).alias("h"))


def minima(rows: DataFrame, keys: list[str], bins: int, shingle: int) -> DataFrame:
    """keys and m0, m1 and so on, the least hashes in the bins or null, of the lines that are compared; one row per line."""
    limit = F.ceil(F.lit(float((1 << 32) * DEPTH * bins)) / places_of(F.length("line"), shingle))  # found once a line
    bin_of = F.shiftrightunsigned(F.shiftrightunsigned("h", 32) * bins, 32)
    limited = rows.filter("compared").withColumn("limit", limit)
    dealt = shingled(limited, [*keys, "limit"], shingle).select(*keys, "limit", bin_of.cast("int").alias("bin"), F.col("h").bitwiseAND(F.lit((1 << 32) - 1)).alias("v"))
    # with a filter clause a row writes to its own bin's minimum only; without one, to all of them
    return dealt.filter("v < limit").groupBy(*keys).agg(*[F.expr(f"min(v) FILTER (WHERE bin = {j})").alias(f"m{j}") for j in range(bins)])


def sketched(texts: DataFrame, shingle: int) -> DataFrame:
    """id, places and s0, s1 and so on, the bitmap of the line's shingles dealt to 64 * WORDS slots."""
    slots = shingled(texts, ["id"], shingle).select("id", "places", F.pmod("h", F.lit(64 * WORDS)).cast("int").alias("slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)))
    bits = slots.select("id", "places", F.shiftright("slot", 6).alias("word"), bit.alias("bit"))
    return bits.groupBy("id", "places").agg(*[F.expr(f"bit_or(bit) FILTER (WHERE word = {w})").alias(f"s{w}") for w in range(WORDS)]).na.fill(0)


def may_be_alike(x: Callable[[str], Column], y: Callable[[str], Column], similarity: float) -> Column:
    """False only where the similarity is too low for certain: the slots in which two sketches differ are at most the shingles in
    which the lines differ, and those may be (1 - t) / (1 + t) of both lines' shingles together. The first words often tell already."""
    limit = (1 - similarity) / (1 + similarity) * (x("places") + y("places")) + 1e-6
    differing = lambda n: sum((F.bit_count(x(f"s{w}").bitwiseXOR(y(f"s{w}"))) for w in range(1, n)), F.bit_count(x("s0").bitwiseXOR(y("s0"))))
    return (differing(WORDS // 4) <= limit) & (differing(WORDS) <= limit)


def banded(least: DataFrame, keys: list[str], bands: int, per_band: int) -> DataFrame:
    """keys and bands, the band keys, of the minima."""
    m = [F.col(f"m{j}") for j in range(bands * per_band)]
    whole = F.lit(True)
    for x in m:
        whole = whole & x.isNotNull()

    def sparse(full: Column, mask: Column) -> Column:  # hashes to the same keys as the columns themselves where none is empty
        def keys_of(circle: Column) -> Column:
            before = lambda j: F.bit_count(mask.bitwiseAND(F.lit((1 << j * per_band) - 1)))
            return F.array(*[F.xxhash64(F.slice(circle, before(j) + 1, F.least(F.lit(per_band), F.size(full))), F.lit(j)) for j in range(bands)])

        return bound(F.concat(full, full), keys_of)

    held = F.struct(F.filter(F.array(*m), lambda x: x.isNotNull()).alias("full"), sum((F.when(x.isNotNull(), 1 << j).otherwise(0) for j, x in enumerate(m)), F.lit(0)).cast("long").alias("mask"))
    dense = F.array(*[F.xxhash64(*m[j * per_band : (j + 1) * per_band], F.lit(j)) for j in range(bands)])
    return least.select(*keys, F.when(whole, dense).otherwise(bound(held, lambda x: sparse(x["full"], x["mask"]))).alias("bands"))


def _alike(common: Column, a: Column, b: Column, similarity: float) -> Column:
    return common >= similarity * (a + b - common)


def similar(items: DataFrame, shingle: int, similarity: float) -> Callable[[DataFrame], DataFrame]:
    """Keeps the pairs (a, b) of ids whose lines' exact Jaccard similarity is high enough."""

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda c: items.select(F.col("id").alias(c), F.struct(*[x for x in items.columns if x != "id"]).alias(f"i{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").filter(may_be_alike(lambda c: F.col(f"ia.{c}"), lambda c: F.col(f"ib.{c}"), similarity))
        sets = both.select("a", "b", at_places(F.col("ia.line"), shingle).alias("x"), at_places(F.col("ib.line"), shingle).alias("y"))
        # a generator, so that the filter on the counts isn't pushed below them, where the sets would be made anew for each use
        counts = F.struct("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), F.size("x").alias("nx"), F.size("y").alias("ny"))
        return sets.select(F.inline(F.array(counts))).filter(_alike(F.col("common"), F.col("nx"), F.col("ny"), similarity)).select("a", "b")

    return verify


def linked_blocks(met: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The links (a, b) between the lines of two blocks that lie in different components and share no earlier bucket."""
    kept = ["comp", "id", "earlier", "places", *[f"s{w}" for w in range(WORDS)]]

    def item(x: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in kept], at_places(x["line"], shingle).alias("set"))

    def maybe(x: Column, y: Column) -> Column:
        return (x["comp"] != y["comp"]) & may_be_alike(lambda c: x[c], lambda c: y[c], similarity) & ~F.arrays_overlap(x["earlier"], y["earlier"])

    def near(x: Column, y: Column) -> Column:
        return maybe(x, y) & bound(F.size(F.array_intersect(x["set"], y["set"])), lambda common: _alike(common, F.size(x["set"]), F.size(y["set"]), similarity))

    def links(left: Column, right: Column) -> Column:
        pair = lambda x, y: F.struct(F.least(x["id"], y["id"]).alias("a"), F.greatest(x["id"], y["id"]).alias("b"))
        return F.flatten(F.transform(left, lambda x: F.transform(F.filter(right, lambda y: near(x, y)), lambda y: pair(x, y))))

    # sets are made only of the lines that may have a partner in the other block
    open_left = F.filter("left", lambda x: F.exists("right", lambda y: maybe(x, y)))
    open_right = lambda left: F.filter("right", lambda y: F.exists(left, lambda x: maybe(x, y)))
    with_sets = lambda left, right: F.struct(F.transform(left, item).alias("left"), F.transform(right, item).alias("right"))
    found = bound(open_left, lambda left: bound(with_sets(left, open_right(left)), lambda m: links(m["left"], m["right"])))
    return met.select(F.explode(found).alias("l")).select("l.a", "l.b")


def line_classes(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per line: doc_id, doc_hash, line_no, line_hash, class_hash (its component's least line hash) and kept."""
    all_lines = lines(docs)
    keys = ["id", "check"]
    signed = save(banded(minima(all_lines, keys, bands * rows, shingle), keys, bands, rows), "line-signatures")
    told = apart(signed)
    found: dict[str, DataFrame] = {}

    def tools(ids: DataFrame) -> Tools:
        ids = save(ids, "line-candidates")
        # one more pass over the texts makes both the places of all lines and the texts of those that may be candidates
        marked = may_contain(told(all_lines), "id", ids, "_asked")
        places = save(marked.withColumn("line", F.when(F.col("_asked") & F.col("compared"), F.col("line"))).drop("_asked"), "line-places")
        found["places"] = places
        # dealt by id once: the texts' shuffle serves the sketches and the join
        texts = places.filter("line is not null").select("id", "line").dropDuplicates(["id"]).join(ids, "id", "left_semi")
        items = save(texts.join(sketched(texts, shingle), "id"), "line-items")
        found["items"] = items
        return items, similar(items, shingle, similarity), lambda met: linked_blocks(met, shingle, similarity)

    comps = link(told(signed).select(F.explode("bands").alias("key"), "id"), tools)
    classed = save(found["places"].drop("line").join(comps, "id", "left").withColumn("class_hash", F.coalesce("comp", "id")).drop("comp"), "line-classes")
    for table in (signed, *found.values()):
        drop(table)
    first = F.min(F.struct("doc_id", "doc_hash", "line_no")).alias("first")
    groups = classed.filter("compared").groupBy("class_hash").agg(first, F.count("*").alias("n")).filter("n > 1").select("class_hash", "first")
    own = F.struct("doc_id", "doc_hash", "line_no")
    kept = ~F.col("compared") | F.col("first").isNull() | own.eqNullSafe(F.col("first"))
    out = classed.join(save(groups, "line-groups"), "class_hash", "left")
    return out.select("doc_id", "doc_hash", "line_no", F.col("id").alias("line_hash"), "class_hash", kept.alias("kept"))


def dedup_lines(docs: DataFrame, **options: float) -> DataFrame:
    """The documents with all their columns, their texts without the lines that another line stands for.

    A text without such lines is left byte for byte; every document stays, if need be with an empty text.
    """
    dropped = line_classes(docs, **options).filter("not kept").groupBy("doc_id", "doc_hash").agg(F.collect_set("line_no").alias("_dropped"))
    dropped = dropped.select(F.col("doc_id").alias("_id"), F.col("doc_hash").alias("_hash"), "_dropped")
    full = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"), F.col("doc_id").alias("own_id"))
    out = full.join(dropped, (F.col("own") == F.col("_hash")) & F.col("own_id").eqNullSafe(F.col("_id")), "left")
    rest = F.array_join(F.filter(F.split("row.text", "\n"), lambda _, i: ~F.array_contains("_dropped", i)), "\n")
    text = F.when(F.col("_dropped").isNull(), F.col("row.text")).otherwise(rest)
    return out.select(F.col("row").withField("text", text).alias("row")).select("row.*")
