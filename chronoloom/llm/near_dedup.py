"""Near-dedup by improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A document is a weighted set of its shingles (``shingle`` words, A-Z lower-cased; all words where there are fewer): the weight
is the count in the text times 1 + ln((1 + N) / (1 + df)) / ln(2 + N), which lies between 1 and 2, so that links within a large
group of copies don't vanish for want of rarity.

df comes from a table of ``features`` hash slots, counted over all documents: a slot counts every document that holds one of its
shingles. What other shingles are expected to add, the mean load L of a slot, is taken off, with three standard deviations (``allowance``),
so a shingle that stands in one document has df 1 however many shingles share its slot, and one in d documents has d less at most about
6 * sqrt(L). With a load far below 1 the counts are exact but for collisions. The table's size doesn't grow: it is broadcast.

Improved consistent weighted sampling gives ``bands * rows`` samples, equal for two documents with a probability of their weighted
Jaccard similarity each. Its random numbers come from fixed tables that the shingle's hash points into. Documents that
agree in a band are candidates (at 0.8, 10 bands of 3 find a pair with probability 0.999); links.link chooses which of them to
compare, by the exact weighted Jaccard similarity of the whole texts. Documents linked by a chain form a class.

Rows with equal texts meet by a 64-bit hash before any comparison; texts that share it are told apart by a second one
(``common.apart``). Defined results: a null text counts as empty; texts without a word
have no shingle and are alone, but equal texts are always of one class. The class id is the least doc_id of the class, null if
it has none. Repeated rows share their class. An empty table gives an empty result. Other columns are ignored or kept.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, as_long, as_text, join_groups, might_contain, save, settings
from .links import Tools, link

FEATURES = 1 << 20
CHUNK = 1 << 12
TABLE = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class _Words(dict):
    """Word to its 64-bit hash; keeps words of up to 64 bytes, and forgets all when it has many."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 300_000:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def shingled(text: str | bytes | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's shingles, sorted, and their counts; bytes are UTF-8."""
    data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(n, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = (h ^ w[j : len(w) - n + 1 + j]) * _ODD
            h ^= h >> np.uint64(29)
        h *= _MIX
        h ^= h >> np.uint64(32)
    h.sort()
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.diff(np.append(first, len(h)))


def slots(h: np.ndarray, features: int) -> np.ndarray:
    return (h % np.uint64(features)).astype(np.int64)


def document_frequencies(docs: DataFrame, shingle: int, features: int) -> tuple[np.ndarray, int]:
    """The number of documents per slot, over all documents, and the number of documents.

    Tasks count slots and send them in chunks; each chunk's sum is made where its pieces stream by. The driver gets
    the whole table, ``features`` counts, whatever the size of the input.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(features, np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                total[np.unique(slots(shingled(text, shingle)[0], features))] += 1
                n += 1
        _words.clear()  # a worker may go on to other stages
        if n:
            yield pd.DataFrame([(c // CHUNK, n if c == 0 else 0, zlib.compress(total[c : c + CHUNK].astype("<i8").tobytes(), 1)) for c in range(0, features, CHUNK)], columns=["chunk", "n", "counts"])

    # a chunk's counts are summed as they stream by; what goes to the driver is compressed
    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for pdf in batches:
            for c, k, b in zip(pdf["chunk"], pdf["n"], pdf["counts"], strict=True):
                counts = np.frombuffer(zlib.decompress(b), "<i8")
                total[c] = total[c] + counts if c in total else counts
                n[c] = n.get(c, 0) + int(k)
        yield pd.DataFrame([(c, n[c], zlib.compress(total[c].astype("<i8").tobytes(), 1)) for c in total], columns=["chunk", "n", "counts"])

    schema = "chunk int, n long, counts binary"
    parts = docs.select("text").mapInPandas(counted, schema).repartition("chunk").mapInPandas(summed, schema).toPandas()
    df, n = np.zeros(features, np.int64), 0
    for c, k, b in zip(parts["chunk"], parts["n"], parts["counts"], strict=True):
        df[c * CHUNK : (c + 1) * CHUNK] = np.frombuffer(zlib.decompress(b), "<i8")
        n += int(k)
    return df, n


def allowance(load: float) -> float:
    """What the other shingles of a slot add to its count, at most but for chance: the mean and three deviations of a Poisson
    variable; at loads under 1, where most slots have one shingle, the deviations count in proportion."""
    return load + 3 * math.sqrt(load) * min(1.0, load)


def idf(counts: np.ndarray, n: int) -> np.ndarray:
    """The weight of a shingle in each slot, among n documents."""
    df = np.clip(counts - allowance(float(counts.sum()) / len(counts)), 1, None)
    return (1 + np.log((1 + n) / (1 + df)) / np.log(2 + n)).astype(np.float32)


@functools.lru_cache(maxsize=2)
def tables(seed: int) -> np.ndarray:
    """For each entry 1/r, beta, ln c - r + r * beta and r, with r and c from Gamma(2, 1) and beta uniform."""
    rng = np.random.default_rng(seed)
    r, c, beta = rng.gamma(2, 1, TABLE), rng.gamma(2, 1, TABLE), rng.random(TABLE)
    return np.stack([1 / r, beta, np.log(c) - r + r * beta, r], 1).astype(np.float32)


def samples(h: np.ndarray, weight: np.ndarray, starts: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """k samples (32 bits) of each of the weighted sets that follow each other from ``starts``; none may be empty.

    The sample of a set is its element of least ln a, with ln a = ln c - r * (t - beta) - r and t = floor(ln S / r + beta).
    """
    table = tables(seed)
    rng = np.random.default_rng(seed + 1)
    out = np.zeros((len(starts), k), np.uint32)
    log_s = np.log(weight).astype(np.float32)
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
    for i in range(k):
        odd, add = (np.uint64(x) for x in rng.integers(0, 1 << 63, 2))
        with np.errstate(over="ignore"):
            x = (h ^ add) * (odd | np.uint64(1))
        got = table[(x >> np.uint64(48)).astype(np.int64)]
        t = np.floor(log_s * got[:, 0] + got[:, 1])
        value = (got[:, 2] - got[:, 3] * t).view(np.int32)
        value = (value ^ ((value >> 31) & 0x7FFFFFFF)).astype(np.int64)  # in the order of the floats
        which = (low + t.astype(np.int64) * 2654435761) & 0xFFFFFFFF
        out[:, i] = np.minimum.reduceat((value << 32) | which, starts) & 0xFFFFFFFF
    return out


@dataclass(frozen=True)
class Options:
    shingle: int = 5
    similarity: float = 0.8
    bands: int = 10
    rows: int = 3
    features: int = FEATURES


def _bands(texts: pd.Series, weights: np.ndarray, o: Options) -> list[np.ndarray | None]:
    """The band keys of each text, None for one without words."""
    out: list[np.ndarray | None] = [None] * len(texts)
    at: list[int] = []
    hs: list[np.ndarray] = []
    ws: list[np.ndarray] = []

    def flush() -> None:
        starts = np.cumsum([0, *map(len, hs)])[:-1]
        got = samples(np.concatenate(hs), np.concatenate(ws), starts, o.bands * o.rows)
        for i, row in zip(at, got, strict=True):
            keys = [xxhash.xxh64_intdigest(row[j * o.rows : (j + 1) * o.rows].tobytes(), j) for j in range(o.bands)]
            out[i] = np.array(keys, np.uint64).view(np.int64)
        at.clear(), hs.clear(), ws.clear()

    held = 0
    for i, text in enumerate(texts):
        h, n = shingled(text, o.shingle)
        if not len(h):
            continue
        at.append(i), hs.append(h), ws.append(n * weights[slots(h, o.features)])
        held += len(h)
        if held > 1 << 15:
            flush()
            held = 0
    if at:
        flush()
    return out


class Weighted:
    """Weighted sets of texts, by id; the last few million shingles are kept, since a candidate comes in many pairs.

    The k-th occurrence of a shingle is an element of its own, so that weighted Jaccard similarity is that of sets of weighted elements.
    """

    def __init__(self, weights: np.ndarray, o: Options, most: int = 1_000_000):
        self.weights, self.o, self.most, self.held = weights, o, most, 0
        self.known: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}

    def get(self, i: int, packed: bytes) -> tuple[np.ndarray, np.ndarray, float]:
        """Elements in order, their weights and the sum of these; packed is the text, compressed."""
        if (found := self.known.get(i)) is None:
            h, n = shingled(zlib.decompress(packed), self.o.shingle)
            unit = self.weights[slots(h, self.o.features)]
            if len(n) and n.max() > 1:
                at = np.repeat(np.arange(len(h)), n)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                with np.errstate(over="ignore"):
                    h, unit = h[at] + nth.astype(np.uint64) * _ODD, unit[at]
                order = np.argsort(h, kind="stable")
                h, unit = h[order], unit[order]
            if self.held + len(h) > self.most:
                self.known.clear()
                self.held = 0
            found = self.known[i] = (h, unit, float(unit.sum(dtype=float)))
            self.held += len(h)
        return found

    def jaccard(self, a: tuple, b: tuple) -> float:
        if not len(a[0]) or not len(b[0]):
            return 0.0
        at = np.searchsorted(b[0], a[0])
        at[at == len(b[0])] = 0
        both = float(a[1][b[0][at] == a[0]].sum(dtype=float))
        return both / (a[2] + b[2] - both)

    def links(self, left: list[tuple], right: list[tuple]) -> list[tuple[int, int]]:
        """The linked pairs between two blocks of (comp, earlier, id, text) that lie in different components and share no earlier bucket."""
        if len(left) * len(right) <= 16:
            return [
                (min(i, j), max(i, j)) for c, e, i, x in left for d, f, j, y in right
                if c != d and e.isdisjoint(f) and self.jaccard(self.get(i, x), self.get(j, y)) >= self.o.similarity
            ]
        a, b = [self.get(i, x) for *_, i, x in left], [self.get(j, y) for *_, j, y in right]
        # only elements of both sides can add to an intersection
        common = np.intersect1d(np.unique(np.concatenate([x[0] for x in a])), np.unique(np.concatenate([x[0] for x in b])), assume_unique=True)
        if not len(common):
            return []

        def matrix(sets: list[tuple], weigh: bool) -> np.ndarray:
            out = np.zeros((len(sets), len(common)))
            for r, (h, unit, _) in enumerate(sets):
                at = np.searchsorted(common, h)
                at[at == len(common)] = 0
                hit = common[at] == h
                out[r, at[hit]] = unit[hit] if weigh else 1
            return out

        both = matrix(a, True) @ matrix(b, False).T
        total = np.array([x[2] for x in a])[:, None] + np.array([x[2] for x in b])
        apart = np.array([x[0] for x in left])[:, None] != np.array([x[0] for x in right])
        found = zip(*np.nonzero(apart & (both >= self.o.similarity * (total - both))), strict=True)
        return [(min(left[r][2], right[k][2]), max(left[r][2], right[k][2])) for r, k in found if left[r][1].isdisjoint(right[k][1])]


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def identified(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns with id and check, two hashes of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(*columns, text.alias("text"), text_hash(text).alias("id"), F.xxhash64(F.lit("check"), text).alias("check"))


def text_classes(docs: DataFrame, o: Options = Options()) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """doc_id, text_hash and class_hash of every row, saved; and what makes text_hash of rows with id and check, see common.apart."""
    # a row may be two blocks of texts: small batches bound what the JVM and a worker hold at once
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}):
        return _text_classes(docs, o)


def _text_classes(docs: DataFrame, o: Options) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    spark = docs.sparkSession
    hashed = identified(docs, as_text("doc_id"))
    weights = spark.sparkContext.broadcast(idf(*document_frequencies(docs, o.shingle, o.features)))  # 4 bytes a slot

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # a batch's copies of one text are signed once
            first = ~pdf[["id", "check"]].duplicated().to_numpy()
            keys = list(zip(pdf["id"], pdf["check"], strict=True))
            made = dict(zip((k for k, f in zip(keys, first, strict=True) if f), _bands(pdf["text"][first], weights.value, o), strict=True))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "id": pdf["id"], "check": pdf["check"], "bands": [made[k] for k in keys]})
        _words.clear()

    signed = save(as_long(hashed.mapInPandas(banded, "doc_id string, id long, check long, bands array<long>"), "doc_id"), "near-signatures")
    told = apart(signed)
    rows = told(signed)
    members = rows.filter("bands is not null").groupBy("id").agg(F.first("bands").alias("bands")).select(F.explode("bands").alias("key"), "id")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "text": [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in pdf["text"]]})

    def tools(ids: DataFrame) -> Tools:
        ids = save(ids, "near-candidates")
        # compressed before they are shuffled, since a candidate's text travels several times
        asked = might_contain(told(hashed.select("id", "check", "text")), "id", ids).mapInPandas(packed, "id long, text binary")
        texts = save(asked.dropDuplicates(["id"]).join(ids, "id", "left_semi"), "near-texts")

        @F.pandas_udf("boolean")
        def near(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            sets = Weighted(weights.value, o)
            for batch in batches:
                yield pd.Series([sets.jaccard(sets.get(i, x), sets.get(j, y)) >= o.similarity for i, x, j, y in zip(*batch, strict=True)], dtype=bool)

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sets = Weighted(weights.value, o)
            for batch in batches:
                for k in range(batch.num_rows):
                    sides = [[(e["comp"], frozenset(e["earlier"]), e["id"], e["text"]) for e in batch.column(side)[k].as_py()] for side in ("left", "right")]
                    if found := sets.links(*sides):
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

        def verify(pairs: DataFrame) -> DataFrame:
            both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
            return both.filter(near("a", "ta", "b", "tb")).select("a", "b")

        return texts, verify, lambda met: met.select("left", "right").mapInArrow(compared, "a long, b long")

    comps = link(members, tools)
    classes = rows.drop("bands").join(comps, "id", "left").select("doc_id", F.col("id").alias("text_hash"), F.coalesce("comp", "id").alias("class_hash"))
    return save(classes, "near-classes"), told


def near_classes(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), class_size and kept (true for one row with that id)."""
    rows = text_classes(docs, o)[0].withColumn("k", F.col("class_hash").cast("string")).withColumn("row_id", F.monotonically_increasing_id())
    rows = save(rows, "near-rows")
    groups = save(rows.groupBy("k").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("first"), F.count("*").alias("class_size")), "near-groups")
    out = join_groups(rows, groups, "k", "class_size")
    return out.select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row_id") == F.col("first.row_id")).alias("kept"))


def dedup(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """The documents with all their columns, one of each class: the one with the least id, nulls last."""
    rows, told = text_classes(docs, o)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    keep = rows.groupBy("class_hash").agg(first).select(F.col("first.doc_id").alias("_keep"), F.col("first.text_hash").alias("_hash"))
    full = told(identified(docs, F.struct("*").alias("row"), F.col("doc_id")).drop("text")).withColumnRenamed("id", "own")
    same = (F.col("own") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_keep"))
    return full.join(keep, same, "left_semi").dropDuplicates(["own"]).select("row.*")
