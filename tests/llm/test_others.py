"""Quality rules, sharding, WARC, mixing and the pipeline."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom.llm import mixing, quality, sharding, warc
from tests.llm.conftest import frame

SPACE = "\x20\t\n\v\f\r"


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + j for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


@settings(max_examples=300, deadline=None)
@given(st.text("ab \n\t é#*😀", max_size=80))
def test_statistics(text):
    assert quality.statistics(text)[:5] == brute_statistics(text)


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, len(quality.FEATURES)))
    y = (x[:, 0] + np.sin(2 * x[:, 6]) - x[:, 2] - 0.5 * x[:, 4] + 0.3 * rng.normal(size=4000) > 0).astype(float)
    return x, y


def test_trees_learn_and_are_monotonic(labelled):
    x, y = labelled
    trees = quality.fit(x[:3000], y[:3000], list(quality.FEATURES.values()))
    assert ((trees.score(x[3000:]) > 0.5) == (y[3000:] > 0)).mean() > 0.85
    for j, (_, sign) in enumerate(quality.FEATURES.items()):
        if sign:
            many = np.repeat(x[3000:3100], 40, axis=0)
            many[:, j] = np.tile(np.linspace(-4, 4, 40), 100)
            steps = np.diff(trees.raw(many).reshape(100, 40), axis=1)
            assert (sign * steps >= -1e-12).all()
    # flattened nodes score as a walk over each tree does
    row, total = x[3500], trees.base
    for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
        node = 0
        for level in range(trees.depth):
            at = node + 2**level - 1
            node = 2 * node + int(row[f[at]] > t[at])
        total += leaf[node]
    assert trees.raw(x[3500:3501])[0] == pytest.approx(total)
    assert quality.fit(x[:5], np.ones(5), list(quality.FEATURES.values())).score(x[:3]).tolist() == [0.5] * 3


def test_quality_of_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.apply(docs, *quality.train(docs, labels)).toPandas().set_index("doc_id")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, r in got.iterrows():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(texts[i])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    known = labels.toPandas().set_index("doc_id").join(got)
    good, bad = known[(known.quality == 1) & ~known.base_failed], known[known.quality == 0]
    assert good.kept.mean() > 0.97 and bad.kept.mean() < 0.3


def test_quality_edges(spark, odd, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    trees, threshold = quality.train(odd, labels)
    got = quality.apply(odd, trees, threshold).collect()
    assert len(got) == odd.count() and all(r.kept == (not r.base_failed) for r in got)
    assert quality.apply(nothing, trees, threshold).count() == 0
    assert quality.filter_quality(odd, labels).columns == odd.columns and quality.filter_quality(nothing, labels).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), max_size=60), st.integers(2, 6))
def test_differencing(weights, parts):
    got = sharding.difference(weights, parts)
    assert len(got) == len(weights) and all(0 <= p < parts for p in got)


def plain_differencing(weights, parts):
    """Karmarkar-Karp on lists: the sums of the parts, in order."""
    partial = [sorted([w] + [0] * (parts - 1)) for w in weights]
    while len(partial) > 1:
        partial.sort(key=lambda p: p[0] - p[-1])  # the largest spread first
        a, b = partial.pop(0), partial.pop(0)
        partial.append(sorted(x + y for x, y in zip(a, reversed(b), strict=True)))
    return partial[0]


@pytest.mark.parametrize("seed", range(20))
def test_differencing_is_karmarkar_karp(seed):
    from chronoloom.llm import packing

    rng = np.random.default_rng(seed)
    weights, parts = rng.integers(1, 1 << 40, rng.integers(1, 60)), int(rng.integers(1, 9))
    want = plain_differencing(weights.tolist(), parts)
    for difference in (lambda: sharding.difference(weights.tolist(), parts), lambda: packing.difference(weights, parts)):
        sums = [0] * parts
        for w, p in zip(weights.tolist(), difference(), strict=True):
            sums[p] += w
        assert sorted(sums) == want


def test_differencing_balances():
    assert sorted(np.bincount(sharding.difference([8, 7, 6, 5, 4], 2), [8, 7, 6, 5, 4])) == [14, 16]  # the textbook case
    w = np.random.default_rng(0).integers(1, 1000, 2000)
    sums = np.bincount(sharding.difference(w.tolist(), 24), w)
    assert np.ptp(sums) <= 3


def test_shards(spark, corpus, odd, nothing):
    for docs, shards in ((corpus, 24), (odd, 3)):
        rows = docs.collect()
        got = sharding.shard_by_bytes(docs, shards, cell_rows=4).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows)
        for s in {r.shard for r in got}:
            assert 0 <= s < shards and sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        groups = defaultdict(set)
        for r in got:
            groups[r.text_hash].add(r.shard)
        assert all(len(g) == 1 for g in groups.values()) and all(r.grown_shard is None and r.law == "bytes" for r in got)
        sums = Counter()
        for r in got:
            sums[r.shard] += r["size"]
        largest = max(Counter({h: sum(r["size"] for r in got if r.text_hash == h) for h in groups}).values())
        assert max(sums.values()) <= max(largest, sum(sums.values()) / shards * 1.2)
    assert sharding.shard_by_bytes(nothing).count() == 0
    same = frame(spark, [(7, "the same", "s")] * 300 + [(None, "the same", "s")] * 100 + [(8, "the same", "s"), (9, "another", "s")])
    got = sharding.shard_by_bytes(same, 2, cell_rows=4).collect()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len(got) == 402 and len({r.shard for r in got if r.text_hash == got[0].text_hash}) == 1


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha string, n int")


def test_warc_round_trip(spark):
    rows = [(i, f"http://h/{i}", f"<p>page {i % 7}</p>é" * (1 + i % 7)) for i in range(40)]
    rows += [(100, None, None), (101, "http://h/\r\nx", ""), (None, "u", "alone"), (None, "u", "<p>page 0</p>é"), (102, "u", "WARC/1.1\r\nfake: 1\r\n\r\n"), (103, "u", "twice"), (103, "u", "twice")]
    archives = warc.write(warc.with_roles(pages(spark, rows)), archive_bytes=1500)
    got = warc.read(archives).collect()
    assert all(r.kind == "record" for r in got) and len(got) == len(rows) and archives.count() > 2
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", -1), i)
    want = Counter()
    for i, _, h in rows:
        body = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        to = last.get(h or "")
        revisit = to is not None and i != to
        want[(i, len(body), digest, "revisit" if revisit else "response", to if revisit else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == {(h or "").encode() for _, _, h in rows}
    assert warc.read(warc.write(warc.with_roles(pages(spark, [])))).count() == 0


@pytest.fixture(scope="module")
def archive():
    bodies = [f"<html>{i}</html>".encode() * (3 + i) + b"\nWARC/1.0\r\nnot a record" for i in range(12)]
    plain = [warc.record(i, f"http://h/{i}", b, warc.sha1(b)) for i, b in enumerate(bodies)]
    packed = []
    for p in plain:
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed.append(c.compress(p) + c.flush())
    return plain, packed


@pytest.mark.parametrize("kind", [0, 1])
def test_salvage(archive, kind):
    parts = archive[kind]
    whole = b"".join(parts)
    ends = np.cumsum([0, *map(len, parts)])
    records, gaps = warc.salvage(whole)
    assert len(records) == 12 and not gaps
    for damage in ("flip", "cut", "zero", "insert"):
        start, stop = int(ends[4]), int(ends[5])
        mid = (start + stop) // 2
        data = {
            "flip": whole[:mid] + bytes([whole[mid] ^ 0xFF]) + whole[mid + 1 :], "cut": whole[:mid] + whole[stop:],
            "zero": whole[:start] + bytes(stop - start) + whole[stop:], "insert": whole[:start] + b"garbage WARC/1.0 \x1f\x8b\x08 more" + whole[start:],
        }[damage]
        records, gaps = warc.salvage(data)
        ids = [warc._page(h["warc-record-id"]) for _, h, _ in records]
        assert ids == [i for i in range(12) if i != 4 or damage == "insert"], damage
        assert len(gaps) == 1 and gaps[0][0] >= start and gaps[0][2]
        next_at = data.find(parts[4 if damage == "insert" else 5], start)
        assert gaps[0][1] == next_at
    records, gaps = warc.salvage(whole[:-10])
    assert len(records) == 11 and gaps[-1][1] == len(whole) - 10
    assert warc.salvage(b"") == ([], []) and warc.salvage(b"rubbish")[1] == [(0, 7, "no version line")]


def test_salvage_inside_a_member(archive):
    """Of several records in one gzip member a damaged one is lost alone."""
    plain, packed = archive
    bad = plain[4].replace(b"<html>4", b"<html>5", 1)
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    one = c.compress(b"".join([*plain[:4], bad, *plain[5:]])) + c.flush()
    records, gaps = warc.salvage(packed[0] + one + packed[1])
    assert [warc._page(h["warc-record-id"]) for _, h, _ in records] == [0, *[i for i in range(12) if i != 4], 1]
    start = sum(map(len, plain[:4]))
    assert gaps == [(len(packed[0]), len(packed[0]) + len(one), f"the block digest differs (bytes {start} to {start + len(bad)} of the member's content)")]


def pack(*parts):
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(b"".join(parts)) + c.flush()


def page_ids(records):
    return [warc._page(h["warc-record-id"]) for _, h, _ in records]


def test_salvage_of_cut_members(archive):
    """A member of ten records that is cut short, or breaks off in the middle, gives all whole records before the fault; one gap is logged."""
    rng = np.random.default_rng(0)
    bodies = [rng.integers(0, 256, 3000).astype(np.uint8).tobytes() for _ in range(10)]
    plain = [warc.record(i, f"http://h/{i}", b, warc.sha1(b)) for i, b in enumerate(bodies)]
    one, after = pack(*plain), pack(archive[0][11])
    records, gaps = warc.salvage(one[:-40])
    assert page_ids(records) == list(range(9)) and [g[:2] for g in gaps] == [(0, len(one) - 40)] and "doesn't end" in gaps[0][2]
    assert f"bytes {sum(map(len, plain[:9]))} to " in gaps[0][2]
    records, gaps = warc.salvage(one[: len(one) // 2] + after + after)
    assert page_ids(records) == [0, 1, 2, 3, 11, 11] and [g[:2] for g in gaps] == [(0, len(one) // 2)]
    damaged = bytearray(b"".join(plain))
    damaged[sum(map(len, plain[:4])) + 1000] ^= 1
    records, gaps = warc.salvage(pack(bytes(damaged)) + after)
    assert page_ids(records) == [0, 1, 2, 3, 5, 6, 7, 8, 9, 11] and len(gaps) == 1


def test_salvage_holds_one_record(archive):
    """A stream of many records: what is held stays near a record's size, whether one member, many, or none."""
    import tracemalloc

    body = np.random.default_rng(1).integers(0, 256, 100_000).astype(np.uint8).tobytes()
    plain = [warc.record(i, f"http://h/{i}", body, warc.sha1(body)) for i in range(300)]
    for data in (b"".join(plain), pack(*plain), b"".join(map(pack, plain))):
        tracemalloc.start()
        n = sum(x[0] == "record" for x in warc.scan(warc.Archive(pa.BufferReader(data))))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == 300 and most < 5_000_000 < len(data) / 5
    records, gaps = warc.salvage(plain[0] + warc.record(1, "u", body * 3, warc.sha1(body * 3)) + plain[2], most=200_000)
    assert page_ids(records) == [0, 2] and "longer than" in gaps[0][2]


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_mixing_plan(spark, corpus, odd, nothing):
    for docs in (corpus, odd):
        rows = docs.collect()
        got = mixing.plan(docs).collect()
        assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r.doc_id, words(r.text)) for r in rows)
        sizes, taken, target = Counter(), Counter(), {}
        for r in got:
            sizes[r.source] += r["size"]
            taken[r.source] += r.taken
            target[r.source] = r.target
            assert 0 <= r.taken <= 2 * r["size"] and 0 <= r.position <= 1
        names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        total, fixed, want = 1.5 * sum(sizes.values()), {}, {}
        while True:  # share, cap what is above, share the rest anew
            free = [s for s in names if s not in fixed]
            rest = total - sum(fixed.values())
            want = fixed | {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
            above = [s for s in free if want[s] > 2 * sizes[s] + 1e-9]
            if not above:
                break
            fixed |= {s: 2.0 * sizes[s] for s in above}
        for s in names:
            assert target[s] == pytest.approx(want[s], abs=1e-6) and abs(taken[s] - want[s]) <= 1
        again = mixing.plan(docs).collect()
        assert Counter((r.doc_id, r["size"], r.taken) for r in got) == Counter((r.doc_id, r["size"], r.taken) for r in again)
    assert mixing.plan(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_mixing_emits_what_it_plans(spark, corpus):
    plan = Counter()
    for r in mixing.plan(corpus).collect():
        plan[r.source] += r.taken
    out = mixing.mix(corpus)
    assert out.columns == corpus.columns
    got = Counter()
    for r in out.collect():
        got[r.source] += words(r.text)
    assert +got == +plan


def test_positions_follow_the_demand(spark):
    """The integral of the schedule up to a document's position is the share of the target given before it."""
    from pyspark.sql import functions as F

    f, k = mixing.FACTORS[0], mixing.KNOTS
    given_ = np.linspace(0, 1, 41)
    df = spark.createDataFrame([(float(g),) for g in given_], "g double")
    t = np.array([r.t for r in df.select(mixing.inverse_demand(F.col("g"), F.lit(0)).alias("t")).collect()])
    area = np.array([np.trapezoid(np.interp(np.linspace(0, e, 4001), k, f), np.linspace(0, e, 4001)) for e in t])
    np.testing.assert_allclose(area / np.trapezoid(f, k), given_, atol=1e-6)
    assert (np.diff(t) > 0).all()
    docs = frame(spark, [(i, f"w{i} " * 10, f"s{i % 2}") for i in range(300)])
    order = [r.source for r in mixing.mix(docs).collect()]
    half = len(order) // 2
    assert order[:half].count("s0") > order[half:].count("s0")  # the first source is asked for early


def test_pipeline_stages(spark, corpus, tmp_path):
    """Each stage, on what its predecessor kept, does what brute force does."""
    import corpus_pipeline
    from chronoloom.llm import near_dedup, packing
    from tests.llm.test_dedup import line_brute

    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(100)], "doc_id long, quality long, toxic long")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = corpus, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        kept[name] = (docs.collect(), spark.read.parquet(str(tmp_path / name)))
        docs = kept[name][1]
    before, after = kept["quality rules"]
    trees, threshold = quality.train(corpus, labels)
    want = [r for r in before if (s := brute_statistics(r.text))[0] >= 50 and 100 * s[4] <= 50 * s[0] and trees.score(np.array([quality.statistics(r.text)[5]]))[0] >= threshold]
    assert Counter(want) == Counter(after.collect())
    before, after = kept["line dedup"]
    seen, s = line_brute(before)
    first = {}
    for x, places in seen.items():
        c = s.find(x)
        first[c] = min(first.get(c, (1 << 62, 0)), min((d, i) for d, i, _ in places))
    for r in after.collect():
        (old,) = [b for b in before if b.doc_id == r.doc_id]
        assert r.text == "\n".join(x for i, x in enumerate(old.text.split("\n")) if x not in seen or first[s.find(x)] == (r.doc_id, i))
    before, after = kept["near dedup"]
    classes = near_dedup.near_classes(spark.createDataFrame(before, corpus.schema)).filter("kept").count()
    assert after.count() == classes <= len(before) and set(after.collect()) <= set(before)
    before, after = kept["mixing"]
    plan = mixing.plan(spark.createDataFrame(before, corpus.schema)).collect()
    assert sum(r.taken for r in plan) == sum(words(r.text) for r in after.collect())
    before, after = kept["packing"]
    from tests.llm.test_tokens import check_pieces, pieces_of

    check_pieces([r.asDict() for r in after.collect()], pieces_of(spark.createDataFrame(before, corpus.schema), packing.END))


def test_very_long_texts(spark):
    """A text of three megabytes beside short ones: every operator takes it whole."""
    import random

    from chronoloom.llm import exact_dedup, near_dedup, packing, token_counts, token_matrix
    from chronoloom.llm.tokens import byte_bpe
    from tests.llm.conftest import prose

    rng = random.Random(21)
    long = " ".join(prose(rng, 4000) for _ in range(170))
    other = long[: len(long) // 2] + " changed " + long[len(long) // 2 :]
    assert len(long.encode()) > 3_000_000
    texts = [(1, long), (2, other), (3, "a short one " * 20), (4, "x" * 3_000_000), (5, None)]
    docs = frame(spark, [(i, t, "s") for i, t in texts])
    n_ids = {i: len(byte_bpe().ids(t)) + 1 for i, t in texts}
    for rows in (packing.pack(docs).groupBy("doc_id").sum("length").collect(), token_matrix.read(token_matrix.write(docs)).groupBy("doc_id").sum("length").collect()):
        assert {r[0]: r[1] for r in rows} == n_ids
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()}
    model = token_counts.unigram(f"{token_counts.FOLDER}/piece_bpe_32k.model")
    assert counts == {i: model.count(t)[0] for i, t in texts}
    classes = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    assert classes == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    stats = {r.doc_id: (r.n_words, r.word_chars) for r in quality.apply(docs, quality.Trees(), 0.0).collect()}
    assert stats == {i: (words(t), sum(map(len, (t or "").split()))) for i, t in texts}
    assert {r.doc_id for r in exact_dedup.dedup(docs).filter("kept").collect()} == {1, 2, 3, 4, 5}
    shards = sharding.shard_by_bytes(docs, 3).collect()
    assert {r.doc_id: r["size"] for r in shards} == {i: len((t or "").encode()) + 8 for i, t in texts}
    assert {r.doc_id: r["size"] for r in mixing.plan(docs).collect()} == {i: words(t) for i, t in texts}
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    read = {r.page_id: r.payload_bytes for r in warc.read(warc.write(warc.with_roles(pages))).collect()}
    assert read == {i: len((t or "").encode()) for i, t in texts}


#: The first columns that each registered query returns, where its contract names them.
CONTRACT = {
    "op5_": "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
    "op6_": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op7_": "page_id:bigint payload_bytes:bigint payload_digest:string record_type:string refers_to:bigint",
    "op8_": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
    "op9_": "doc_id:bigint keep_id:bigint group_size:bigint kept:boolean text_sha256:string",
    "op10_": "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
}


def test_registered_queries(spark, corpus, tmp_path):
    """Every registered query and the pipeline's run, over small tables of their own: the contract's columns, a row per document where it asks for that."""
    import corpus_pipeline
    from chronoloom.llm import queries

    docs = corpus.filter("doc_id < 1010 or doc_id > 3000").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("int").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + i, i % 2, 0) for i in range(100)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    docs.select(F.col("doc_id").alias("page_id"), F.lit("http://h/").alias("url"), F.col("text").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    n, found = docs.count(), queries.queries()
    assert [k.split("_")[0] for k in found] == [f"op{i}" for i in range(1, 11)]
    for name, query in found.items():
        out = query(spark, str(tmp_path))
        names = [f"{k}:{v}" for k, v in out.dtypes]
        for prefix, want in CONTRACT.items():
            if name.startswith(prefix):
                assert names[: len(want.split())] == want.split() or set(want.split()) <= set(names), name
        rows = out.count()
        assert rows == n if name.split("_")[0] not in ("op3", "op4", "op10") else rows >= n, name
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert packed and {r.doc_id for r in packed} <= {r.doc_id for r in docs.collect()}
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "mixing", "packing"]
