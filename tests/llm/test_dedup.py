"""Exact, near and line dedup against brute force."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import common, exact_dedup, line_dedup, links, near_dedup
from tests.llm.conftest import Sets, edited, frame, prose


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [tuple(map(int, rng.integers(200, 320, 2))) for _ in range(90)] + [(7, 7)]
    s = Sets()
    for a, b in edges:
        s.join(a, b)
    got = links.components(spark.createDataFrame(edges, "a long, b long")).toPandas()
    ids = {i for e in edges for i in e if e[0] != e[1]}
    assert got["id"].is_unique and set(got["id"]) == ids
    assert {frozenset(g["id"]) for _, g in got.groupby("comp")} == s.groups(ids)
    assert (got.groupby("comp")["id"].min() == got.groupby("comp")["comp"].first()).all()
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact(spark, corpus, odd, nothing):
    for docs in (corpus, odd):
        rows = docs.collect()
        groups = defaultdict(list)
        for r in rows:
            groups[lower(r.text)].append(r.doc_id)
        got = exact_dedup.dedup(docs).collect()
        assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
        import hashlib

        for t, ids in groups.items():
            mine = [r for r in got if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
            most = max((i for i in ids if i is not None), default=None)
            assert Counter(r.doc_id for r in mine) == Counter(ids)
            assert all(r.keep_id == most and r.group_size == len(ids) for r in mine) and [r.doc_id for r in mine if r.kept] == [most]
    assert exact_dedup.dedup(nothing).count() == 0


def test_exact_index_persists(spark, tmp_path):
    path = "file://" + str(tmp_path / "index")
    first = frame(spark, [(1, "a b", "s"), (2, "A B", "s"), (3, "c", "s")])
    second = frame(spark, [(9, "a B", "s"), (8, "d", "s"), (7, "d", "s")])
    assert {r.doc_id for r in exact_dedup.dedup(first, exact_dedup.DigestIndex(spark, path, 4), "1").filter("kept").collect()} == {2, 3}
    again = exact_dedup.DigestIndex(spark, path, 4)  # as another session would open it
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup(second, again, "2").collect()}
    assert got == {9: (2, False), 8: (8, True), 7: (8, False)}
    assert again.table().count() == 3
    plan = again.unseen(spark.createDataFrame([("x", 1)], "text_sha256 string, keep_id long"))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_exact_index_runs(spark, tmp_path, monkeypatch):
    """Runs are sorted by bucket, one file each, so that joins neither shuffle nor sort them; many are merged; half-written ones don't count."""
    path = "file://" + str(tmp_path / "index")
    monkeypatch.setattr(exact_dedup, "MOST_RUNS", 4)
    seen = {}
    for k in range(6):
        docs = frame(spark, [(100 * k + i, f"text {(7 * k + i) % 60}", "s") for i in range(20)])
        got = exact_dedup.dedup(docs, exact_dedup.DigestIndex(spark, path, 4 if k == 0 else None), str(k)).collect()
        for r in got:
            text = f"text {(7 * k + r.doc_id - 100 * k) % 60}"
            assert (r.kept, r.keep_id) == ((False, seen[text]) if text in seen else (True, r.doc_id))
        seen |= {f"text {(7 * k + i) % 60}": 100 * k + i for i in range(20) if f"text {(7 * k + i) % 60}" not in seen}
        runs = exact_dedup.DigestIndex(spark, path).runs()
        assert len(runs) == (k + 1 if k < 3 else k - 2)
    index = exact_dedup.DigestIndex(spark, path)
    assert index.buckets == 4 and index.table().count() == len(seen) == 55
    (tmp_path / "index" / "run-000099-4-broken").mkdir()
    assert len(index.runs()) == 3
    for r in index.runs():
        files = [f.name for f in (tmp_path / "index" / r).glob("*.parquet")]
        assert len({f.split("_")[-1] for f in files}) == len(files)
    with exact_dedup.settings(spark, exact_dedup.ORDERED):
        many = spark.range(100).select(F.sha2(F.col("id").cast("string"), 256).alias("text_sha256"), F.col("id").alias("keep_id"))
        plan = index.unseen(many)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange") == plan.count("Sort [") == 1
    assert exact_dedup.DigestIndex(spark, path + "-none", expected=10**11).size_for(5) is None
    large = exact_dedup.DigestIndex(spark, path + "-none", expected=10**11)
    large.size_for(5)
    assert large.buckets == 50_000


def test_exact_index_without_batch_names(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, "file://" + str(tmp_path / "index"), 4)
    docs = frame(spark, [(1, "a b", "s"), (2, "c", "s")])
    assert exact_dedup.dedup(docs, index).filter("kept").count() == 2
    assert exact_dedup.dedup(docs, index).filter("kept").count() == 0
    exact_dedup.dedup(frame(spark, [(3, "d", "s")]), index, "1")
    with pytest.raises(ValueError, match="already holds"):
        exact_dedup.dedup(docs, index, "1")


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    h.sort()
    a, b = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    a[:60], b[240:] = 0, 0
    got = near_dedup.samples(np.concatenate([h[60:], h[:240]]), np.concatenate([a[60:], b[:240]]), np.array([0, 240]), 1500)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert (got[0] == got[1]).mean() == pytest.approx(want, abs=0.04)


def test_near(spark, corpus, odd, nothing):
    o = near_dedup.Options()
    rows = corpus.collect()
    weights = near_dedup.idf(*near_dedup.document_frequencies(corpus, o.shingle, o.features))
    seen: Counter = Counter()
    for r in rows:
        seen.update(np.unique(near_dedup.slots(near_dedup.shingled(r.text, 5)[0], o.features)).tolist())
    df, n = near_dedup.document_frequencies(corpus, o.shingle, o.features)
    assert n == len(rows) and {i: int(df[i]) for i in np.flatnonzero(df)} == dict(seen)
    texts = sorted({r.text or "" for r in rows})
    sets = {t: plain_shingles(t) for t in texts}
    s = Sets()
    for a, b in combinations([t for t in texts if sets[t]], 2):
        w = lambda x: weights[near_dedup.slots(np.array([x], np.uint64), o.features)][0]
        both = sets[a].keys() & sets[b].keys()
        if not both:
            continue
        low = sum(min(sets[a][x], sets[b][x]) * w(x) for x in both)
        total = sum(sets[a][x] * w(x) for x in sets[a]) + sum(sets[b][x] * w(x) for x in sets[b])
        if low >= 0.8 * (total - low):
            s.join(a, b)
    got = near_dedup.near_classes(corpus).toPandas()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for r in rows:
        want[s.find(r.text or "")].append(r.doc_id)
    classes = Counter()
    for ids in want.values():
        known = [i for i in ids if i is not None]
        classes[(min(known) if known else None, len(ids))] += len(ids)
    mine = Counter((None if np.isnan(c) else int(c), int(z)) for c, z in zip(got["class_id"].astype(float), got["class_size"], strict=True))
    loose = lambda c: Counter({(None if k[0] is None else float(k[0]), k[1]): v for k, v in c.items()})
    assert loose(mine) == loose(classes)
    assert got["kept"].sum() == len(want)
    assert len(s.groups(texts)) < len(texts) - 60  # the planted copies are found
    assert near_dedup.dedup(corpus).count() == len(want) and near_dedup.dedup(corpus).columns == corpus.columns
    assert near_dedup.near_classes(nothing).count() == 0 and near_dedup.dedup(nothing).count() == 0
    assert near_dedup.dedup(odd).filter("text = ''").count() + near_dedup.dedup(odd).filter("text is null").count() == 1


def test_idf_at_scale():
    """200,000 documents of 300 shingles, one in a hundred of them common: rare ones weigh near 2, common ones as their frequency says."""
    rng = np.random.default_rng(2)
    n, size = 200_000, near_dedup.FEATURES
    rare = rng.integers(0, size, n * 300)
    counts = np.bincount(rare, minlength=size).astype(np.int64)
    common = rng.choice(size, 200, replace=False)
    true = rng.integers(2_000, 100_000, 200)
    counts[common] += true
    got = near_dedup.idf(counts, n)
    want = 1 + np.log((1 + n) / (1 + true)) / np.log(2 + n)
    assert np.abs(got[common] - want).max() < 0.01
    exact = 1 + np.log((1 + n) / 2) / np.log(2 + n)
    others = np.delete(got, common)
    assert (others > exact - 1e-3).mean() > 0.99 and others.min() > 1.7 > got[common].max()
    one = np.zeros(size, np.int64)
    one[:3] = 1, 2, 50
    np.testing.assert_allclose(near_dedup.idf(one, 99)[:3], 1 + np.log(100 / (1 + np.array([1, 2, 50]))) / np.log(101), rtol=1e-4)


def plain_shingles(t):
    h, n = near_dedup.shingled(t, 5)
    return dict(zip(h.tolist(), n.tolist(), strict=True))


def test_shingles_are_word_runs():
    h, n = near_dedup.shingled("a b c d e f a b c d e", 5)
    assert n.sum() == 7 and sorted(n) == [1, 1, 1, 1, 1, 2]
    assert near_dedup.shingled("A b  C\td e", 5)[0].tolist() == near_dedup.shingled("a B c d E", 5)[0].tolist()
    assert len(near_dedup.shingled("one two", 5)[0]) == 1 and len(near_dedup.shingled(None, 5)[0]) == 0


def character_sets(x, n=8):
    return {x[i : i + n] for i in range(max(1, len(x) - n + 1))}


def line_brute(rows):
    """The kept places of each document, and the classes of lines: every line with a word, all its character shingles."""
    seen = {}
    for r in rows:
        for i, x in enumerate((r.text or "").split("\n")):
            if x.strip(" \t\n\v\f\r"):
                seen.setdefault(x, []).append((r.doc_id, i, r.text))
    s, sets = Sets(), {x: character_sets(x) for x in seen}
    for a, b in combinations(seen, 2):
        p, q = sets[a], sets[b]
        if 4 * len(q) <= 5 * len(p) and 4 * len(p) <= 5 * len(q) and 5 * len(p & q) >= 4 * len(p | q):
            s.join(a, b)
    return seen, s


def test_lines(spark, corpus, odd, nothing):
    import random

    rng = random.Random(3)
    run = "".join(rng.choice("abcdefgh") for _ in range(400))  # without a space
    extra = [(5000 + j, run[:j] + "z" + run[j + 1 :], "s") for j in range(0, 40, 8)] + [(5100, run[:200] + " " + run[200:], "s"), (5101, "short\nshort", "s")]
    docs = corpus.unionByName(frame(spark, extra))
    rows = docs.collect()
    seen, s = line_brute(rows)
    got = line_dedup.line_classes(docs).toPandas()
    assert len(got) == sum(len((r.text or "").split("\n")) for r in rows)
    texts = {(None if r.doc_id is None else r.doc_id, i): x for r in rows for i, x in enumerate((r.text or "").split("\n")) if r.doc_id not in (None, 1, 3, 9007199254740993)}
    got = got[got["doc_id"].notna() & ~got["doc_id"].isin([1, 3, 9007199254740992, 9007199254740993])]
    got["line"] = [texts[(int(d), n)] for d, n in zip(got["doc_id"], got["line_no"], strict=True)]
    mine = {frozenset(g["line"]) for _, g in got[got["line"].isin(seen)].groupby("class_hash")}
    there = set(got["line"]) & set(seen)
    assert mine == {frozenset(g & there) for g in s.groups(seen) if g & there}
    for _, g in got[got["line"].isin(seen)].groupby("class_hash"):
        assert g["kept"].sum() <= 1
    assert got[~got["line"].isin(seen)]["kept"].all()
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    kept = Counter(x for r in out.collect() for x in (r.text or "").split("\n") if x in seen)
    assert all(n <= 2 for n in kept.values())  # 2: repeated rows share their verdict
    classes = {s.find(x) for x in kept}
    assert classes == {s.find(x) for x in seen}  # one line of each class is still there
    untouched = {r.doc_id: r.text for r in rows}
    for r in out.collect():
        if r.doc_id == 5101:
            assert r.text == "short" and untouched[5101] == "short\nshort"
    assert line_dedup.line_classes(nothing).count() == 0 and line_dedup.dedup_lines(nothing).count() == 0
    assert line_dedup.dedup_lines(odd).count() == odd.count()


def test_lines_at_all_places(spark, corpus, tmp_path):
    """The query's classes are those of the Jaccard similarity over all character shingles."""
    from chronoloom.llm import queries

    tail = "ingle-unbroken-words-differ at their very ends"
    extra = ["abcdefghijklmnopqrst", "abcdefghijklmnopqrsu", f"s{tail} a", f"s{tail} b", "three wordsofsome lengthy", "three wordsofsome lengthx", "ÄÖÜ😀 ßßéèñ ÿþðœ æø𝒳å", "ÄÖÜ😀 ßßéèñ ÿþðœ æø𝒳ä"]
    docs = corpus.filter("doc_id >= 100 and doc_id < 6000").unionByName(frame(spark, [(7000 + i, x, "s") for i, x in enumerate(extra)]))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = {(r.doc_id, i): x for r in docs.collect() for i, x in enumerate((r.text or "").split("\n"))}
    seen = sorted({x for x in at.values() if x.strip(" \t\n\v\f\r")})
    sets = {x: {x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in seen}
    s = Sets()
    for a, b in combinations(seen, 2):
        p, q = sets[a], sets[b]
        if 4 * len(q) <= 5 * len(p) and 4 * len(p) <= 5 * len(q) and 5 * len(p & q) >= 4 * len(p | q):
            s.join(a, b)
    assert all(s.find(a) == s.find(b) for a, b in zip(extra[::2], extra[1::2], strict=True))
    mine, kept = defaultdict(set), Counter()
    for r in queries.op3_line_dedup(spark, str(tmp_path)).collect():
        x = at[(r.doc_id, r.line_no)]
        if x in sets:
            mine[r.class_hash].add(x)
            kept[r.class_hash] += r.kept
        else:
            assert r.kept
    assert set(map(frozenset, mine.values())) == s.groups(seen)
    assert set(kept.values()) == {1}


def test_short_lines(spark, tmp_path):
    """The query and the pipeline's stage leave one copy of a line however short; blank lines stay."""
    import corpus_pipeline
    from chronoloom.llm import queries

    docs = frame(spark, [(1, "Les.\n\na", "s"), (2, "Les.\n \nLes!", "s"), (3, "a\nLes.\n\n ", "s")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.line_no): r.kept for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert len(got) == 10 and {k for k, kept in got.items() if not kept} == {(2, 0), (3, 0), (3, 1)}
    out = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, str(tmp_path)).collect()}
    assert out == {1: "Les.\n\na", 2: " \nLes!", 3: "\n "}


def test_recall_of_edited_lines(spark):
    """Of edited lines whose similarity is still 0.8 or more, pair by pair without chains, at least 95 % are found."""
    import random

    rng = random.Random(11)
    pairs = []
    while len(pairs) < 400:
        x = prose(rng, rng.choice([4, 8, 15, 30, 60])).replace("\n", " ") + f" {len(pairs)}"
        i = rng.randrange(len(x))
        kind = rng.randrange(4)
        if kind == 0:
            y = x[:i] + "Q" + x[i + 1 :]
        elif kind == 1:
            y = edited(rng, x, 1 + len(x) // 200)
        elif kind == 2:
            y = f"{x} {prose(rng, 1 + len(x) // 40)}".replace("\n", " ")
        else:
            y = x[:i] + x[i + 1 + len(x) // 50 :]
        p, q = character_sets(x), character_sets(y)
        if x != y and 5 * len(p & q) >= 4 * len(p | q):
            pairs.append((x, y))
    docs = frame(spark, [(2 * i + k, t, "s") for i, pair in enumerate(pairs) for k, t in enumerate(pair)])
    got = {r.doc_id: r.class_hash for r in line_dedup.line_classes(docs).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(len(pairs))) >= 0.95 * len(pairs)


def test_a_shingle_writes_one_minimum_and_one_word(spark, corpus):
    """Each shingle's row updates its own bin and its own word of the sketch, in one aggregation; bins and words are those of brute force."""
    from pyspark.sql import functions as F

    lines = line_dedup.lines(corpus.filter("doc_id >= 100 and doc_id < 130")).filter("compared").select("id", "line", "compared").distinct()
    least, sketch = line_dedup.minima(lines, ["id"], 24, 8), line_dedup.sketched(lines, 8)
    for df, n in ((least, 24), (sketch, line_dedup.WORDS)):
        with common.settings(spark, {"spark.sql.debug.maxToStringFields": "1000"}):
            plan = df._jdf.queryExecution().analyzed().toString()
        assert plan.lower().count("filter (where") >= n and plan.count("Aggregate [") == 1
    bins, words = {}, {}
    for r in lines.select("id", F.length("line").alias("n"), line_dedup.at_places(F.col("line"), 8).alias("hashes")).collect():
        places = max(r.n - 7, 1)
        m, s = [None] * 24, [0] * line_dedup.WORDS
        for h in r.hashes:
            high, low, slot = (h & (1 << 64) - 1) >> 32, h & (1 << 32) - 1, h % (64 * line_dedup.WORDS)
            if low < -(-((1 << 32) * line_dedup.DEPTH * 24) // places):
                m[high * 24 >> 32] = min(low, m[high * 24 >> 32] or low)
            s[slot >> 6] |= 1 << (slot & 63)
        bins[r.id], words[r.id] = m, s
    assert {r.id: [r[f"m{j}"] for j in range(24)] for r in least.collect()} == bins
    assert {r.id: [r[f"s{w}"] & (1 << 64) - 1 for w in range(line_dedup.WORDS)] for r in sketch.collect()} == words


def test_lines_with_one_hash_are_told_apart(spark, corpus, monkeypatch):
    """With a first hash of 50 values only, the second one keeps lines apart."""
    from pyspark.sql import functions as F

    docs = corpus.filter("doc_id >= 100 and doc_id < 200")
    want = {(r.doc_id, r.line_no): r.kept for r in line_dedup.line_classes(docs).collect()}
    monkeypatch.setattr(line_dedup, "line_hash", lambda line: F.pmod(F.xxhash64(line), F.lit(50)))
    assert {(r.doc_id, r.line_no): r.kept for r in line_dedup.line_classes(docs).collect()} == want
    monkeypatch.setattr(common, "MOST_COLLISIONS", 10)
    with pytest.raises(ValueError, match="hashes stand for"):
        line_dedup.line_classes(docs)


def test_texts_with_one_hash_are_told_apart(spark, corpus, monkeypatch):
    """The same for documents: classes and what stays don't change."""
    docs = corpus.filter("doc_id >= 1000 and doc_id < 2040")
    classes = lambda: sorted(map(tuple, near_dedup.near_classes(docs).drop("kept").collect()))
    texts = lambda: sorted(r.text for r in near_dedup.dedup(docs).collect())
    want = classes(), texts()
    monkeypatch.setattr(near_dedup, "text_hash", lambda text: F.pmod(F.xxhash64(text), F.lit(20)))
    assert (classes(), texts()) == want


def test_very_long_line(spark):
    """Lines of a megabyte, one of them with characters beyond the first plane."""
    import random

    rng = random.Random(12)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(1_000_000))
    docs = frame(spark, [(1, text, "s"), (2, text[:500_000] + "X" + text[500_000:], "s"), (3, text[::-1], "s"), (4, text[:250_000] + "\U0001d4b3" + text[250_001:], "s")])
    got = {r.doc_id: (r.class_hash, r.kept) for r in line_dedup.line_classes(docs).collect()}
    assert got[1][0] == got[2][0] == got[4][0] != got[3][0] and [got[i][1] for i in (1, 2, 3, 4)] == [True, False, True, False]


def test_no_pairs_of_a_large_group(spark):
    """Near copies of one text, and copies too far from it: rows grow with the group, not with its square, and no link is lost."""
    import random

    rng = random.Random(5)
    text = prose(rng, 150)
    far = [edited(rng, text, 9) for _ in range(12)]
    rows = [(i, edited(rng, text, 1), "hot") for i in range(300)] + [(1000 + i, t, "hot") for i, t in enumerate(far)] + [(2000 + i, t + " more", "hot") for i, t in enumerate(far)]
    asked = []

    def counting(members, tools, **options):
        def wrapped(ids):
            items, verify, compare = tools(ids)

            def counted(f):
                def run(pairs):
                    asked.append(pairs.count())
                    return f(pairs)

                return run

            return items, counted(verify), counted(compare)

        return links.link(members, wrapped, **options)

    near_dedup.link, old = counting, near_dedup.link
    try:
        got = near_dedup.near_classes(frame(spark, rows)).toPandas().set_index("doc_id")["class_id"]
    finally:
        near_dedup.link = old
    assert got.loc[list(range(300))].nunique() == 1
    assert all(got[1000 + i] == got[2000 + i] for i in range(12))
    assert sum(asked) < 324 * 12
