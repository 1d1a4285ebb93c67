"""Token ids, counts, packing and id matrices against the tokenizers library and exact round trips."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.llm import packing, token_counts, token_matrix
from chronoloom.llm.tokens import FOLDER, byte_bpe
from tests.llm.conftest import ODD

MODEL = f"{FOLDER}/piece_bpe_32k.model"
texts = st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab é\n\t .,'s1▁😀", max_size=40)


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")


@settings(max_examples=300, deadline=None)
@given(texts)
def test_ids_are_the_tokenizers(whole, text):
    assert byte_bpe().ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_ids_of_odd_texts(whole, corpus):
    for r in corpus.collect():
        assert byte_bpe().ids(r.text).tolist() == whole.encode(r.text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module", params=[("zipf", True), ("file", True), ("zipf", False)])
def models(request):
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    scores, fallback = request.param
    vocab = token_counts.vocabulary(MODEL, scores)
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    return t, token_counts.Unigram(vocab, fallback)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_counts_are_the_viterbis(models, text):
    t, u = models
    assert u.count(text)[0] == len(t.encode(text, add_special_tokens=False).ids)


def test_count_query(spark, corpus, nothing, models):
    t, _ = models
    got = token_counts.count_tokens(corpus).collect()
    assert len(got) == corpus.count() and 9007199254740993 in {r.doc_id for r in got}
    if models[1].byte_fallback and models[1].unknown < -15 and models[1].unknown > -100:
        want = sorted(len(t.encode(r.text or "", add_special_tokens=False).ids) for r in corpus.collect())
        assert sorted(r.n_tokens for r in got) == want
    assert token_counts.count_tokens(nothing).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 512), min_size=1, max_size=120))
def test_windows_hold_the_capacity(lengths):
    w = packing.windows(np.array(lengths), 512)
    sums = np.bincount(w, lengths)
    assert sums.max() <= 512 and len(w) == len(lengths)


def test_differencing_is_near_equal():
    rng = np.random.default_rng(0)
    lengths = rng.integers(100, 513, 1500)
    sums = np.bincount(packing.difference(lengths, 200), lengths, 200)
    assert np.ptp(sums) <= 60
    assert len(np.unique(packing.windows(lengths))) * 2048 <= 1.03 * lengths.sum() + 2048


def pieces_of(corpus, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    return [(r.doc_id, np.array([*t.encode(r.text or "", add_special_tokens=False).ids, end], "<u4")) for r in corpus.collect()]


def test_packing_round_trip(corpus, odd, nothing):
    for docs in (corpus, odd):
        got = [r.asDict() for r in packing.pack(docs, block=20_000).collect()]
        check_pieces(got, pieces_of(docs, 1))
        by = defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append(r)
        for rows in by.values():
            rows.sort(key=lambda r: r["offset"])
            at = 0
            for r in rows:
                assert r["offset"] == at
                at += r["length"]
            assert at <= packing.CAPACITY
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_padding_does_not_depend_on_partitions(spark, partitions):
    """Near-equal windows that are at least 98 % full, however the input is dealt."""
    import random

    from tests.llm.conftest import frame, prose

    rng = random.Random(13)
    docs = frame(spark, [(i, prose(rng, rng.choice([10, 60, 200, 900])), "s") for i in range(1200)]).repartition(partitions, "doc_id")
    got = packing.pack(docs, block=200_000).groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    assert got.max() <= 2048 and got.sum() >= 0.98 * 2048 * len(got)


def check_pieces(got, docs):
    """Each id of each document lies in exactly one piece, told by CRCs."""
    left = defaultdict(int)
    for doc, ids in docs:
        left[(doc, len(ids))] += 1
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    known = defaultdict(list)
    for doc, ids in docs:
        known[doc].append(ids)
    for doc, rows in by.items():
        assert sum(r["length"] for r in rows) == sum(map(len, known[doc]))
        for r in rows:
            assert any(zlib.crc32(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] and r.get("doc_tokens", len(ids)) == len(ids) for ids in known[doc])
    assert set(by) == set(known)


def test_matrices_round_trip(corpus, nothing):
    manifest = token_matrix.write(corpus, block=20_000)
    got = [r.asDict() for r in token_matrix.read(manifest).collect()]
    check_pieces(got, pieces_of(corpus, token_matrix.END))
    seen = defaultdict(list)
    for r in got:
        seen[(r["matrix"], r["row"])].append((r["offset"], r["length"]))
    for spans in seen.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 2048
    assert token_matrix.read(token_matrix.write(nothing)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_decreasing(lengths):
    windows = token_matrix.best_fit_decreasing(lengths, 64)
    free, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [(f, w) for w, f in enumerate(free) if f >= lengths[i]]
        if fits:
            least = min(f for f, _ in fits)
            want[i] = least
            w = next(w for f, w in fits if f == least)
        else:
            free.append(64)
            want[i] = 64
            w = len(free) - 1
        free[w] -= lengths[i]
    assert len(set(windows)) == len(free)
    sums = defaultdict(int)
    for w, n in zip(windows, lengths, strict=True):
        sums[w] += n
    assert sorted(64 - s for s in sums.values()) == sorted(free)


def test_odd_rows_are_there():
    assert any(t is None for _, t, _ in ODD)


def test_memos_roll_over(models, monkeypatch):
    """With room for three pieces or parts the results are those of a large memo."""
    from chronoloom.llm import tokens

    texts = ["a b c d e a b c f g a", "one two  three four five one two", "ein zwei drei " * 5 + "y" * 200, "a b c d e f g h a b"]
    want = [(tokens.ByteBPE().ids(t).tolist(), token_counts.Unigram([("▁", -2.0), ("a", -1.0), ("▁a", -1.5), ("e", -3.0)]).count(t)) for t in texts]
    monkeypatch.setattr(tokens, "MEMO", 3)
    monkeypatch.setattr(token_counts, "MEMO", 3)
    bpe, unigram = tokens.ByteBPE(), token_counts.Unigram([("▁", -2.0), ("a", -1.0), ("▁a", -1.5), ("e", -3.0)])
    assert [(bpe.ids(t).tolist(), unigram.count(t)) for t in texts] == want
    assert len(bpe.rest) <= 3 >= len(unigram.memo) and bpe.rest.older and unigram.older
