"""Packing documents into windows by Karmarkar-Karp multiway differencing.

A document is its token ids and the id 1. Whole windows are cut off its front first; what is left, in pieces of at most
``piece`` tokens, is shared among windows so that they are near equal: partial partitions of the largest spread are
merged, the fullest windows of one with the emptiest of the other. Where a window exceeds the capacity, the number of
windows rises and the differencing begins anew. Each task packs its rows block by block, about ``block`` tokens at a time,
so its memory is bounded. The pieces of its last block, which may be too few to share well, are dealt out again, by a hash, to tasks of about
``block`` tokens: padding doesn't depend on how the input is partitioned. Only those rows are shuffled; a hot key can't arise.

Sequences are padded to the capacity, but one whose length is a power of two is left as it is.

Defined results: a null text counts as empty, giving the id 1 only. Repeated rows are packed each. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, as_text, save
from .tokens import FOLDER, byte_bpe

CAPACITY = 2048
END = 1


def difference(lengths: np.ndarray, m: int) -> np.ndarray:
    """The window, 0 to m-1, of each length, by Karmarkar-Karp differencing into m windows.

    A partial partition is its non-empty windows' sums in falling order, each with one member; the others are empty. While single
    lengths are the two largest spreads they only stand side by side, so a run of them, up to m, is put together at once.
    """
    n = len(lengths)
    if m == 1:
        return np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    single, parent, tie, at = lengths[order].astype(np.int64), np.arange(n), count(), 0
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def push(sums: np.ndarray, members: np.ndarray) -> None:
        spread = int(sums[0] - (sums[-1] if len(sums) == m else 0))
        heapq.heappush(heap, (-spread, next(tie), sums, members))

    while at < n or len(heap) > 1:
        top = -heap[0][0] if heap else -1
        if at < n and single[at] > top:
            end = min(at + m, at + int(np.searchsorted(-single[at:], -top, "right")))
            push(single[at:end], order[at:end])
            at = end
            continue
        _, _, a, i = heapq.heappop(heap)
        if at < n and (not heap or single[at] >= -heap[0][0]):
            b, j, at = single[at : at + 1], order[at : at + 1], at + 1
        else:
            _, _, b, j = heapq.heappop(heap)
        if len(a) + len(b) <= m:
            sums, members = np.concatenate([a, b]), np.concatenate([i, j])
        else:
            sums, members = np.zeros(m, np.int64), np.full(m, -1)
            sums[: len(a)], members[: len(a)] = a, i
            sums[m - len(b) :] += b[::-1]  # opposite order
            met = members[m - len(b) :]
            both = met >= 0
            parent[j[::-1][both]] = met[both]
            members[m - len(b) :] = np.where(both, met, j[::-1])
        by = np.argsort(-sums, kind="stable")
        push(sums[by], members[by])
    while True:  # each member to its window's first
        up = parent[parent]
        if (up == parent).all():
            break
        parent = up
    window = np.full(n, -1)
    window[heap[0][3]] = np.arange(len(heap[0][3]))
    return window[parent]


def windows(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each piece; no window exceeds the capacity, which each piece must fit."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    m = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        window = difference(lengths, m)
        most = int(np.bincount(window, lengths, m).max())
        if most <= capacity:
            return window
        m = max(m + 1, min(len(lengths), m * most // capacity))


def cut(tokens: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, then equal pieces of the rest."""
    whole = tokens // capacity
    out = [(k * capacity, capacity) for k in range(whole)]
    rest = tokens - whole * capacity
    n = -(-rest // piece)
    at = whole * capacity
    for k in range(n):
        length = rest // n + (k < rest % n)
        out.append((at, length))
        at += length
    return out


SCHEMA = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
#: Sequence ids of the pieces that are dealt out again begin here.
SECOND = 1 << 62


def placed(rows: pd.DataFrame, capacity: int, first: int) -> pd.DataFrame:
    """The pieces with their windows, numbered from ``first``, in order of window, and their places in them."""
    length = rows["length"].to_numpy(np.int64)
    full = length == capacity
    window = np.zeros(len(rows), np.int64)
    window[full] = np.arange(full.sum())
    window[~full] = full.sum() + windows(length[~full], capacity)
    order = np.argsort(window, kind="stable")
    out, window, length = rows.iloc[order].copy(), window[order], length[order]
    before = np.cumsum(length) - length
    out["sequence_id"] = first + window
    out["offset"] = before - before[np.searchsorted(window, window)]
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, piece: int = 170, block: int = 500_000, folder: str = FOLDER) -> DataFrame:
    """One row per piece, with its place in its sequence; sequence ids are the task's number times 2**33 and a count."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(folder)
        first = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        held = 0
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].array, pdf["text"], strict=True):
                ids = np.append(bpe.ids(text), np.array([END], "<u4")).astype("<u4", copy=False)
                rows += [(doc_id, s, n, zlib.crc32(ids[s : s + n]), len(ids)) for s, n in cut(len(ids), capacity, piece)]
                held += len(ids)
                if held >= block:
                    out = placed(pd.DataFrame(rows, columns=PIECE), capacity, first)
                    first = int(out["sequence_id"].iloc[-1]) + 1
                    yield out
                    rows, held = [], 0
        if rows:  # whole windows are done; of the others the place is their number in the task, for now
            left = pd.DataFrame(rows, columns=PIECE)
            full = left["length"] == capacity
            if full.any():
                yield placed(left[full], capacity, first)
            if not full.all():
                yield left[~full].assign(sequence_id=pd.NA, offset=(TaskContext.get().partitionId() << 33) + np.arange((~full).sum())).astype({"sequence_id": "Int64"})

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [pdf[PIECE] for pdf in batches if len(pdf)]  # about a block
        if rows:
            yield placed(pd.concat(rows), capacity, SECOND + (TaskContext.get().partitionId() << 33))

    out = save(docs.select(as_text("doc_id"), "text").mapInPandas(packed, SCHEMA), "packed")
    left = out.filter("sequence_id is null")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    second = left.repartition(max(1, round(tokens / block)), "offset").mapInPandas(again, SCHEMA)
    return as_long(out.filter("sequence_id is not null").unionByName(second), "doc_id")
