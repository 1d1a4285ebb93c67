"""Packed token-id matrices as binary files: best-fit-decreasing with a segment tree over window capacities.

A document longer than a window is split into whole windows and a rest. The rests of a block, longest first, each go to
the fullest window that still holds them: a segment tree over the free capacities (one leaf per capacity) finds the
smallest sufficient one that occurs. Each task appends its windows to files in the shared folder:

* ``.ids``: the rows of the id matrix, little-endian unsigned 16-bit (32-bit if the vocabulary needs it), padded with the
  end id;
* ``.segments``: for each row a count, then the cumulative segment lengths, 0 first (int32);
* ``.resets``: for each segment the position that its first token has in its document (int64): positions restart there.

A file counts only if the manifest names it; the manifest is written once all tasks have ended, so an attempt that was lost
leaves nothing that is read.

Defined results: a null text counts as empty, giving the end id only. Repeated rows are written each. An empty table gives
an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import as_text, new_path, save
from .tokens import FOLDER, byte_bpe

END = 50256


class Capacities:
    """A segment tree over the capacities 0..size: how many windows have each; the smallest at least as large as asked."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, free: int, window: int) -> None:
        self.open.setdefault(free, []).append(window)
        self._count(free, 1)

    def _count(self, free: int, by: int) -> None:
        i = free + self.leaves
        while i:
            self.tree[i] += by
            i >>= 1

    def take(self, wanted: int) -> tuple[int, int] | None:
        """A window with the smallest free capacity of at least ``wanted``, removed from the tree, or None."""
        i = wanted + self.leaves
        if not self.tree[i]:
            while i > 1 and not (i % 2 == 0 and self.tree[i + 1]):  # up to the first right sibling that holds any
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        free = i - self.leaves
        self._count(free, -1)
        return free, self.open[free].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The window of each piece; pieces of equal length in the order given."""
    tree, window, n = Capacities(capacity), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = tree.take(lengths[i])
        if found is None:
            found, n = (capacity, n), n + 1
        free, at = found
        window[i] = at
        tree.add(free - lengths[i], at)
    return window


MANIFEST = "path string, n_rows long, n_pieces long, width int, capacity int, docs binary, unnamed binary"


def write(docs: DataFrame, capacity: int = 2048, end: int = END, block: int = 1_000_000, folder: str = FOLDER, out: str | None = None) -> DataFrame:
    """Write the matrices; the manifest, one row per block, with the doc_id of each segment in ``docs`` (int64) and
    in ``unnamed`` whether it is null (a byte)."""
    spark = docs.sparkSession
    target = out or new_path(spark, "matrices")
    width = 2 if end < 1 << 16 else 4

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        bpe = byte_bpe(folder)
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal pieces, held
            full = [i for i, p in enumerate(pieces) if len(p[2]) == capacity]
            rest = [i for i, p in enumerate(pieces) if len(p[2]) < capacity]
            rows: list[list[int]] = [[i] for i in full]
            packed = best_fit_decreasing([len(pieces[i][2]) for i in rest], capacity)
            extra: list[list[int]] = [[] for _ in range(max(packed, default=-1) + 1)]
            for i, w in zip(rest, packed, strict=True):
                extra[w].append(i)
            rows += extra
            matrix = np.full((len(rows), capacity), end, f"<u{width}")
            segments, resets, ids = [], [], []
            for r, members in enumerate(rows):
                at, ends = 0, [0]
                for i in members:
                    doc, start, tokens = pieces[i]
                    matrix[r, at : at + len(tokens)] = tokens
                    at += len(tokens)
                    ends.append(at)
                    resets.append(start)
                    ids.append(doc)
                segments += [len(ends), *ends]
            store, base = fs.FileSystem.from_uri(target)
            store.create_dir(base, recursive=True)
            name = uuid.uuid4().hex
            for kind, data in ((".ids", matrix), (".segments", np.array(segments, "<i4")), (".resets", np.array(resets, "<i8"))):
                with store.open_output_stream(f"{base}/{name}{kind}") as f:
                    f.write(data.tobytes())
            out = [(f"{target}/{name}", len(rows), len(ids), width, capacity, np.array([i or 0 for i in ids], "<i8").tobytes(), bytes(i is None for i in ids))]
            pieces, held = [], 0
            return pd.DataFrame(out, columns=["path", "n_rows", "n_pieces", "width", "capacity", "docs", "unnamed"])

        for pdf in batches:
            for doc, text in zip(pdf["doc_id"].array, pdf["text"], strict=True):
                ids = np.append(bpe.ids(text), np.array([end], "<u4")).astype("<u4", copy=False)
                doc = None if pd.isna(doc) else int(doc)
                pieces += [(doc, s, ids[s : s + capacity]) for s in range(0, len(ids), capacity)]
                held += len(ids)
                if held >= block:
                    yield flush()
        if pieces:
            yield flush()

    return save(docs.select(as_text("doc_id"), "text").mapInPandas(written, MANIFEST), "matrix-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """One row per segment as the files hold it: the document and the position of its first token, its place, and the CRC of its ids."""
    spark = manifest.sparkSession
    tasks = max(1, spark.sparkContext.defaultParallelism)

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            for m in pdf.itertuples():
                store, base = fs.FileSystem.from_uri(m.path)
                load = lambda kind, kind_of: np.frombuffer(store.open_input_stream(base + kind).read(), kind_of)  # noqa: B023, E731
                matrix = load(".ids", f"<u{m.width}").reshape(m.n_rows, m.capacity)
                flat, resets, docs = load(".segments", "<i4"), load(".resets", "<i8"), np.frombuffer(m.docs, "<i8")
                at = piece = 0
                out = []
                for r in range(m.n_rows):
                    ends = flat[at + 1 : at + 1 + flat[at]]
                    for s, e in zip(ends, ends[1:], strict=False):
                        out.append((docs[piece], resets[piece], e - s, zlib.crc32(matrix[r, s:e].astype("<u4")), r, s))
                        piece += 1
                    at += 1 + flat[at]
                rows = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "row", "offset"])
                rows["doc_id"] = rows["doc_id"].astype("Int64").mask(np.frombuffer(m.unnamed, np.uint8) > 0)
                rows.insert(0, "matrix", m.path.rsplit("/", 1)[1])
                yield rows

    return manifest.repartition(4 * tasks, "path").mapInPandas(segments, "matrix string, doc_id long, start long, length long, ids_crc32 long, row long, offset long")
