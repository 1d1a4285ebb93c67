"""WARC archives: a deduplicating writer and a salvage reader.

The writer puts one record per page into archives in the shared folder, each record a gzip member of its own. Of pages with
equal payloads the one with the largest page_id is a response; the others are revisit records that refer to it and
hold only the HTTP head, whose Content-Length is the full payload's. An archive counts only if the manifest names it, and the
manifest is written once all tasks have ended.

The reader checks every record: the gzip member, the version line, the header, the lengths, the end of the record and its block
digest. After a failed check it searches for the next gzip member that begins with a version line (or, in an archive without
compression, the next version line) from which a whole record can be read, goes on there, and reports the bytes between
as a quarantined gap with the reason. Of a gzip member of several records only the damaged part is lost, and of one that is cut or breaks
off all that comes before is kept: the gap is the member's place (up to the next readable one, if it breaks off), and the reason names the
bytes of its content. Archives are read as a stream: a task holds one record and a window of the file, and a record that claims more
than ``most`` bytes is quarantined.

Defined results: null html counts as an empty payload. Rows that share both the payload and its largest page_id are
responses all. Pages without an id can't be referred to: among equal payloads without any id, all are responses. An
empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, join_groups, new_path, save

VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PAGE = "urn:page:"


def sha1(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None = None, revisit: bool = False) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{PAGE}{'' if page_id is None else page_id}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\r\n]", " ", uri or "about:blank")), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [("WARC-Refers-To", f"<{PAGE}{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


class Incomplete(ValueError):
    """The bytes end before the record does; ``needed`` of them are known to be necessary."""

    def __init__(self, why: str, needed: int = 0):
        super().__init__(why)
        self.needed = needed


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """The header, the block and the length of the record that begins the bytes; ValueError with the reason if a check fails."""
    if not (m := VERSION.match(data)):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        raise Incomplete("the header doesn't end")
    header = {}
    for line in data[m.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header line without a colon")
        key = name.decode("utf-8", "replace").strip().lower()
        if key in header and key != "warc-concurrent-to":
            raise ValueError(f"two fields {key}")  # the rest of another record's header
        header[key] = value.decode("utf-8", "replace").strip()
    if not (size := header.get("content-length", "")).isdigit():
        raise ValueError("no content length")
    start, stop = end + 4, end + 4 + int(size)
    if len(data) < stop + 4:
        raise Incomplete("the record doesn't end where its length says", stop + 4)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("the record doesn't end where its length says")
    block = data[start:stop]
    wanted = header.get("warc-block-digest", "")
    if wanted.startswith("sha1:") and wanted[5:] != sha1(block):
        raise ValueError("the block digest differs")
    return header, block, stop + 4


class Archive:
    """Bytes of a file by place, through one window of it."""

    WINDOW = 1 << 20

    def __init__(self, file):
        self.file, self.size, self.at, self.held = file, file.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            if n > self.WINDOW // 2:
                return self.file.read_at(max(0, min(n, self.size - at)), at)
            self.at, self.held = at, self.file.read_at(max(0, min(self.WINDOW, self.size - at)), at)
        return self.held[at - self.at : at - self.at + n]

    def drop(self, at: int) -> None:
        """Nothing before ``at`` is asked for again."""


class Member:
    """The content of the gzip member at a place, unpacked as it is asked for; what was dropped isn't held."""

    def __init__(self, archive: Archive, at: int, chunk: int = 1 << 14):
        self.archive, self.pos, self.chunk = archive, at, chunk
        self.packer, self.held, self.before = zlib.decompressobj(31), bytearray(), 0
        self.end: int | None = None
        self.failure: str | None = None

    def get(self, at: int, n: int) -> bytes:
        while self.before + len(self.held) < at + n and self.end is None and self.failure is None:
            self._more()
        return bytes(self.held[at - self.before : at - self.before + n])

    def _more(self) -> None:
        data = self.archive.get(self.pos, self.chunk)
        if not data:
            self.failure = "the member doesn't end"
            return
        # byte by byte where a chunk fails, so that all is kept that comes before the fault
        try:
            before = self.packer.copy()
            self.held += self.packer.decompress(data)
        except zlib.error as e:
            self.failure = f"bad member: {e}"
            try:
                for k in range(len(data)):
                    self.held += before.decompress(data[k : k + 1])
            except zlib.error:
                return
        self.pos += len(data)
        if self.packer.eof:
            self.end = self.pos - len(self.packer.unused_data)

    def drop(self, at: int) -> None:
        del self.held[: at - self.before]
        self.before = max(self.before, at)

    @property
    def length(self) -> int:
        return self.before + len(self.held)


def one(source: Archive | Member, at: int, most: int) -> tuple[dict[str, str], bytes, int]:
    """The header, the block and the end of the record at a place of an archive or a member."""
    n = 1 << 13
    while True:
        data = source.get(at, n)
        try:
            header, block, length = parse(data)
            return header, block, at + length
        except Incomplete as e:
            if len(data) < n:
                raise
            if max(n, e.needed) >= most:
                raise ValueError(f"the record is longer than {most} bytes") from None
            n = max(2 * n, e.needed)


def search(source: Archive | Member, at: int, pattern: re.Pattern = VERSION, window: int = 1 << 16, overlap: int = 16) -> int | None:
    """The first place from ``at`` on where the pattern matches."""
    while True:
        data = source.get(at, window)
        if m := pattern.search(data):
            return at + m.start()
        if len(data) < window:
            return None
        at += window - overlap
        source.drop(at)


#: What a record in an archive begins with, packed or not.
BEGINS = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r?\n")


def following(archive: Archive, at: int) -> int:
    """The next place of a member that begins with a version line, or of a version line."""
    while (found := search(archive, at, BEGINS)) is not None:
        if archive.get(found, 3) != MAGIC or VERSION.match(Member(archive, found, 64).get(0, 10)):
            return found
        at = found + 1
    return archive.size


def inside(member: Member, most: int) -> Iterator[tuple]:
    """("record", header, block), and ("lost", start, end, reason) for bytes of the content that fail the checks."""
    pos, hole = 0, None
    while member.get(pos, 1):
        try:
            header, block, end = one(member, pos, most)
        except ValueError as e:
            hole = hole or (pos, str(e))
            if (next_ := search(member, pos + 1)) is None:
                break
            pos = next_
            continue
        if hole:
            yield "lost", hole[0], pos, hole[1]
            hole = None
        yield "record", header, block
        pos = end
        member.drop(pos)
    if hole:
        yield "lost", hole[0], member.length, hole[1]


def scan(archive: Archive, most: int = 1 << 30) -> Iterator[tuple]:
    """("record", offset, header, block) of every record that passes the checks, ("gap", start, end, reason) of the quarantined bytes."""
    at, bad = 0, None  # bad: the start and reason of an open gap
    while at < archive.size:
        if archive.get(at, 3) == MAGIC:
            member, got, lost = Member(archive, at), False, []
            for kind, *what in inside(member, most):
                if kind == "lost":
                    lost.append(what)
                    continue
                if bad:
                    yield "gap", bad[0], at, bad[1]
                    bad = None
                got = True
                yield "record", at, *what
            end = member.end if member.failure is None else following(archive, at + 1)
            if got or not lost and not member.failure:
                if member.failure and (not lost or lost[-1][1] < member.length):
                    lost.append((member.length, member.length, member.failure))
                for a, b, why in lost:
                    whole = f"{member.failure}; {why}" if member.failure and why != member.failure and b == member.length else why
                    yield "gap", at, end, f"{whole} (bytes {a} to {b} of the member's content)"
                at = end
                continue
            bad = bad or (at, member.failure or lost[0][2])
            at = following(archive, at + 1)
            continue
        try:
            header, block, end = one(archive, at, most)
        except ValueError as e:
            bad = bad or (at, str(e))
            at = following(archive, at + 1)
            continue
        if bad:
            yield "gap", bad[0], at, bad[1]
            bad = None
        yield "record", at, header, block
        at = end
    if bad:
        yield "gap", bad[0], archive.size, bad[1]


def salvage(data: bytes, most: int = 1 << 30) -> tuple[list[tuple[int, dict[str, str], bytes]], list[tuple[int, int, str]]]:
    """The records (offset, header, block) and the gaps (start, end, reason) of an archive held in memory."""
    import pyarrow as pa

    found = list(scan(Archive(pa.BufferReader(data)), most))
    return [tuple(x[1:]) for x in found if x[0] == "record"], [tuple(x[1:]) for x in found if x[0] == "gap"]


def with_roles(pages: DataFrame) -> DataFrame:
    """page_id, url, html, record_type and refers_to; equal payloads meet by their SHA-1."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    groups = save(rows.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")), "payloads")
    out = join_groups(rows, groups, "sha", "n")
    revisit = F.coalesce(F.col("n") > 1, F.lit(False)) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return out.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("last")).alias("refers_to"))


def write(roles: DataFrame, out: str | None = None, archive_bytes: int = 32 << 20, level: int = 6) -> DataFrame:
    """Write the archives; the manifest: path, records and bytes of each."""
    spark = roles.sparkSession
    target = out or new_path(spark, "warc")

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(target)
        store.create_dir(base, recursive=True)
        name, file, size, n = "", None, 0, 0
        for pdf in batches:
            for page, url, html, revisit, refers in zip(pdf["page_id"].array, pdf["url"], pdf["html"], pdf["revisit"], pdf["refers_to"].array, strict=True):
                if file is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    file = store.open_output_stream(f"{base}/{name}", compression=None)
                payload = html.encode("utf-8", "surrogatepass")
                one = record(None if pd.isna(page) else int(page), url, payload, sha1(payload), None if pd.isna(refers) else int(refers), bool(revisit))
                c = zlib.compressobj(level, zlib.DEFLATED, 31)
                packed = c.compress(one) + c.flush()
                file.write(packed)
                size, n = size + len(packed), n + 1
                if size >= archive_bytes:
                    file.close()
                    file = None
                    yield pd.DataFrame([(f"{target}/{name}", n, size)], columns=["path", "records", "bytes"])
        if file is not None:
            file.close()
            yield pd.DataFrame([(f"{target}/{name}", n, size)], columns=["path", "records", "bytes"])

    return save(roles.select(as_text("page_id"), "url", "html", "revisit", as_text("refers_to")).mapInPandas(written, "path string, records long, bytes long"), "warc-manifest")


RECORDS = (
    "kind string, path string, start long, `end` long, reason string, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary"
)


def read(manifest: DataFrame, with_payload: bool = True, most: int = 1 << 30) -> DataFrame:
    """What the archives hold: rows of kind ``record``, and of kind ``gap`` for the bytes that were quarantined."""
    tasks = max(1, 4 * manifest.sparkSession.sparkContext.defaultParallelism)

    def row(path: str, x: tuple) -> tuple:
        if x[0] == "gap":
            return ("gap", path, *x[1:], *[None] * 7)
        _, at, header, block = x
        head, _, payload = block.partition(b"\r\n\r\n")
        kind = header.get("warc-type", "")
        digest = header.get("warc-payload-digest", "").removeprefix("sha1:")
        length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        full = int(length[1]) if kind == "revisit" and length else len(payload)
        return (
            "record", path, at, None, None, _page(header.get("warc-record-id")), header.get("warc-target-uri"), kind, _page(header.get("warc-refers-to")),
            full, digest if kind == "revisit" else sha1(payload), payload if with_payload else None,
        )

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        names = [x.strip().split()[0].strip("`") for x in RECORDS.split(",")]
        for pdf in batches:
            for path in pdf["path"]:
                store, base = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(base) as f:
                    for x in scan(Archive(f), most):
                        rows.append(row(path, x))
                        held += len(rows[-1][-1] or b"")
                        if len(rows) >= 1000 or held >= 16 << 20:
                            yield _frame(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows, names)

    return manifest.repartition(tasks, "path").mapInPandas(found, RECORDS)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"start": "Int64", "end": "Int64", "page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})


def _page(uri: str | None) -> int | None:
    m = re.fullmatch(rf"<{PAGE}(-?\d+)>", uri or "")
    return int(m[1]) if m else None


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
        max(page_id) OVER (PARTITION BY hex) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last OR last IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM b
"""
