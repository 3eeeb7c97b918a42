"""WARC archives: a writer that marks repeated payloads, and a splittable reader.

Writer: one gzip member per record. Of pages with equal payloads the least id is
the ``response``; the others are ``revisit`` records that name it and carry the
HTTP header only. Only digests and ids are shuffled to find repeats, so a payload
that a third of all pages share is one row per task there. The revisits are then
broadcast to the pages, if they are at most ``FEW_REVISITS``; more are joined by a
shuffle, which moves the payloads too. Tasks write files of
bounded size under unique names, and a manifest that Spark commits lists the
files of the attempts that count; a lost task's files are never read.

Reader: each task scans byte ranges for the gzip magic. A candidate is a record
only if its first bytes decode to a WARC header; a record belongs to the range
in which it starts and is read past the range's end. Payload digests are checked, and a
file that is cut or damaged is an error, never a shorter result.

Defined cases: a null html is an empty payload, a null url gives a record without
target; rows without an id are responses and never referred to; repeated rows of
one id give a record each, and those with the least id's payload are all responses;
payloads of any length are stored whole; an empty
table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stage

# Revisits (some 100 bytes each) that may be broadcast.
FEW_REVISITS = 300_000
# Compressed bytes of a file, about, and of a range that one scan covers.
FILE_BYTES = 256 << 20
RANGE_BYTES = 16 << 20
READ_BYTES = 1 << 20
MAGIC = b"\x1f\x8b\x08"
BREAK = b"\r\n\r\n"
NAME = "urn:x-page:"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """The gzip member of one page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{NAME}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{NAME}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    block = http + (payload if refers_to is None else b"")
    head.append(f"Content-Length: {len(block)}")
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + BREAK + block + BREAK) + press.flush()


def write_archives(pages: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES, least: int = 0) -> DataFrame:
    """Archives of (page_id, url, html); the staged manifest (path, size, records).

    Payloads under ``least`` bytes are always stored as responses.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary"))
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    marked = whole.withColumn("sha1", F.sha1("body")).withColumn("size", F.octet_length("body"))
    ids = stage(marked.where(F.col("size") >= least).select("page_id", "sha1").where("page_id is not null"), "digests")
    first = ids.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = ids.join(first, "sha1").where("page_id <> first").select("page_id", "sha1", "first").distinct()
    again = stage(again, "revisits")
    # Few revisits are broadcast, and no payload is shuffled; more are joined by a shuffle.
    few = again.count() <= FEW_REVISITS
    found = marked.join(F.broadcast(again) if few else again, ["page_id", "sha1"], "left")
    ready = found.select(
        "page_id", "url", F.when(F.col("first").isNull(), F.col("body")).alias("body"), "sha1", "size", "first"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        out, path, size, records = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page_id, url, payload, sha1, length, refers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    where.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, size, records = f"{folder}/{name}", 0, 0
                    # The members are compressed already.
                    out = where.open_output_stream(f"{base}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                member = record(page_id, url, payload or b"", digest, length, refers)
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= file_bytes:
                    out.close()
                    done.append((path, size, records))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, records))
        columns = list(zip(*done, strict=True)) or [(), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["path", "size", "records"]
        )

    return stage(ready.mapInArrow(run, "path string, size long, records long"), "manifest")


class Scan:
    """The records of a file that start in the byte range ``at`` to ``end``."""

    def __init__(self, source: pa.NativeFile, at: int, end: int):
        self.source, self.at, self.end = source, at, end
        self.size = source.size()
        self.start, self.block = at, b""

    def _bytes(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at`` on, fewer only at the file's end."""
        if not self.start <= at <= at + n <= self.start + len(self.block):
            self.source.seek(at)
            self.start, self.block = at, self.source.read(max(n, READ_BYTES))
        return self.block[at - self.start : at - self.start + n]

    def _next_magic(self, at: int) -> int:
        """The next candidate in the range from ``at`` on, or -1."""
        while at < self.end:
            part = self._bytes(at, min(READ_BYTES // 2, self.end - at + len(MAGIC) - 1))
            if (found := part.find(MAGIC)) >= 0:
                return at + found if at + found < self.end else -1
            if len(part) < len(MAGIC):
                return -1
            at += len(part) - len(MAGIC) + 1
        return -1

    def _begins(self, at: int) -> bool:
        """Whether a record's header can be decoded at ``at``."""
        raw = self._bytes(at, 1 << 12)
        try:
            return raw.startswith(MAGIC) and zlib.decompressobj(31).decompress(raw, 7) == b"WARC/1."
        except zlib.error:
            return False

    def _member(self, at: int) -> tuple[bytes, int] | None:
        """The decoded record that starts at ``at`` and where it ends, or None if there is none."""
        inflate, parts, total = zlib.decompressobj(31), [], 0
        here = at
        try:
            while not inflate.eof:
                raw = self._bytes(here, 1 << 16)
                if not raw:
                    return None
                piece = inflate.decompress(raw)
                here += len(raw) - len(inflate.unused_data)
                parts.append(piece)
                total += len(piece)
                if total >= 7 and not (parts[0] if len(parts[0]) >= 7 else b"".join(parts)).startswith(b"WARC/1."):
                    return None
        except zlib.error:
            return None
        whole = b"".join(parts)
        return (whole, here) if whole.startswith(b"WARC/1.") and BREAK in whole else None

    def __iter__(self) -> Iterator[bytes]:
        """Raises ValueError where a record is cut or bytes between records are none of theirs.

        Each range answers for the first byte of the file, or for what follows its own
        records, so all ranges together answer for every byte.
        """
        at = self.at
        if at == 0 and self.size and not self._begins(0):
            raise ValueError("the file doesn't begin with a record")
        while (at := self._next_magic(at)) >= 0:
            if (found := self._member(at)) is None:
                if self._begins(at):
                    raise ValueError(f"the record at byte {at} is damaged")
                at += 1
            else:
                whole, at = found
                if at < self.size and not self._begins(at):
                    raise ValueError(f"no record begins at byte {at}, where one ends")
                yield whole


def parse(whole: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of a decoded record."""
    head, _, rest = whole.partition(BREAK)
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(BREAK)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response":
        size = len(payload)
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    else:
        sizes = [x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size, payload = int(sizes[0].split(b":")[1]), None

    def number(name: str) -> int | None:
        value = fields.get(name, "")[1 + len(NAME) : -1]
        return int(value) if value else None

    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), size, digest, kind, number("WARC-Refers-To"), payload


def read_archives(
    spark: SparkSession, manifest: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = False
) -> DataFrame:
    """The records of all files of (path, size): page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, and with ``payloads`` the payload of responses."""
    ranges = manifest.where("size > 0").select(
        "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("at")
    )
    tasks = max(1, ranges.count())
    dealt = ranges.repartition(min(tasks, 100_000), "path", "at")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    used = len(names) if payloads else len(names) - 1

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays[:used], names=names[:used])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                where, file = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with where.open_input_file(file) as source:
                    for whole in Scan(source, at, at + range_bytes):
                        row = parse(whole)
                        rows.append(row if payloads else (*row[:-1], None))
                        held += len(whole) if payloads else 200
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return dealt.mapInArrow(run, schema + (", payload binary" if payloads else ""))
