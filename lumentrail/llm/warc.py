"""WARC archives: a writer that runs in tasks, and a splittable reader of gzip-compressed archives.

Each record is a gzip member of its own. A reading task owns the records whose member starts in its
range of bytes. It looks for the gzip magic from the start of the range, takes a place for a member only
if it inflates to the header of a WARC record, and from there follows the chain of members to the end of
its range, reading past it to finish the last one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrail.llm.shared import checkpoint, scratch, text_batches

MAGIC = b"\x1f\x8b\x08"
#: Bytes of an archive that one task owns.
SPLIT_BYTES = 8 << 20
#: Archives are closed at about this size.
FILE_BYTES = 64 << 20
STEP = 1 << 18
DATE = "1970-01-01T00:00:00Z"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path:
        path = "file://" + path
    return pafs.FileSystem.from_uri(path) if not path.startswith("file:") else (pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", path))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member. Header values must hold no line breaks."""
    head = "".join(f"{k}: {v}\r\n" for k, v in ({"WARC-Type": kind} | headers | {"Content-Length": str(len(block))}).items())
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A page as a response or revisit record. The block is an HTTP message, with no body in a revisit."""
    headers = {
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%-._~"),
        "WARC-Payload-Digest": f"sha1:{digest_of(payload)}",
        "X-Page-Id": "" if page_id is None else str(page_id),
        "Content-Type": "application/http; msgtype=response",
    }
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        return record("response", headers, http + payload)
    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-Id": "" if refers_to is None else str(refers_to)}
    return record("revisit", headers, http)


def revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload, refers_to, revisit)``: which pages repeat an equal payload.

    Of pages with equal payloads of at least ``least_bytes`` bytes that with the largest page_id is the response,
    the others refer to it. Null html is an empty payload. Rows that repeat the largest id are responses
    like it; a null id is less than any other. Payloads are compared by SHA-1 and length. The largest id per
    payload comes from a combining aggregation, so any number of equal payloads makes one row.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("sha", F.sha1("payload"))
    groups = p.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return p.join(groups, "sha", "left").select("page_id", "url", "payload", F.when(revisit, F.col("top")).alias("refers_to"), revisit.alias("revisit"))


def write_warc(records: DataFrame, path: str, prefix: str = "part") -> DataFrame:
    """Writes ``revisits``-shaped rows as archives below ``path``; returns the manifest ``(file, bytes, records)``.

    Every attempt of a task writes files of its own names, and only those of attempts that succeeded are in the
    manifest, which is materialised; files of lost attempts are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(path)
        system.create_dir(base, recursive=True)
        out, size, n = None, 0, 0
        for b in batches:
            for page_id, url, payload, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, size, n = f"{base}/{prefix}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(name, compression=None)
                    size += out.write(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                size += out.write(page_record(page_id, url, payload, refers_to, revisit))
                n += 1
                if size >= FILE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "records": [n]})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "records": [n]})

    return checkpoint(text_batches(records).mapInArrow(run, "file string, bytes long, records long"))


class _Window:
    """Bytes of a file from some place on, fetched in steps and forgotten once passed."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.base, self.buf = file, size, at, b""

    def more(self) -> bool:
        at = self.base + len(self.buf)
        if at >= self.size:
            return False
        self.buf += self.file.read_at(min(STEP, self.size - at), at)
        return True

    def drop(self, upto: int) -> None:
        self.buf, self.base = self.buf[upto - self.base :], upto

    def find(self, start: int, end: int) -> int:
        """The next gzip magic that begins at or after ``start`` and before ``end``, or -1."""
        self.drop(start) if start <= self.base + len(self.buf) else None
        while True:
            k = self.buf.find(MAGIC)
            if k >= 0:
                return self.base + k if self.base + k < end else -1
            self.drop(max(self.base, self.base + len(self.buf) - 2))
            if self.base >= end or not self.more():
                return -1

    def inflate(self, at: int, most: int | None = None) -> tuple[bytes, int] | None:
        """The member at ``at`` and where it ends; only its first bytes with ``most``. None if it isn't one."""
        z, parts, pos, size = zlib.decompressobj(31), [], at - self.base, 0
        try:
            while not z.eof and (most is None or size < most):
                if pos >= len(self.buf) and not self.more():
                    return None
                part = z.decompress(self.buf[pos : pos + STEP])
                parts.append(part)
                size += len(part)
                pos = min(pos + STEP, len(self.buf))
        except zlib.error:
            return None
        return b"".join(parts), self.base + pos - len(z.unused_data)


def read_members(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """The inflated records that a task with bytes ``start`` to ``end`` of a file owns."""
    w = _Window(file, size, start)
    at = start
    while (at := w.find(at, end)) >= 0:
        head = w.inflate(at, 9)
        if head is None or not head[0].startswith(b"WARC/1."):
            at += 1
            continue
        got = w.inflate(at)
        if got is None:
            at += 1
            continue
        yield got[0]
        at = got[1]
        w.drop(at)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, names in lower case, and the block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    return fields, rest[: int(fields.get("content-length", 0))]


SCHEMA = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read_warc(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The response and revisit records of the archives in ``files(file, bytes)``, one task per range of bytes.

    The payload is the HTTP body. A revisit has none; its length and digest are those that its headers state.
    Bytes that are no members are passed over.
    """
    parts = files.select("file", "bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes))).alias("start"))
    parts = parts.repartition(max(1, parts.count()), "file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
        for b in batches:
            for name, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system, local = _open(name)
                rows, held = [], 0
                with system.open_input_file(local) as f:
                    for raw in read_members(f, size, start, start + split_bytes):
                        head, block = parse(raw)
                        if (kind := head.get("warc-type")) not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        number = lambda x: int(x) if x else None
                        if kind == "response":
                            n, digest = len(payload), digest_of(payload)
                        else:
                            n, digest = int(re.search(rb"(?i)content-length: *(\d+)", http)[1]), head["warc-payload-digest"].removeprefix("sha1:")
                        rows.append((number(head.get("x-page-id")), head.get("warc-target-uri"), kind, payload if kind == "response" else None, n, digest, number(head.get("x-refers-to-page-id"))))
                        held += len(payload)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
                            rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return parts.mapInArrow(run, SCHEMA)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes every page as a record, reads the archives back and returns what they say.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``, one row per page. The archives lie in
    the shared folder.
    """
    spark = pages.sparkSession
    manifest = write_warc(revisits(pages, least_bytes=least_bytes), scratch(spark, "warc"))
    return read_warc(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
