"""WARC archives: written and read by tasks, with revisits resolved by payload digest.

Archives are files of gzip members in the shared folder. A task writes under a name of its own and
returns the name as a row; the rows are committed as a table, so files of lost or repeated attempts
are never read. Headers are shuffled by digest; payloads stay in their archives until the
deduplicated archives are written, source file by source file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeflow.llm.common import encoded, fresh_path, materialize, table, text_rounds

#: Bytes after which a task begins another archive.
ROLL = 64_000_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_FILES = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_HEADERS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("date", pa.string()), ("refers_to_record", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])
_FILES_SQL = "path string, records long, bytes long"
_HEADERS_SQL = "page_id long, url string, record_type string, digest string, payload_bytes long, refers_to long, record_id string, date string, refers_to_record string, path string, offset long, size long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(*parts: object) -> str:
    """A record's own id, from what names it: its archive and place, or the id of the record that it was made from."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def _uri(url: str | None) -> str:
    """A header holds one line: control characters and white space are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


class Original(NamedTuple):
    """What a revisit record says of the response that holds its payload."""

    page_id: int
    record_id: str
    uri: str
    date: str


def record(record_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, original: Original | None = None, payload_bytes: int | None = None, date: str = DATE) -> bytes:
    """A response record with its payload, or, with `original`, a revisit record that has the HTTP head only."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    lines += [f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload) if payload_bytes is None else payload_bytes}"]
    if original is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {original.record_id}", f"WARC-Refers-To-Target-URI: {original.uri}", f"WARC-Refers-To-Date: {original.date}", f"X-Refers-To-Page-ID: {original.page_id}"]
    block = _HTTP + (payload if original is None else b"")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive_info(name: str) -> bytes:
    """The record that an archive begins with."""
    block = b"software: placeflow\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {_record_id(name)}", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record; ValueError if its lengths or digest don't hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(headers["Content-Length"])
    if not first.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("a damaged record")
    payload = rest[:size].partition(b"\r\n\r\n")[2] if headers["WARC-Type"] != "warcinfo" else rest[:size]
    if headers["WARC-Type"] == "response" and f"sha1:{payload_digest(payload)}" != headers["WARC-Payload-Digest"]:
        raise ValueError("a payload that its digest doesn't fit")
    return headers, payload


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, size, content) of each gzip member."""
    view, at = memoryview(data), 0
    while at < len(data):
        engine, parts, fed = zlib.decompressobj(31), [], at
        while not engine.eof:
            if fed >= len(data):
                raise ValueError("a truncated archive")
            parts.append(engine.decompress(view[fed : fed + 65536]))
            fed = min(len(data), fed + 65536)
        end = fed - len(engine.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def _member(data: bytes) -> bytes:
    engine = zlib.compressobj(1, zlib.DEFLATED, 31)
    out = engine.compress(data) + engine.flush()
    return out[:4] + struct.pack("<I", 0) + out[8:]


class _Writer:
    """Archives of one task, each closed before its name is returned."""

    def __init__(self, folder: str):
        self.folder, self.rows = folder, []
        self.parts: list[bytes] = []
        self.size = self.records = 0

    def next_id(self) -> str:
        """The id of the record that is added next."""
        self._open()
        return _record_id(self.name, self.records)

    def _open(self) -> None:
        if not self.parts:
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.parts = [_member(archive_info(self.name))]
            self.size, self.records = len(self.parts[0]), 0

    def add(self, data: bytes) -> None:
        self._open()
        self.parts.append(_member(data))
        self.size += len(self.parts[-1])
        self.records += 1
        if self.size >= ROLL:
            self.close()

    def close(self) -> None:
        if self.parts:
            path = f"{self.folder}/{self.name}"
            system, place = fs.FileSystem.from_uri(path)
            system.create_dir(place.rpartition("/")[0], recursive=True)
            with system.open_output_stream(place, compression=None) as out:
                for part in self.parts:
                    out.write(part)
            self.rows.append((path, self.records, self.size))
            self.parts = []

    def batch(self) -> pa.RecordBatch:
        self.close()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in self.rows], f.type) for i, f in enumerate(_FILES)], schema=_FILES)


def _bytes_of(path: str) -> bytes:
    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_file(place) as f:
        return f.read()


def write_archives(pages: DataFrame) -> DataFrame:
    """Write each row (page_id, url, html) as a response record; (path, records, bytes) of the archives.
    A null html is an empty payload, a null page_id or url an empty one in the header; other columns are ignored."""
    folder = fresh_path(pages.sparkSession, "warc")

    def run(batches):
        writer = _Writer(folder)
        for batch in text_rounds(batches, "html"):
            for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoded(batch.column(2)), strict=True):
                writer.add(record(writer.next_id(), page, url, html, payload_digest(html)))
        yield writer.batch()

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return materialize(pages.mapInArrow(run, _FILES_SQL), "warc-files")


def _by_archive(rows: DataFrame, archives: int) -> DataFrame:
    """Dealt by archive to as many tasks as there are archives: rows are small, what they name is not, so adaptive
    execution must not put them together."""
    return rows.repartition(max(1, archives), "path")


def read_headers(files: DataFrame) -> DataFrame:
    """The headers of every record in the archives, with its place; payloads are checked against their digests."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for offset, size, data in members(_bytes_of(path)):
                    h, _ = parse(data)
                    if h["WARC-Type"] != "warcinfo":
                        rows.append((_number(h["X-Page-ID"]), h["WARC-Target-URI"], h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"]), _number(h.get("X-Refers-To-Page-ID")), h["WARC-Record-ID"], h["WARC-Date"], h.get("WARC-Refers-To"), path, offset, size))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_HEADERS)], schema=_HEADERS)

    return _by_archive(files.select("path"), files.count()).mapInArrow(run, _HEADERS_SQL)


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The headers with `original` decided: of records with equal digest and length of at least `min_bytes`, those with
    the smallest page_id are responses and the others revisit the first of them.

    Only payloads that several records have are joined back; their table is written first, so that a payload of very
    many records is a skewed join that adaptive execution can split."""
    first = headers.filter(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes")
    first = first.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id", "url", "date"))).alias("first"))
    first = materialize(first.filter("n > 1 AND first IS NOT NULL").drop("n"), "warc-originals")
    again = F.when(~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first"))
    return headers.join(first, ["digest", "payload_bytes"], "left").withColumn("original", again).drop("first")


def write_deduplicated(resolved: DataFrame, archives: int) -> DataFrame:
    """Write the records anew, source archive by source archive, revisits without their payload; (path, records, bytes).
    Each record gets an id made from its old one, so a revisit can name a response that another task writes."""
    folder = fresh_path(resolved.sparkSession, "warc-dedup")

    def run(batches):
        writer, path, data = _Writer(folder), None, b""
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    path, data = row["path"], _bytes_of(row["path"])
                _, _, content = next(members(data[row["offset"] : row["offset"] + row["size"]]))
                headers, payload = parse(content)
                to = row["original"] and Original(row["original"]["page_id"], _record_id("deduplicated", row["original"]["record_id"]), row["original"]["url"], row["original"]["date"])
                writer.add(record(_record_id("deduplicated", row["record_id"]), row["page_id"], headers["WARC-Target-URI"], payload, row["digest"], to, row["payload_bytes"], row["date"]))
        yield writer.batch()

    rows = resolved.select("page_id", "record_id", "date", "digest", "payload_bytes", "original", "path", "offset", "size")
    return materialize(_by_archive(rows, archives).sortWithinPartitions("path", "offset").mapInArrow(run, _FILES_SQL), "warc-dedup-files")


def deduplicate(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Headers read back from deduplicated archives of the pages. Every row gives a record; rows that repeat the
    smallest page_id of their payload are all responses, and so are all of a payload without any page_id. A page of any
    length is held by its task alone. An empty table gives no archive and no rows."""
    files = write_archives(pages)
    headers = materialize(read_headers(files), "warc-headers")  # read once, and of known size when joined
    return read_headers(write_deduplicated(resolve_revisits(headers, min_bytes), files.count()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
