"""Media columns: Ogg containers written and read inside tasks, one per row.

A payload is cut into packets, dealt in turn to logical streams, laced into pages with checksums,
and the pages of the streams are interleaved. Reading verifies every page checksum and sequence
number, demultiplexes by serial number, reassembles packets from lacing values (packets may run
over several pages) and derives timestamps from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeflow.llm.common import encoded, table, text_rounds

PACKET = 576
RATE = 8000
STREAMS = 2
#: Lacing values on a page; under 255 so that packets run over page ends.
SEGMENTS = 64
_HEADER = struct.Struct("<4sBBqIIIB")
_IDENT = struct.Struct("<8sIHHQ")
_MAGIC = b"pcm8bits"
#: Each byte with its bits in reverse order.
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's CRC-32 (0x04C11DB7, most significant bit first, start 0): zlib's mirrored one over mirrored bytes."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing))
    page = bytearray(head + lacing + body)
    struct.pack_into("<I", page, 22, page_crc(bytes(page)))
    return bytes(page)


def stream_pages(packets: list[tuple[bytes, int]], serial: int, segments: int = SEGMENTS) -> list[bytes]:
    """Pages of one logical stream from (packet, granule at its end); the first packet gets a page of its own."""
    head, granule = packets[0]
    pages = [_page(2 | (4 if len(packets) == 1 else 0), granule, serial, 0, bytes([255] * (len(head) // 255) + [len(head) % 255]), head)]
    lacing, granules = bytearray(), []
    for body, granule in packets[1:]:
        lacing += b"\xff" * (len(body) // 255) + bytes([len(body) % 255])
        granules.append((len(lacing), granule))
    data, at, packet = b"".join(p for p, _ in packets[1:]), 0, 0
    for first in range(0, len(lacing), segments):
        part = bytes(lacing[first : first + segments])
        ended = -1
        while packet < len(granules) and granules[packet][0] <= first + len(part):
            ended = granules[packet][1]
            packet += 1
        flags = (1 if first and lacing[first - 1] == 255 else 0) | (4 if first + segments >= len(lacing) else 0)
        pages.append(_page(flags, ended, serial, len(pages), part, data[at : at + sum(part)]))
        at += sum(part)
    return pages


def write_ogg(payload: bytes, packet: int = PACKET, rate: int = RATE, streams: int = STREAMS) -> bytes:
    """One physical stream: packets dealt in turn to `streams` logical streams, pages interleaved."""
    base = zlib.crc32(payload)
    packets = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    columns = []
    for s in range(streams):
        own, granule, rows = packets[s::streams], 0, []
        rows.append((_IDENT.pack(_MAGIC, rate, s, streams, sum(map(len, own))), 0))
        for p in own:
            granule += len(p)
            rows.append((p, granule))
        columns.append(stream_pages(rows, (base + s) & 0xFFFFFFFF))
    out = [pages[0] for pages in columns]
    for k in range(1, max(map(len, columns))):
        out += [pages[k] for pages in columns if k < len(pages)]
    return b"".join(out)


def read_ogg(data: bytes) -> tuple[bytes, dict]:
    """(payload, facts); ValueError on a wrong checksum, a gap in a stream or a truncated file."""
    view = memoryview(data)
    at, pages, continued = 0, 0, 0
    streams: dict[int, dict] = {}
    while at < len(data):
        if len(data) - at < _HEADER.size:
            raise ValueError("truncated page header")
        magic, version, flags, granule, serial, sequence, crc, n = _HEADER.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise ValueError("no page where one must begin")
        lacing = bytes(view[at + 27 : at + 27 + n])
        size = 27 + n + sum(lacing)
        page = bytearray(view[at : at + size])
        if len(page) < size:
            raise ValueError("truncated page")
        page[22:26] = b"\0\0\0\0"
        if page_crc(bytes(page)) != crc:
            raise ValueError("wrong page checksum")
        if flags & 2:
            streams[serial] = {"next": 0, "open": [], "packets": [], "granules": [], "ended": False}
        if serial not in streams:
            raise ValueError("a stream without a first page")
        stream = streams[serial]
        if sequence != stream["next"] or bool(flags & 1) != bool(stream["open"]):
            raise ValueError("a page is missing")
        stream["next"] += 1
        pages, continued = pages + 1, continued + (flags & 1)
        start = at + 27 + n
        stop, new = start, 0
        for value in lacing:
            stop += value
            if value < 255:
                stream["open"].append(view[start:stop])
                stream["packets"].append(stream["open"][0] if len(stream["open"]) == 1 else b"".join(stream["open"]))
                stream["open"], start, new = [], stop, new + 1
        if stop > start or (n and lacing[-1] == 255):
            stream["open"].append(view[start:stop])
        if (granule == -1) != (new == 0):
            raise ValueError("a granule position without the end of a packet")
        if new:
            stream["granules"].append(granule)
        stream["ended"] = bool(flags & 4)
        at += size
    columns: list[list] = []
    seconds = 0.0
    for stream in streams.values():
        if stream["open"] or not stream["ended"]:
            raise ValueError("a stream without its last page")
        magic, rate, index, count, size = _IDENT.unpack(stream["packets"][0])
        own = stream["packets"][1:]
        if magic != _MAGIC or index != len(columns) or sum(map(len, own)) != size or stream["granules"][-1] != size:
            raise ValueError("a stream that doesn't hold what its header says")
        columns.append(own)
        seconds = max(seconds, stream["granules"][-1] / rate)
    dealt = [p for k in range(max(map(len, columns), default=0)) for c in columns if k < len(c) for p in (c[k],)]
    marks = [g for s in streams.values() for g in s["granules"][1:]]
    return b"".join(dealt), {"pages": pages, "streams": len(streams), "packets": len(dealt), "continued": continued, "seconds": seconds, "marks": marks}


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("timestamps", pa.list_(pa.float64())), ("feature", pa.string())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("timestamps", pa.list_(pa.float64()))])


def padded(text: bytes, block: int = PACKET) -> bytes:
    """The text and bytes 255 up to a positive multiple of `block`."""
    return text + b"\xff" * (max(block, -(-len(text) // block) * block) - len(text))


def _store(batches):
    for batch in text_rounds(batches):
        texts = encoded(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([write_ogg(padded(t)) for t in texts], pa.binary())], schema=_STORED)


def to_ogg(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text, padded, as an Ogg file. A null text counts as empty and gives one
    packet of padding; each row, repeated or not, gives a row; other columns are ignored. An empty table gives an
    empty table; a text of any length is one file in its task's memory, some four times its bytes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def features(payload: bytes, facts: dict) -> str:
    samples = np.frombuffer(payload, dtype=np.uint8)
    return f"pages={facts['pages']};streams={facts['streams']};packets={facts['packets']};continued={facts['continued']};seconds={facts['seconds']:.4f};mean={int(samples.sum(dtype=np.int64)) / max(1, len(samples)):.4f};crossings={int(np.count_nonzero((samples[1:] >= 128) != (samples[:-1] >= 128)))}"


def _load(batches):
    for batch in text_rounds(batches, "media"):
        rows = [(m, *read_ogg(m)) for m in encoded(batch.column(2))]
        columns = [batch.column(0), batch.column(1), pa.array([p for _, p, _ in rows], pa.binary()), pa.array([len(m) for m, _, _ in rows], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m, _, _ in rows], pa.string()), pa.array([[g / RATE for g in f["marks"]] for _, _, f in rows], _READ.field("timestamps").type), pa.array([features(p, f) for _, p, f in rows], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, schema=_READ)


def from_ogg(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload, media_bytes, media_sha256, timestamps of the pages' granule positions, feature).
    A damaged file fails the job: nothing is dropped silently."""
    return media.mapInArrow(_load, "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, timestamps array<double>, feature string")


def _digest(batches):
    for batch in text_rounds(batches, "payload"):
        payloads = encoded(batch.column(2))
        columns = [batch.column(0), batch.column(1), pa.array(map(len, payloads), pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()), pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()), batch.column(3), batch.column(4), batch.column(6), batch.column(5)]
        yield pa.RecordBatch.from_arrays(columns, schema=_DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_ogg(to_ogg(table(spark, sf_dir, "documents"))).mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<double>")
