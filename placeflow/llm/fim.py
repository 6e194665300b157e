"""Fill-in-middle: a document's prefix, middle and suffix change places, and can be put back.

A secondary sort does the assembly. Where a text is read it is cut into pieces of a bounded number of code points,
each keyed by its row and its place in the output. One shuffle deals the rows out and sorts each row's pieces by that
place; a task then streams them into an incremental digest, or into texts. For restoration the stream is parted at its
sentinels again, the parts are sorted by their place in the source where they are, without another shuffle, and streamed
into a second digest. No task holds more than a piece of a text once it is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeflow.llm.common import encoded, table

#: Code points of a piece, and bytes of the pieces that leave a task at a time.
UNITS = 32_768
BATCH_BYTES = 2_000_000
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: (sentinel, segment) by place in the output; segments by place in the source: 0 prefix, 1 middle, 2 suffix.
ORDERS = {"plain": (), "psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
_END = 3
_ROW = [("key", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
_PIECES = pa.schema([*_ROW, ("place", pa.int64()), ("piece", pa.binary())])
_PARTS = pa.schema([*_ROW, ("segment", pa.int32()), ("place", pa.int64()), ("piece", pa.binary())])
_ROW_SQL = "key long, row long, doc_id long, n long, form string, prefix_chars long, middle_chars long"


@dataclass(frozen=True)
class Plan:
    """How a text is rearranged: its form and where prefix and middle end."""

    form: str
    prefix: int
    middle: int


@dataclass(frozen=True)
class Rates:
    """Of a hundred documents, how many are rearranged, and of those how many have the suffix first."""

    seed: int = 1
    rearranged: int = 90
    suffix_first: int = 20


def plan(doc_id: int | None, text: str, rates: Rates) -> Plan:
    """Drawn from the sha256 of seed and decimal id (none for a null id), so every attempt and every row of an id draws alike."""
    drawn = hashlib.sha256(f"{rates.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rates.rearranged:
        return Plan("plain", len(text), len(text))
    first, second = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    return Plan("spm" if h4 % 100 < rates.suffix_first else "psm", first, second)


def cut(text: str, made: Plan, units: int = UNITS) -> Iterator[tuple[int, str]]:
    """(place in the output, piece), in the order of the source; a segment's first piece begins with its sentinel."""
    bounds = {0: (0, made.prefix), 1: (made.prefix, made.middle), 2: (made.middle, len(text))}
    order = ORDERS[made.form] or (("", 0),)
    starts, at = {}, 0
    for sentinel, segment in order:
        starts[segment] = (at, sentinel)
        at += len(sentinel) + bounds[segment][1] - bounds[segment][0]
    for segment, (at, sentinel) in sorted(starts.items()):
        low, high = bounds[segment]
        yield at, sentinel + text[low : min(high, low + units)]
        for begin in range(low + units, high, units):
            yield at + len(sentinel) + begin - low, text[begin : min(high, begin + units)]


class Splitter:
    """Parts an output stream, piece by piece, into (segment, byte offset in it, bytes)."""

    def __init__(self, form: str):
        self.rest = [(s.encode(), segment) for s, segment in ORDERS[form]]
        self.segment, self.offset, self.held = 0, 0, b""

    def _emit(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        if data:
            yield self.segment, self.offset, data
            self.offset += len(data)

    def feed(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        data = self.held + data
        while self.rest:
            sentinel, segment = self.rest[0]
            at = data.find(sentinel)
            if at < 0:
                keep = min(len(data), len(sentinel) - 1)  # a sentinel may go on in the next piece
                yield from self._emit(data[: len(data) - keep])
                self.held = data[len(data) - keep :]
                return
            yield from self._emit(data[:at])
            self.segment, self.offset, data = segment, 0, data[at + len(sentinel) :]
            self.rest.pop(0)
        self.held = b""
        yield from self._emit(data)

    def end(self) -> None:
        if self.rest or self.held:
            raise ValueError("an output without all of its sentinels")


class _Rows:
    """Rows gathered by column until a batch is full."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.clear()

    def clear(self) -> None:
        self.columns: list[list] = [[] for _ in self.schema]
        self.bytes = 0

    def add(self, row: tuple, size: int) -> bool:
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)
        self.bytes += size + 100
        return self.bytes >= BATCH_BYTES

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self.clear()
        return out


def pieces(docs: DataFrame, rates: Rates | None = None, units: int = UNITS) -> DataFrame:
    """Unordered output pieces of each row (doc_id, text): key, row, doc_id, n, form, prefix_chars, middle_chars, place, piece.

    A null text is an empty one; the empty text has one empty piece, so no row is lost. Other columns are ignored, an
    empty table gives no pieces. `row` tells rows apart (repeated and null ids included). `key` deals them out: it is made
    of id, text and the partition that a row was read in, which stay the same when a lost task is run again, and copies
    from different partitions, however many, are dealt to different tasks.
    """
    rates = rates or Rates()

    def run(batches):
        part = TaskContext.get().partitionId()
        out, number = _Rows(_PIECES), 0
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True):
                text, key = data.decode(), xxhash.xxh3_64_intdigest(data, part) ^ xxhash.xxh3_64_intdigest(str(doc_id), part)
                made = plan(doc_id, text, rates)
                chars = (None, None) if made.form == "plain" else (made.prefix, made.middle - made.prefix)
                row = (key - (1 << 63), (part << 36) + number, doc_id, len(text), made.form, *chars)
                number += 1
                for place, piece in cut(text, made, units):
                    if out.add((*row, place, piece.encode()), len(piece)):
                        yield out.batch()
        yield out.batch()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"{_ROW_SQL}, place long, piece binary")


def assembled(cuts: DataFrame) -> DataFrame:
    """The pieces dealt by key and sorted by row and place in the output: the one shuffle."""
    return cuts.repartition("key").sortWithinPartitions("row", "place")


def _pieces_of(batches) -> Iterator[tuple[tuple, list]]:
    """(columns of the row, what follows them) of each piece in the order of the stream."""
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for values in zip(*columns, strict=True):
            yield values[: len(_ROW)], values[len(_ROW) :]


def texts(cuts: DataFrame) -> DataFrame:
    """(doc_id, form, text) of each row: the outputs themselves. Each text is held by its task alone."""
    schema = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("text", pa.string())])

    def run(batches):
        out, now, held = _Rows(schema), None, []
        for row, (_, piece) in _pieces_of(batches):
            if now is not None and row[1] != now[1]:
                if out.add((now[2], now[4], b"".join(held).decode()), sum(map(len, held))):
                    yield out.batch()
                held = []
            now = row
            held.append(piece)
        if now is not None:
            out.add((now[2], now[4], b"".join(held).decode()), 0)
        yield out.batch()

    return assembled(cuts).mapInArrow(run, "doc_id long, form string, text string")


def restore(form: str, output: str) -> str:
    """The text that an output was made from."""
    splitter = Splitter(form)
    parts = list(splitter.feed(output.encode()))
    splitter.end()
    return b"".join(data for _, _, data in sorted(parts)).decode()


def _take_apart(batches):
    """Digest each output as it streams by and part it; a row's last part holds the digest of its output."""
    out, now, digest, splitter = _Rows(_PARTS), None, hashlib.sha256(), Splitter("plain")

    def close():
        splitter.end()
        return out.add((*now, _END, 0, digest.hexdigest().encode()), 64)

    for row, (_, piece) in _pieces_of(batches):
        if now is None or row[1] != now[1]:
            if now is not None and close():
                yield out.batch()
            now, digest, splitter = row, hashlib.sha256(), Splitter(row[4])
        digest.update(piece)
        for segment, offset, data in splitter.feed(piece):
            if out.add((*row, segment, offset, data), len(data)):
                yield out.batch()
    if now is not None:
        close()
    yield out.batch()


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])


def _put_back(batches):
    out, digest = _Rows(_DIGESTS), hashlib.sha256()
    for row, (segment, _, data) in _pieces_of(batches):
        if segment != _END:
            digest.update(data)
            continue
        if out.add((*row[2:], data.decode(), digest.hexdigest()), 200):
            yield out.batch()
        digest = hashlib.sha256()
    yield out.batch()


def digests(cuts: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n, form, prefix_chars, middle_chars, the digest of its output and that of the text
    restored from output and form alone. Lengths are code points, null where the form is plain."""
    parts = assembled(cuts).mapInArrow(_take_apart, f"{_ROW_SQL}, segment int, place long, piece binary")
    restored = parts.sortWithinPartitions("row", "segment", "place")  # where they are: a row's parts are in one partition
    return restored.mapInArrow(_put_back, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pieces(table(spark, sf_dir, "documents")))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS e
  FROM d),
formed AS (
  SELECT *, least(a, b) AS p, greatest(a, b) AS q,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (SELECT *, substr(t, 1, p) AS prefix, substr(t, p + 1, q - p) AS middle, substr(t, q + 1) AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
