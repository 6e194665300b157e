"""Line dedup: drop the lines that many documents share.

Lines are hashed where the texts are read, so only (document, 96-bit line hash, positions) rows are
shuffled to count documents; texts move once, by document, to lose their dropped positions.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeflow.llm.common import encoded, materialize, table

WHITE = b" \t\n\x0b\x0c\r"
_LINES = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("positions", pa.list_(pa.int32()))])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased."""
    return line.strip(WHITE).lower()


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _line_rows(min_chars: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[list] = [[] for _ in _LINES]
                for doc, text in zip(part.column(0).to_pylist(), encoded(part.column(1)), strict=True):
                    places: dict[bytes, list[int]] = {}
                    for i, line in enumerate(text.split(b"\n")):
                        places.setdefault(line_key(line), []).append(i)
                    text_hash = _signed(xxhash.xxh64_intdigest(text, 42))
                    for key, where in places.items():
                        if len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars):
                            for column, value in zip(out, (doc, text_hash, _signed(xxhash.xxh64_intdigest(key)), zlib.crc32(key), where), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _LINES, strict=True)], schema=_LINES)

    return run


def _cut(batches):
    for batch in batches:
        texts, lines, dropped = [], [], []
        for text, drop in zip(encoded(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            parts = text.split(b"\n")
            gone = set(drop or ())
            texts.append(b"\n".join(x for i, x in enumerate(parts) if i not in gone) if gone else text)
            lines.append(len(parts))
            dropped.append(len(gone))
        arrays = [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), *batch.columns[3:]]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "n_lines", "n_dropped", *batch.schema.names[3:]])


def drop_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text without the lines found in at least `min_docs` documents, n_lines, n_dropped, the columns `keep`).

    A null or empty text is one empty line; keys shorter than `min_chars` code points are never
    dropped, so it stays. A line repeated inside one document counts once. Rows that share a doc_id
    (null included) are one document when counting, and each row still gets its own result.
    Columns not in `keep` are ignored. An empty table gives an empty table. A text is split in one
    task's memory, whatever its length. The shared lines are written before they are joined, so that
    a line of very many documents is a skewed join of two shuffles, which adaptive execution splits.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)
    lines = materialize(docs.select("doc_id", "text").mapInArrow(_line_rows(min_chars), "doc_id long, text_hash long, h1 long, h2 long, positions array<int>"), "lines")
    shared = materialize(
        lines.select("h1", "h2", "doc_id").distinct()
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))
        .filter(F.col("n_docs") >= min_docs).select("h1", "h2"),
        "shared-lines",
    )
    # Sets, as rows of equal id and text repeat positions. Nothing that needs a line's rows together may follow the join, or it isn't split.
    cuts = (
        lines.join(shared, ["h1", "h2"]).groupBy(F.col("doc_id").alias("cut_id"), F.col("text_hash").alias("cut_hash"))
        .agg(F.flatten(F.collect_set("positions")).alias("gone"))
    )
    schema = "doc_id long, text string, n_lines long, n_dropped long" + "".join(f", `{c}` {dict(docs.dtypes)[c]}" for c in keep)
    same = docs["doc_id"].eqNullSafe(cuts["cut_id"]) & (F.xxhash64(docs["text"]) == cuts["cut_hash"])
    return docs.join(cuts, same, "left").select("doc_id", "text", "gone", *keep).mapInArrow(_cut, schema)


def _digest(batches):
    for batch in batches:
        sums = [hashlib.sha256(t).hexdigest() for t in encoded(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(sums, pa.string())], schema=_DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_shared_lines(table(spark, sf_dir, "documents")).mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE s.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN shared s USING (k) GROUP BY doc_id
"""
