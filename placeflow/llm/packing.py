"""Packing by non-negative least squares.

Documents are tokenised where they are read and cut at multiples of the window; what a cut leaves is
a piece shorter than the window. Only the histogram of piece lengths (one bin for each length below
the window) reaches the driver. There, shallow combinations of lengths that fill the window are
enumerated, non-negative least squares fits their repeat counts to the histogram, the counts are
rounded down to what the bins hold, and the rest is packed greedily, whole runs of equal bins at a
time. The plan is a bounded table from (length, rank among the pieces of that length) to sequence
and offset; ranks come from salted counts, so no length's pieces meet in one task.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import Counter
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeflow.llm.common import materialize, shuffle_partitions, table, text_rounds

if TYPE_CHECKING:
    import tiktoken

WINDOW = 2048
END = 1
#: Salts that deal out the pieces of one length, at least; more partitions mean more salts.
SALTS = 64
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("key", pa.int64())])
_WITH_IDS = _PIECES.append(pa.field("ids", pa.list_(pa.int32())))

#: Texts that hold anything else go to the tokenizer itself, and so do those that may hold white space of this length.
_OTHER = re.compile(r"[^\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]")
_LONG = 50_000


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the others in turn."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _by_ranks(path: str) -> tiktoken.Encoding | None:
    """An encoder that merges by rank, over the vocabulary of the tokenizer's own file; None unless that is byte-level
    and numbers its tokens in the order of its merges, so that both ways give the same ids."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        saved = json.load(f)
    vocabulary, merges = saved["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in saved["model"]["merges"]]
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if saved["normalizer"] or {k: (saved["pre_tokenizer"] or {}).get(k) for k in plain} != plain or any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    letters = _bytes_of_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(merges)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tokenizer:
    """The published tokenizer. Plain texts, which are nearly all, take a faster encoder over the same file."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tokenizers

        path = str(public_tokenizers.path(f"{name}.json"))
        self.encoding = tokenizers.Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.encoding.get_added_tokens_decoder().values())
        self.ranks = _by_ranks(path)

    def encode(self, text: str) -> bytes:
        return array("I", self.encoding.encode(text, add_special_tokens=False).ids).tobytes()

    def id_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers. A text that spells an added token gets that token's id."""
        if self.ranks is None or _OTHER.search(text) or any(t in text for t in self.added) or (len(text) > _LONG and re.search(f"\\s{{{_LONG}}}", text)):
            return self.encode(text)
        return array("I", self.ranks.encode_ordinary(text)).tobytes()


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(name: str) -> Tokenizer:
    if name not in _TOKENIZERS:
        _TOKENIZERS[name] = Tokenizer(name)
    return _TOKENIZERS[name]


def pieces(docs: DataFrame, window: int = WINDOW, name: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, key[, ids]): each document's ids and the end id, cut at
    multiples of the window. A null or empty text is the end id alone. `key` is a hash that orders equal lengths."""
    schema = _WITH_IDS if with_ids else _PIECES

    def run(batches):
        encode = tokenizer(name).id_bytes
        end = np.array([END], dtype="<u4").tobytes()
        for batch in text_rounds(batches):
            out: list[list] = [[] for _ in schema]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    row = [doc, start, len(part) // 4, zlib.crc32(part), total, zlib.crc32(b"%d:%d" % (doc or 0, start))]
                    if with_ids:
                        row.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, key long" + ", ids array<int>" * with_ids)


def combinations_of(lengths: np.ndarray, counts: np.ndarray, window: int, widest: int = 96) -> list[tuple[int, ...]]:
    """Pairs of lengths that fill the window, and triples of the `widest` most frequent lengths with what fills the rest."""
    have = set(lengths.tolist())
    found = {tuple(sorted((a, window - a))) for a in have if window - a in have}
    often = sorted(lengths[np.argsort(-counts, kind="stable")[:widest]].tolist())
    for i, a in enumerate(often):
        for b in often[i:]:
            if window - a - b in have:
                found.add(tuple(sorted((a, b, window - a - b))))
    return sorted(found)


def nnls(columns: list[tuple[int, ...]], target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative x that brings the combinations' summed bins near `target`: accelerated projected gradients.
    `columns` are the bins of each combination; a bin may appear twice."""
    if not columns:
        return np.zeros(0)
    bins = np.concatenate([np.array(c) for c in columns])
    owner = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    rows = np.bincount(bins, minlength=len(target)).astype(float)
    step = 1 / max(1.0, max(len(c) for c in columns) * rows.max())
    # Bins that few combinations use may move faster: scale by the rows' sums (a diagonal bound of the Hessian).
    scale = 1 / np.maximum(1.0, np.bincount(owner, weights=rows[bins], minlength=len(columns)))
    scale = np.maximum(scale, step)
    x = y = np.zeros(len(columns))
    momentum = 1.0
    for _ in range(rounds):
        fitted = np.bincount(bins, weights=y[owner], minlength=len(target))
        gradient = np.bincount(owner, weights=(fitted - target)[bins], minlength=len(columns))
        new = np.maximum(0.0, y - scale * gradient)
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        y = new + (momentum - 1) / after * (new - x)
        x, momentum = new, after
    return np.maximum(x, 0.0)


def greedy(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) for the pieces counted in `left`: the longest first, filled with the longest that fit;
    a pattern repeats for as long as its bins last."""
    left = left.copy()
    out = []
    length = len(left) - 1
    present = np.flatnonzero(left)
    while len(present):
        length = int(present[-1])
        pattern, room = Counter({length: 1}), window - length
        while room:
            fit = present[: np.searchsorted(present, room, side="right")]
            pick = next((int(x) for x in fit[::-1] if left[x] > pattern[int(x)]), 0)
            if not pick:
                break
            pattern[pick] += 1
            room -= pick
        times = min(int(left[x]) // n for x, n in pattern.items())
        out.append((tuple(sorted(pattern.elements(), reverse=True)), times))
        for x, n in pattern.items():
            left[x] -= n * times
        present = present[left[present] > 0]
    return out


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use each piece of the histogram exactly once."""
    counts = np.zeros(window + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out = [((window,), int(counts[window]))] if counts[window] else []
    counts[window] = 0
    lengths = np.flatnonzero(counts)
    columns = combinations_of(lengths, counts[lengths], window)
    solved = nnls(columns, counts.astype(float))
    left = counts.copy()
    for i in np.argsort(-solved, kind="stable"):
        need = Counter(columns[i])
        times = min(int(solved[i] + 0.5), *(int(left[x]) // n for x, n in need.items()))
        if times > 0:
            out.append((columns[i], times))
            for x, n in need.items():
                left[x] -= n * times
    return out + greedy(left, window)


def placements(packed: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset): the k-th piece of the run goes to sequence first + k at the offset."""
    used: Counter[int] = Counter()
    first = 0
    rows = []
    for lengths, times in packed:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], first, offset))
            used[length] += times
            offset += length
        first += times
    return rows


def pack(docs: DataFrame, window: int = WINDOW, name: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """Each piece with its sequence_id and offset; sequences hold at most `window` ids, offsets have no gaps.

    Ranks among pieces of equal length follow a hash of (doc_id, start), then doc_id and start, and the
    pieces of repeated rows get ranks of their own. The plan depends on the histogram alone. An empty
    table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    salts = max(SALTS, shuffle_partitions(spark))
    rows = materialize(pieces(docs, window, name, with_ids).withColumn("salt", F.pmod("key", F.lit(salts)).cast("int")), "pieces")
    counts = materialize(rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")  # at most window * salts rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = placements(plan(histogram, window))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = (
        rows.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("key", "doc_id", "start")) - 1)
        .join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own"))
    )
    by_length: dict[int, list] = {}
    for length, low, first, offset in placed:
        by_length.setdefault(length, []).append((low, first, offset))
    tables = {length: tuple(np.array(x, dtype=np.int64) for x in zip(*runs, strict=True)) for length, runs in by_length.items()}
    sent = spark.sparkContext.broadcast(tables)  # runs of the plan: bounded by the combinations and the bins
    columns = [c for c in rows.columns if c not in ("key", "salt")]

    def place(batches):
        for batch in batches:
            lengths = batch.column(columns.index("length")).to_numpy(zero_copy_only=False)
            ranks = batch.column(len(columns)).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
            for length in np.unique(lengths):
                own = lengths == length
                low, first, at = sent.value[int(length)]
                run = np.searchsorted(low, ranks[own], side="right") - 1
                sequence[own] = first[run] + ranks[own] - low[run]
                offset[own] = at[run]
            arrays = [*(batch.column(i) for i in range(len(columns))), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "sequence_id", "offset"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(place, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
