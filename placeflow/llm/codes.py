"""Token ids in directly addressable codes.

A file holds the ids of a run of documents. An id is split into chunks, lowest first: level 0 has the lowest chunk of every
id, level 1 the next chunk of those ids that have one, and so on. A bitmap at each level says which ids go on, and a rank
directory counts its ones, so the place of an id's next chunk is found from counts alone: any id is read without its
neighbours. Chunk widths are those that make the file smallest, chosen from the histogram of the ids' bit lengths.

    magic | 8-byte length of the head | head (JSON: counts, widths, offset and size of each section) | sections
    sections: doc_ids int64, known uint8, starts uint64, then for each level its chunks, bitmap and rank directory (uint64 words)
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeflow.llm.common import encoded, fresh_path, materialize, shuffle_partitions, table, text_rounds

if TYPE_CHECKING:
    from tokenizers import Tokenizer

MAGIC = b"DACODES1"
END = 2
#: Ids after which a task begins another file, ids that one round of numpy work holds, and words of a bitmap for each count of ones.
ROLL = 2_000_000
ROUND = 262_144
BLOCK = 8
#: Words that an encoder remembers before it forgets all, and characters of a text that it takes at a time.
MOST_WORDS = 250_000
LONGEST = 500_000

#: Texts that hold anything else go to the tokenizer itself.
_OTHER = re.compile(r"[^\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]")
_WORDS = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
#: The same rule for the letters, digits and white space that `_OTHER` leaves, lower-cased.
_SPACE = re.compile(r"[\t-\r ]")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_WORDS_OF_LINES = re.compile("\n|" + _WORD.pattern)


def _letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, the others in turn."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _slices(text: str) -> Iterator[str]:
    """The text in parts of about LONGEST characters, cut before white space."""
    at = 0
    while len(text) - at > LONGEST:
        space = _SPACE.search(text, at + LONGEST)
        if space is None:
            break
        yield text[at : space.start()]
        at = space.start()
    yield text[at:]


class Letters:
    """Words of Latin-1 letters by rank: a faster encoder over the tokenizer's own merges, where its ids are in their order.

    A byte-level model with word ends has two symbols for a byte, as the last one of a word is another. The letters' bytes are few
    enough for both kinds to be ASCII characters: below 64 inside a word, from 64 on at its end. So a text of words needs no gaps, and a token
    that ends a word says so.
    """

    BYTES = (*range(ord("a"), ord("z") + 1), 0xC3, *range(0x9F, 0xC0))

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], letters: dict[int, str]):
        import tiktoken

        self.code = np.full(256, 255, np.uint8)
        self.code[list(self.BYTES)] = np.arange(len(self.BYTES))
        symbols = {letters[b]: i for i, b in enumerate(self.BYTES)}
        ranks = {}
        for token, i in vocabulary.items():
            body = token.removesuffix("</w>")
            if body and all(c in symbols for c in body):
                codes = [symbols[c] for c in body]
                codes[-1] += 64 * (body != token)
                ranks[bytes(codes)] = i
        self.fits = all(vocabulary.get(a + b) == 512 + i for i, (a, b) in enumerate(merges)) and len(ranks) > 2 * len(self.BYTES) - 1
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for k, i in ranks.items() if k[-1] >= 64]] = True
        self.ranks = tiktoken.Encoding("letters", pat_str="[\\x00-\\x3f]*[\\x40-\\x7f]", mergeable_ranks=ranks, special_tokens={}) if self.fits else None

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, where each word's end)."""
        data = np.frombuffer("\n".join([*words, ""]).encode(), np.uint8)
        codes, gaps = self.code[data], data == 10
        codes[np.flatnonzero(gaps) - 1] += 64
        ids = np.array(self.ranks.encode_ordinary(codes[~gaps].tobytes().decode("ascii")), "<u4")
        return ids, np.flatnonzero(self.ends[ids]) + 1


class Encoder:
    """Ids of texts by a published tokenizer, little-endian and 32 bits wide.

    Where the file's own rules say that words are encoded one by one (lower case, white space dropped, words by a pattern),
    a text of ASCII and Latin-1 letters is parted into words here and each distinct one is encoded once: words of letters by
    rank (`Letters`), others by the tokenizer's model.
    Other texts, texts that spell one of its special tokens and files with other rules go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole: Tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            saved = json.load(f)
        steps = [(n["type"], n.get("content")) for n in (saved["normalizer"] or {}).get("normalizers", ())]
        rules = (saved["pre_tokenizer"] or {}).get("pretokenizers", ())
        self.by_word = steps == [("NFC", None), ("Replace", " "), ("Lowercase", None)] and len(rules) == 2 and rules[0] == _WORDS and not rules[1].get("use_regex") and not rules[1].get("add_prefix_space")
        self.special = [t["content"] for t in saved["added_tokens"]]
        bare = saved | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}
        self.words: Tokenizer | None = Tokenizer.from_str(json.dumps(bare)) if self.by_word else None
        self.letters = _letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in saved["model"]["merges"]]
        quick = Letters(saved["model"]["vocab"], merges, self.letters) if self.by_word else None
        self.quick = quick if quick is not None and quick.fits else None
        self.known: dict[str, bytes] = {"\n": b""}

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.by_word and not _OTHER.search(t) and not any(s in t for s in self.special) for t in texts]
        rest = iter(self.whole.encode_batch([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        own = iter(self._by_word([t for t, p in zip(texts, plain, strict=True) if p]))
        return [next(own) if p else np.array(next(rest).ids, "<u4").tobytes() for p in plain]

    def _by_word(self, texts: list[str]) -> Iterator[bytes]:
        """Long texts are cut at white space, so that what is held at a time is bounded unless a word is that long."""
        cuts = [list(_slices(t)) for t in texts]
        held: list[str] = []
        done: list[bytes] = []
        for one in [*(c for cs in cuts for c in cs), None]:
            if one is None or sum(map(len, held)) + len(one) > 2 * LONGEST:
                done += self._ids(held)
                held = []
            if one is not None:
                held.append(one)
        at = iter(done)
        for cs in cuts:
            yield b"".join(next(at) for _ in cs)

    def _ids(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        parts = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = parts.values.dictionary_encode()
        spelled = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary.cast(pa.string())), "\n")[0].as_py() + "\n"
        words = _WORDS_OF_LINES.findall(spelled.lower())
        if len(self.known) > MOST_WORDS:
            self.known = {"\n": b""}
        self._learn(list(set(words) - self.known.keys()))
        own = list(map(self.known.__getitem__, words))
        flat, upto = np.frombuffer(b"".join(own), "<u4"), np.cumsum(np.fromiter(map(len, own), np.int64, len(own))) // 4
        ends = upto[np.fromiter(map("\n".__eq__, words), bool, len(words))]
        starts = np.concatenate([[0], ends[:-1]])
        sizes, at = ends - starts, coded.indices.to_numpy()
        before = np.concatenate([[0], np.cumsum(sizes[at])])
        ids = flat[np.repeat(starts[at] - before[:-1], sizes[at]) + np.arange(before[-1])].astype("<u4")
        bounds = before[parts.offsets.to_numpy()].tolist()
        return [ids[low:high].tobytes() for low, high in zip(bounds, bounds[1:], strict=False)]

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha()] if self.quick else []
        if plain:
            self._keep(plain, *self.quick.encode(plain))
            words = [w for w in words if not w.isalpha()]
        if words:
            spelled = [w.encode().decode("latin-1").translate(self.letters) for w in words]
            found = self.words.encode(spelled, is_pretokenized=True, add_special_tokens=False)
            self._keep(words, np.array(found.ids, "<u4"), np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))))

    def _keep(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        data, ends = ids.tobytes(), (4 * ends).tolist()
        self.known.update(zip(words, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))


@cache
def encoder(name: str) -> Encoder:
    import os

    import public_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Encoder(public_tokenizers.path(name if "." in name else f"{name}.json"))


def widths(lengths: np.ndarray) -> tuple[int, ...]:
    """The chunk widths, lowest first, that make ids smallest whose bit lengths are so many; `lengths[b]` ids have b bits.
    A chunk is at most 32 bits wide and costs a bit more where a bitmap stands above it."""
    over = [int(lengths[1:].sum()), *(int(lengths[j + 1 :].sum()) for j in range(1, 33))]
    best: dict[int, tuple[float, tuple[int, ...]]] = {33: (0, ())}
    for low in range(32, -1, -1):
        if not over[low]:
            best[low] = (0, ())
            continue
        options = []
        for w in range(1, 33 - low):
            more = over[low + w] if low + w <= 32 else 0
            options.append((over[low] * (w + (1 + 1 / BLOCK if more else 0)) + best[low + w][0], (w, *best[low + w][1])))
        best[low] = min(options)
    return best[0][1] or (1,)


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """How many ids have each bit length; zero has one bit."""
    return np.bincount(np.maximum(1, np.ceil(np.log2(ids.astype(np.float64) + 1)).astype(np.int64)), minlength=34)[:34]


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of `width` bits each, one after the other, in 64-bit words; a word more at the end."""
    out = np.zeros((len(values) * width + 63) // 64 * 8 + 8, np.uint8)
    for at in range(0, len(values), ROUND):  # a multiple of eight values is a whole number of bytes
        bits = (values[at : at + ROUND, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
        part = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        out[at * width // 8 : at * width // 8 + len(part)] = part
    return out.view("<u8")


def rank_directory(bitmap: np.ndarray) -> np.ndarray:
    """The ones before each block of words."""
    ones = np.bitwise_count(bitmap).astype(np.uint64)
    ones = np.concatenate([ones, np.zeros(-len(ones) % BLOCK, np.uint64)]).reshape(-1, BLOCK).sum(axis=1, dtype=np.uint64)
    return np.concatenate([[np.uint64(0)], np.cumsum(ones, dtype=np.uint64)])


def encode_file(docs: list[tuple[int | None, bytes]]) -> bytes:
    """A file of documents (id, ids as little-endian 32-bit integers)."""
    ids = np.frombuffer(b"".join(d for _, d in docs), "<u4")
    starts = np.cumsum([0, *(len(d) // 4 for _, d in docs)]).astype("<u8")
    lengths = sum((bit_lengths(ids[at : at + ROUND]) for at in range(0, len(ids), ROUND)), np.zeros(34, np.int64))
    sections = {"doc_ids": np.array([i or 0 for i, _ in docs], "<i8"), "known": np.array([i is not None for i, _ in docs], np.uint8), "starts": starts}
    chunks, rest = widths(lengths), ids
    for level, width in enumerate(chunks):
        sections[f"chunks{level}"] = pack(rest & np.uint32((1 << width) - 1), width)
        rest = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
        if level < len(chunks) - 1:
            more = rest > 0
            sections[f"more{level}"] = pack(more.astype(np.uint32), 1)
            sections[f"ranks{level}"] = rank_directory(sections[f"more{level}"])
            rest = rest[more]
    parts, head, at = [], {}, 0
    for name, values in sections.items():
        data = values.tobytes()
        data += bytes(-len(data) % 8)
        head[name] = (at, values.nbytes, zlib.crc32(data))
        parts.append(data)
        at += len(data)
    said = json.dumps({"docs": len(docs), "ids": len(ids), "widths": chunks, "sections": head}).encode()
    said += b" " * (-len(said) % 8)
    return b"".join([MAGIC, len(said).to_bytes(8, "little"), said, *parts])


class Codes:
    """Ids by their place. `read(offset, size)` gives bytes of the file: from memory, or by seeking in it."""

    def __init__(self, read: Callable[[int, int], bytes], check: bool = False):
        if read(0, 8) != MAGIC:
            raise ValueError("not a file of token codes")
        size = int.from_bytes(read(8, 8), "little")
        self.head, self.base, self.read = json.loads(read(16, size)), 16 + size, read
        self.ids, self.docs = self.head["ids"], self.head["docs"]
        for name, (at, size, crc) in self.head["sections"].items() if check else ():
            if zlib.crc32(read(self.base + at, size + -size % 8)) != crc:
                raise ValueError(f"damaged {name}")
        self.whole: dict[str, np.ndarray] = {}

    def section(self, name: str, kind: str) -> np.ndarray:
        at, size, _ = self.head["sections"][name]
        return np.frombuffer(self.read(self.base + at, size), kind)

    def load(self) -> Codes:
        """Hold all sections: for reading most of a file."""
        self.whole = {name: self.section(name, "<u8") for name in self.head["sections"] if name.startswith(("chunks", "more", "ranks"))}
        return self

    def words(self, name: str, at: np.ndarray) -> np.ndarray:
        """64-bit words of a section; those not held are read by runs, nothing between them."""
        if name in self.whole:
            return self.whole[name][at]
        start, size, _ = self.head["sections"][name]
        wanted, back = np.unique(at, return_inverse=True)
        runs = np.split(wanted, np.flatnonzero(np.diff(wanted) > 8) + 1)
        found = [np.frombuffer(self.read(self.base + start + 8 * int(r[0]), min(size - 8 * int(r[0]), 8 * int(r[-1] - r[0] + 1))), "<u8")[r - r[0]] for r in runs if len(r)]
        return np.concatenate(found)[back] if found else np.zeros(0, np.uint64)

    def _chunk(self, level: int, width: int, at: np.ndarray) -> np.ndarray:
        bit = at * width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        low = self.words(f"chunks{level}", word) >> shift
        high = np.where(shift > 0, self.words(f"chunks{level}", word + 1) << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (low | high) & np.uint64((1 << width) - 1)

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """The ones of the level's bitmap before each place."""
        word = at >> 6
        block = word // BLOCK
        ones = self.words(f"ranks{level}", block).astype(np.int64)
        for k in range(BLOCK - 1):
            inside = np.flatnonzero(block * BLOCK + k < word)
            ones[inside] += np.bitwise_count(self.words(f"more{level}", block[inside] * BLOCK + k)).astype(np.int64)
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return ones + np.bitwise_count(self.words(f"more{level}", word) & below).astype(np.int64)

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids at these places of the file, in any order."""
        at, rows = np.asarray(places, np.int64), np.arange(len(places))
        if len(at) and (at.min() < 0 or at.max() >= self.ids):
            raise IndexError("a place outside the file")
        out, shift = np.zeros(len(at), np.uint64), 0
        for level, width in enumerate(self.head["widths"]):
            out[rows] |= self._chunk(level, width, at) << np.uint64(shift)
            shift += width
            if level == len(self.head["widths"]) - 1 or not len(at):
                break
            more = (self.words(f"more{level}", at >> 6) >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            rows, at = rows[more], self._rank(level, at[more])
        return out.astype("<u4")

    def run(self, low: int, high: int) -> np.ndarray:
        """The ids at the places from `low` to before `high`. What goes on at each level is a run too, so its ends alone
        are looked up in the rank directory."""
        out, rows, shift = np.zeros(high - low, np.uint64), np.arange(high - low), 0
        for level, width in enumerate(self.head["widths"]):
            at = np.arange(low, high)
            out[rows] |= self._chunk(level, width, at) << np.uint64(shift)
            shift += width
            if level == len(self.head["widths"]) - 1 or not len(at):
                break
            words = self.words(f"more{level}", np.arange(low >> 6, (high - 1 >> 6) + 1))
            more = np.unpackbits(words.view(np.uint8), bitorder="little")[low & 63 : (low & 63) + high - low].view(bool)
            low = int(self._rank(level, np.array([low]))[0])
            rows = rows[more]
            high = low + len(rows)
        return out.astype("<u4")

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(id, start, ids) of each document."""
        starts = self.section("starts", "<u8").tolist()
        for i, known, a, b in zip(self.section("doc_ids", "<i8").tolist(), self.section("known", np.uint8), starts[:-1], starts[1:], strict=True):
            yield i if known else None, a, b - a


def open_codes(path: str, whole: bool = False) -> Codes:
    """A file of the shared folder: read once and checked, or by seeking."""
    system, place = fs.FileSystem.from_uri(path)
    if whole:
        with system.open_input_file(place) as f:
            data = f.read()
        return Codes(lambda at, size: data[at : at + size], check=True).load()
    f = system.open_input_file(place)
    return Codes(lambda at, size: f.read_at(size, at))


_FILES = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("path", pa.string()), ("at", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def write_store(docs: DataFrame, tokenizer: str = "word_bpe_49k", end: int | None = END, roll: int = ROLL) -> DataFrame:
    """Write the ids of each row's text, and `end` after them, in ascending order of doc_id (null first); the files:
    shard, part, path, docs, ids, bytes and `base`, the ids in the files before.

    Rows of equal ids follow each other by a hash of their texts, so equal rows alone are interchangeable. A null text is an
    empty one: `end` alone. Other columns are ignored. One text of any length is held by its task alone. An empty table gives
    no files. A file is written under a name of its own and the names are committed as a table, so what lost or
    repeated attempts wrote is never read.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "codes")
    last = b"" if end is None else int(end).to_bytes(4, "little")

    def run(batches):
        shard, made, held, size = TaskContext.get().partitionId(), [], [], 0

        def close():
            data = encode_file(held)
            path = f"{folder}/{uuid.uuid4().hex}.dac"
            system, place = fs.FileSystem.from_uri(path)
            system.create_dir(place.rpartition("/")[0], recursive=True)
            with system.open_output_stream(place, compression=None) as out:
                out.write(data)
            made.append((shard, len(made), path, len(held), size, len(data)))

        for batch in text_rounds(batches):
            texts = [t.decode() for t in encoded(batch.column(1))]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(texts), strict=True):
                held.append((doc_id, ids + last))
                size += len(ids + last) // 4
                if size >= roll:
                    close()
                    held, size = [], 0
        if held:
            close()
        yield _batch(made, _FILES)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = ["doc_id", "hash", "part"]  # a third of all rows may have one id, and even one text
    dealt = docs.withColumn("hash", F.xxhash64("text")).withColumn("part", F.spark_partition_id()).repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    files = materialize(dealt.select("doc_id", "text").mapInArrow(run, "shard long, part long, path string, docs long, ids long, bytes long"), "codes-files")
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return materialize(files.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))), "codes-store")


def read_documents(store: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, path, at) of each document, read back from the files: start counts the ids of all
    documents before it, `at` those before it in its file. Ids are taken by their places, a run at a time."""

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, rows = open_codes(path, whole=True), []
                crcs = _crcs(codes)
                for (doc_id, at, n), crc in zip(codes.documents(), crcs, strict=True):
                    rows.append((doc_id, base + at, n, crc, path, at))
                yield _batch(rows, _DOCS)

    by_file = store.select("path", "base").repartition(max(1, store.count()), "path")
    return by_file.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, path string, at long")


def _crcs(codes: Codes) -> Iterator[int]:
    """crc32 of each document's ids, taken from the file a round of places at a time."""
    low, data = 0, b""
    for _, at, n in codes.documents():
        crc, done = 0, at
        while done < at + n:
            if done >= low + len(data) // 4:
                low, data = done, codes.run(done, min(codes.ids, done + ROUND)).tobytes()
            upto = min(at + n, low + len(data) // 4)
            crc = zlib.crc32(data[4 * (done - low) : 4 * (upto - low)], crc)
            done = upto
        yield crc


def take(store: DataFrame, wanted: DataFrame, stride: int = ROLL) -> DataFrame:
    """(place, id) of each row of `wanted` (place: ids before it in the whole store). Only the words that hold a wanted id, and
    their ranks, are read. Places outside the store and null ones give no row; repeated ones one each.

    Files meet places by stretches of `stride` ids, an equi-join; lookups of one file are dealt out by place."""
    covers = F.explode(F.sequence(F.expr(f"base DIV {stride}"), F.expr(f"(base + ids - 1) DIV {stride}"))).alias("stretch")
    files = store.filter("ids > 0").select("path", "base", "ids", covers)
    places = wanted.select(F.col("place").cast("long").alias("place")).filter("place >= 0").withColumn("stretch", F.expr(f"place DIV {stride}"))
    found = places.join(files, "stretch").filter("place >= base AND place < base + ids")
    dealt = found.select("path", "base", "place", F.expr(f"place DIV {ROUND // 4}").alias("slice")).repartition("path", "slice").sortWithinPartitions("path", "place")
    schema = pa.schema([("place", pa.int64()), ("id", pa.int64())])

    def run(batches):
        path, codes = None, None
        for batch in batches:
            paths = np.array(batch.column(0).to_pylist(), dtype=object)
            at, base = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 1))
            for low, high in _runs(paths):
                if paths[low] != path:
                    path, codes = paths[low], open_codes(paths[low])
                yield pa.RecordBatch.from_arrays([pa.array(at[low:high], pa.int64()), pa.array(codes.take(at[low:high] - base[low:high]).astype(np.int64))], schema=schema)

    return dealt.mapInArrow(run, "place long, id long")


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return ((a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_store(table(spark, sf_dir, "documents"))).select("doc_id", "start", "n_tokens", "ids_crc32")
