"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, units and names turn into typed slots, everything else into bare
lower-case words. Windows of five template tokens are hash-joined with the benchmark's. Matches of
one alignment (document position minus item position) must be consistent: equal slot values of the
item stand for equal values of the document (not the other way round: other numbers put in for two
different ones may happen to be equal). A document is contaminated by a template of which the
consistent matches at one place, of alignments within `SLACK` tokens, cover `coverage` or more of the
windows, so questions with other numbers or names are caught as well as verbatim ones, and the item's
windows scattered over a document are not. What a word is doesn't depend on what stands before it; where a
capital may be that of a name or of a sentence, windows are cut for both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeflow.llm.common import materialize, mix, table, text_rounds

WIDTH = 5
COVERAGE = 0.8
#: Tokens by which words put in or left out may shift the parts of one item against each other.
SLACK = 4
#: Benchmark windows up to which their hashes are sent to the tasks that read documents (8 bytes each); beyond, a bit for
#: each of 2 ** SIEVE_BITS slots is sent (16 MB), and what passes that sieve is joined.
MOST_SENT = 2_000_000
SIEVE_BITS, SIEVE_PARTS = 27, 64

# Unit words and symbols after numbers.
UNITS = frozenset("km m cm mm mi mile miles ft feet foot inch inches yard yards kg g mg lb lbs oz ton tons l ml liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros pound pounds cent cents usd eur gbp mph kph km/h m/s degree degrees c f kb mb gb tb w kw v hz khz mhz ghz".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
#: Words that are no name, though they often start a sentence.
COMMON = frozenset("a about above after again all also although always an and another any are as at be because been before below besides between both but by can compare compute could describe did do does during each either every everyone explain find finally first for from give given had has have he hence her here his how however i if in instead into is it its last later let like list many more most much my name neither never next no nor not now of often on once one only or other our out over please she should since so solve some sometimes soon state still such suppose than that the their them then there therefore these they this those though through thus to today together tomorrow too under unless until up us use very was we were what when whenever where whether which while who whom whose why with within without would write yesterday yet you your".split())
_NUMBER = re.compile(r"[+\-−]?[$€£¥]?[0-9][0-9.,:/]*(?:[%€$£¥]|st|nd|rd|th)?$")
_QUANTITY = re.compile(r"[+\-−]?[$€£¥]?([0-9][0-9.,]*)([a-z/%]+)$")
_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "“”‘’«»…–—"

LITERAL, NUMBER, UNIT, NAME = range(4)
_SLOT = [0, *(int(x) for x in mix(np.array([11, 12, 13], dtype=np.uint64)))]
_TOKEN_SEED, _VALUE_SEED = 1, 2
_ALONE, _VERBATIM = 16, 32  # seeds of windows that are whole texts, and of words as they are
_WINDOWS = pa.schema([("w", pa.int64()), ("id", pa.int64()), ("pos", pa.int32()), ("slots", pa.list_(pa.struct([("at", pa.int32()), ("value", pa.int64())])))])
_TEMPLATES = pa.schema([("item_id", pa.int64()), ("template", pa.int64()), ("width", pa.int32()), ("n_windows", pa.int64()), ("verbatim", pa.bool_())]).append(pa.field("windows", pa.list_(pa.struct([("w", pa.int64()), ("base", pa.int64()), ("pos", pa.int32()), ("slots", pa.list_(pa.struct([("at", pa.int32()), ("number", pa.int32())])))]))))


class Words(dict):
    """What each word can be, worked out once: (bare word's hash, value's hash, kind, ends a sentence, is a
    unit's word, is empty)."""

    def __missing__(self, word: str) -> int:
        bare = word.strip(_EDGES)
        low = bare.lower()
        letters, data = bare.isalpha(), low.encode()
        number = low in NUMBERS
        if not (letters or number):  # the edges hold no digits, so a word of letters alone is no other number
            number = bool(_NUMBER.match(word.strip("()[]{}\"'!?,.;:"))) or bool(_QUANTITY.match(low) and _QUANTITY.match(low)[2] in UNITS)
        name = letters and len(bare) > 1 and bare[0].isupper() and bare[1:].islower() and low not in COMMON
        row = (xxhash.xxh64_intdigest(data, _TOKEN_SEED), xxhash.xxh64_intdigest(data, _VALUE_SEED), NUMBER if number else NAME if name else LITERAL, word[-1] in ".!?:" or word.endswith(('."', ".'", '?"', '!"')), low in UNITS, not bare)
        self.new.append(row)
        self[word] = len(self)
        return self[word]

    def __init__(self):
        super().__init__()
        self.new: list[tuple] = []
        self.tables = [np.zeros(0, dtype=k) for k in (np.uint64, np.uint64, np.int8, bool, bool, bool)]

    def columns(self) -> list[np.ndarray]:
        """The rows as arrays; rows of words added since move there, as tuples take ten times the memory."""
        if self.new:
            more = zip(*self.new, strict=True)
            self.tables = [np.concatenate([t, np.array(c, dtype=t.dtype)]) for t, c in zip(self.tables, more, strict=True)]
            self.new = []
        return self.tables


#: Words remembered at most; then the memory starts anew.
_MOST_WORDS = 200_000


class Canonical:
    """Templates of texts; one per task."""

    def __init__(self):
        self.words = Words()

    def tokens(self, texts: list[str]) -> Tokens:
        """The tokens of all texts; those of punctuation alone are dropped."""
        if len(self.words) > _MOST_WORDS:
            self.words = Words()
        split = [t.split() for t in texts]
        place = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=sum(map(len, split)))
        word, value, kind, ends, unit, empty = (c[place] for c in self.words.columns())
        sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        starts = np.concatenate(([0], np.cumsum(sizes)))
        first = np.concatenate(([True], ends))[: len(place)]
        first[starts[:-1][sizes > 0]] = True
        inner = np.ones(len(place), dtype=bool)  # has a word of its text before it
        inner[starts[:-1][sizes > 0]] = False
        kind[1:][unit[1:] & (kind[:-1] == NUMBER) & inner[1:]] = UNIT
        keep = ~empty
        cuts = np.concatenate(([0], np.cumsum(keep)))[starts]
        word, kind, value, first = word[keep], kind[keep], value[keep], first[keep]
        return Tokens(np.where(kind == LITERAL, word, np.array(_SLOT, dtype=np.uint64)[kind]), word, kind, value, first, cuts)


class Tokens(NamedTuple):
    """Template hashes, words' hashes, kinds, values' hashes and sentence starts of texts' tokens; where each text begins."""

    token: np.ndarray
    word: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    first: np.ndarray
    cuts: np.ndarray


def _hashed(columns: Iterator[np.ndarray], n: int, seed: int) -> np.ndarray:
    h = np.full(n, seed, dtype=np.uint64)
    for c in columns:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c)
    return h


def cut_windows(t: Tokens, k: int, either: np.ndarray, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(places, hashes, mask) of all windows of `k` tokens within a text: as they are (mask 0), and with the word itself
    in place of each choice (the bits of mask) of its slots that are in `either`."""
    n = len(t.token) - k + 1
    if n <= 0:
        return
    ends = np.repeat(t.cuts[1:], np.diff(t.cuts))
    inside = np.arange(n) + k <= ends[:n]
    places = np.flatnonzero(inside)
    yield places, _hashed((t.token[i : i + n] for i in range(k)), n, seed)[places], 0
    held = np.zeros(n, dtype=bool)
    for i in range(k):
        held |= either[i : i + n]
    places = np.flatnonzero(held & inside)
    for mask in range(1, 1 << k):
        at = [i for i in range(k) if mask >> i & 1]
        own = places
        for i in at:
            own = own[either[own + i]]
        if len(own):
            yield own, _hashed(((t.word if i in at else t.token)[own + i] for i in range(k)), len(own), seed), mask


def _numbered(kind: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The number of each slot's value among the text's, by first use; -1 for words."""
    seen: dict[tuple, int] = {}
    return np.array([-1 if k == LITERAL else seen.setdefault((k, v), len(seen)) for k, v in zip(kind.tolist(), value.tolist(), strict=True)], dtype=np.int32)


def _told(t: Tokens, k: int, cut: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], bool]:
    """(an item's windows, whether any stands word for word): one with fewer than two words that are no slots fits any run of
    numbers or names, so it must be found as it is."""
    n = len(t.token) - k + 1
    told = np.convolve(t.kind == LITERAL, np.ones(k, dtype=np.int64), "valid") >= 2
    if told.all():
        return cut, False
    places = np.flatnonzero(~told)
    verbatim = _hashed((t.word[i : i + n] for i in range(k)), n, k + _VERBATIM)[places]
    return [*((p[told[p]], h[told[p]], mask) for p, h, mask in cut), (places, verbatim, (1 << k) - 1)], True


def templates(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, template, width, n_windows, verbatim, windows) of each item that has words; items of one template differ in slot values only."""

    def run(batches):
        canonical = Canonical()
        for batch in text_rounds(batches):
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = canonical.tokens([text or ""])
                if not len(t.token):
                    continue
                k = min(width, len(t.token))
                number = _numbered(t.kind, t.value)
                names = t.kind == NAME
                cut = [x for seed in ([k] if k == width else [k + _ALONE]) for x in cut_windows(t, k, names, seed)]
                base = cut[0][1].view(np.int64)
                cut, verbatim = _told(t, k, cut) if k == width else (cut, False)
                if k < width:  # in a longer text: with other values if two words or more remain, else as it is
                    other = cut_windows(t, k, names, k) if (t.kind == LITERAL).sum() > 1 else [(np.zeros(1, dtype=np.int64), _hashed(t.word[:, None], 1, k + _VERBATIM), (1 << k) - 1)]
                    cut += other
                windows = [{"w": w, "base": int(base[p]), "pos": p, "slots": [{"at": i, "number": int(number[p + i])} for i in range(k) if number[p + i] >= 0 and not mask >> i & 1]} for places, hashes, mask in cut for p, w in zip(places.tolist(), hashes.view(np.int64).tolist(), strict=True)]
                whole = xxhash.xxh64_intdigest(t.token.tobytes() + number.tobytes(), 3)
                rows.append((item, whole - (1 << 64) if whole >> 63 else whole, k, len(np.unique(base)), verbatim, windows))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_TEMPLATES)], schema=_TEMPLATES)

    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return benchmark.mapInArrow(run, "item_id long, template long, width int, n_windows long, verbatim boolean, windows array<struct<w:long,base:long,pos:int,slots:array<struct<at:int,number:int>>>>")


def _cut(t: Tokens, width: int, shorter: tuple[int, ...], verbatim: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    either = (t.kind == NAME) & t.first
    sizes = np.repeat(np.diff(t.cuts), np.diff(t.cuts))
    for k in (width, *shorter):
        for cut in cut_windows(t, k, either, k):
            yield k, *cut
    for k in shorter:
        for places, hashes, mask in cut_windows(t, k, either, k + _ALONE):
            alone = sizes[places] == k
            yield k, places[alone], hashes[alone], mask
    for k in (*shorter, *([width] if verbatim else [])):
        for places, hashes, _ in cut_windows(t._replace(token=t.word), k, np.zeros(len(either), dtype=bool), k + _VERBATIM):
            yield k, places, hashes, (1 << k) - 1


class Listed(NamedTuple):
    """The hashes that are looked for, sorted."""

    hashes: np.ndarray

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        return self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes


class Sieve(NamedTuple):
    """A bit for the first bits of each hash that is looked for: others may pass, none of those is lost."""

    bits: np.ndarray

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes.view(np.uint64) >> np.uint64(64 - SIEVE_BITS)
        return (self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def sieve(hashes: DataFrame) -> Sieve:
    """Of a column w of any length: a fixed 2 ** SIEVE_BITS bits, put together in parts."""
    each = (1 << SIEVE_BITS) // SIEVE_PARTS
    schema = pa.schema([("part", pa.int64()), ("bits", pa.binary())])

    def run(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = batch.column(0).to_numpy(zero_copy_only=False)
            for part in np.unique(slots // each).tolist():
                parts.setdefault(part, np.zeros(each, dtype=bool))[slots[slots // each == part] % each] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in parts.values()], pa.binary())], schema=schema)

    slots = hashes.select(F.shiftrightunsigned("w", 64 - SIEVE_BITS).alias("slot"))
    bits = np.zeros((SIEVE_PARTS, each // 8), dtype=np.uint8)
    for r in slots.repartition(F.floor(F.col("slot") / each)).mapInArrow(run, "part long, bits binary").collect():  # 16 MB at most
        bits[r["part"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return Sieve(bits.ravel())


def document_windows(docs: DataFrame, wanted: Listed | Sieve, width: int = WIDTH, shorter: tuple[int, ...] = (), verbatim: bool = False) -> DataFrame:
    """(w, id, pos, slots) of the documents' windows whose hash `wanted` lets through: windows of `width` tokens (with `verbatim` also word for word), of the widths in `shorter`, and whole texts of fewer tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        canonical, wanted = Canonical(), sent.value
        for batch in text_rounds(batches):
            ids, ws, at, slots = [], [], [], []
            docs = batch.column(0).to_pylist()
            t = canonical.tokens([x or "" for x in batch.column(1).to_pylist()])
            owner = np.repeat(np.arange(len(docs)), np.diff(t.cuts))
            for k, places, hashes, mask in _cut(t, width, shorter, verbatim):
                hashes = hashes.view(np.int64)
                found = np.flatnonzero(wanted.hits(hashes))
                places, hashes = places[found], hashes[found]
                for p, w in zip(places.tolist(), hashes.tolist(), strict=True):
                    ids.append(docs[owner[p]])
                    ws.append(w)
                    at.append(p - int(t.cuts[owner[p]]))
                    slots.append([{"at": i, "value": int(t.value[p + i].view(np.int64))} for i in range(k) if t.kind[p + i] != LITERAL and not mask >> i & 1])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ws, ids, at, slots), _WINDOWS, strict=True)], schema=_WINDOWS)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "w long, id long, pos int, slots array<struct<at:int,value:long>>")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, item_id, n_items, n_windows, n_matched, coverage): documents that hold a benchmark template.

    One row for each (document, template); item_id is the template's smallest item and n_items how many
    items share it. Texts without words hold and are nothing. An item of fewer than `width` tokens is one
    window of its own width; within a longer document it has other values only if two or more of its
    words are no slots, else it must be there as it is. In longer items the same goes for each
    window. Rows that share a doc_id are one
    document; rows with a null doc_id come under null. An item with a null item_id is looked for like
    any other. A repeated row changes nothing. Empty tables give an empty table; other columns are
    ignored. Texts are read some 2 MB at a time; a longer one is a round of memory of its own.
    """
    items = materialize(templates(benchmark, width), "templates")
    kinds = items.groupBy("template").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items"), F.max("n_windows").alias("n_windows"))
    windows = items.select("template", F.explode("windows").alias("x")).distinct().select("template", "x.w", "x.base", F.col("x.pos").alias("item_pos"), F.col("x.slots").alias("item_slots"))
    windows = materialize(windows, "item-windows")
    distinct = windows.select("w").distinct()
    shorter = tuple(sorted(r["width"] for r in items.filter(F.col("width") < width).select("width").distinct().collect()))  # below `width`
    if distinct.limit(most_sent + 1).count() <= most_sent:
        listed = np.sort(np.array([r["w"] for r in distinct.collect()], dtype=np.int64))  # bounded by most_sent
        wanted = Listed(listed if len(listed) else np.array([0], dtype=np.int64))
    else:
        wanted = sieve(distinct)
    found = materialize(document_windows(docs, wanted, width, shorter, not items.filter("verbatim").isEmpty()), "doc-windows")
    matches = materialize(found.join(windows, "w").select(F.col("id").alias("doc_id"), "template", "base", (F.col("pos") - F.col("item_pos")).alias("shift"), F.arrays_zip(F.col("slots.value").alias("value"), F.col("item_slots.number").alias("number")).alias("slots")), "matches")
    where = ["doc_id", "template", "shift"]
    values = matches.select(*where, F.explode("slots").alias("s")).groupBy(*where, F.col("s.number").alias("number")).agg(F.min("s.value").alias("low"), F.max("s.value").alias("high"))
    broken = values.filter("low != high").select(*(F.col(c).alias(f"{c}_") for c in where)).distinct()
    same = matches["doc_id"].eqNullSafe(broken["doc_id_"]) & (matches["template"] == broken["template_"]) & (matches["shift"] == broken["shift_"])
    # Places of 2 * SLACK alignments, each alignment in two of them: any SLACK + 1 neighbouring ones share a place.
    half = F.floor(F.col("shift") / F.lit(SLACK))
    sound = matches.join(broken, same, "left_anti").select("doc_id", "template", "base", F.explode(F.array(half, half + 1)).alias("place"))
    covered = sound.groupBy("doc_id", "template", "place").agg(F.countDistinct("base").alias("n_matched"))
    best = covered.groupBy("doc_id", "template").agg(F.max("n_matched").alias("n_matched"))
    rows = best.join(kinds, "template").withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
    return rows.filter(F.col("coverage") >= coverage).select("doc_id", "item_id", "n_items", "n_windows", "n_matched", "coverage")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
