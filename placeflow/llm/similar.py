"""SimHash near copies by the similarity of word shingles, for copies that were edited much.

The similarity is the cosine of two sets of shingles, which is what the bits of SimHash prints estimate, or, if asked
for, Jaccard's.

Pairs that share one of their rarest shingles meet: an exact rule, which no similar pair escapes. All
texts that share one with the same shortest text meet in one group, so a pair meets a few times and not
once for each common shingle. There the dealt method decides: Hamming distances of wide SimHash prints to
reference prints (texts of the group, each the one farthest from those before it) are tabulated, pairs
whose distances to any reference differ by more than the reach are discarded, then those whose own
distance exceeds it. Only texts with a partner left travel, and survivors are verified on their sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeflow.llm.common import encoded, materialize, mix, scratch, text_rounds, word_hashes
from placeflow.llm.components import components
from placeflow.llm.simhash import majority

#: Buckets of shingle counts, by which rare shingles come first, and the parts in which they are summed.
BUCKETS, PARTS = 1 << 20, 64
#: 64-bit words of a print, and reference prints of a meeting.
WORDS, REFERENCES = 8, 8
_SALTS = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_COUNTS = pa.schema([("part", pa.int32()), ("counts", pa.binary())])
#: What a row is known by: whether it has no id, its id, and 96 bits of its text.
ROW = ["none", "id", "t0", "t1"]
_PREFIXES = pa.schema([("none", pa.bool_()), *((c, pa.int64()) for c in ("id", "t0", "t1", "d0", "d1")), ("size", pa.int32()), ("rare", pa.list_(pa.int64())), ("print", pa.binary())])
_MET = pa.schema([("node", pa.int64()), ("size", pa.int32()), ("low", pa.int64())])
_HELD = pa.schema([("meeting", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("block", pa.int64())])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_KINDS = {pa.bool_(): "boolean", pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_KINDS[f.type]}" for f in schema)


def _row_key(docs: DataFrame) -> list[Column]:
    id_, text = docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit(""))
    return [id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("id"), F.xxhash64(text).alias("t0"), F.crc32(text).cast("long").alias("t1")]


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct hashes of each text's lower-cased word shingles, sorted; of its whole sequence if it is shorter."""
    words, owner, _ = word_hashes(texts)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()

    def hashes(tokens: np.ndarray, k: int) -> np.ndarray:
        h = np.full(max(0, len(tokens) - k + 1), k, dtype=np.uint64)
        for i in range(k):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + tokens[i : i + len(h)])
        return h

    whole = hashes(words, width)
    return [np.unique(whole[a : b - width + 1] if b - a >= width else hashes(words[a:b], b - a) if b > a else whole[:0]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def wide_print(shingles: np.ndarray) -> bytes:
    """The SimHash print of a set of shingle hashes."""
    return majority(np.stack([mix(shingles ^ salt) for salt in _SALTS], axis=1)).tobytes()


@dataclass(frozen=True)
class Measure:
    """A similarity of two sets by their sizes and what they have in common, and its threshold."""

    share: Fraction
    cosine: bool = True

    @property
    def ratio(self) -> Fraction:
        """The least share of a set that a similar set has in common with it, and the least ratio of their sizes."""
        return self.share**2 if self.cosine else self.share

    def holds(self, both: int, a: int, b: int) -> bool:
        n, d = self.share.numerator, self.share.denominator
        return (both * d) ** 2 >= n * n * a * b if self.cosine else both * d >= (a + b - both) * n

    def reach(self, size: np.ndarray) -> np.ndarray:
        """Bits in which the prints of two similar sets may differ, the smaller of `size` shingles. Two bits differ with a
        chance of the angle over pi at most, and of some 0.04 more in small sets, where sums are often zero; six standard
        deviations are added, so a pair at the threshold exceeds it once in 10^8."""
        chance = acos(float(self.share if self.cosine else 2 * self.share / (1 + self.share))) / pi
        bits = [ceil(64 * WORDS * p + 6 * sqrt(64 * WORDS * p * (1 - p))) for p in (chance, chance + 0.04)]
        return np.where(size >= 32, *bits)

    def limits(self, small: np.ndarray, large: np.ndarray) -> np.ndarray:
        """The reach of pairs of sets of these sizes; -1 where the sizes alone rule the similarity out."""
        low, high = np.minimum(small, large), np.maximum(small, large)
        return np.where(low * self.ratio.denominator >= high * self.ratio.numerator, self.reach(low), -1).astype(np.int16)


def bucket_counts(docs: DataFrame, width: int) -> np.ndarray:
    """How many texts' shingles fall in each of BUCKETS buckets: a fixed size, whatever the corpus."""

    def count(batches):
        total = np.zeros(BUCKETS, dtype="<i8")
        for part in text_rounds(batches):
            sets = shingle_sets(encoded(part.column(0)), width)
            total += np.bincount((np.concatenate(sets) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        parts = [(i, x.tobytes()) for i, x in enumerate(np.split(total, PARTS)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], f.type) for i, f in enumerate(_COUNTS)], schema=_COUNTS)

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[i] = totals.get(i, 0) + np.frombuffer(x, dtype="<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], schema=_COUNTS)

    counts = np.zeros((PARTS, BUCKETS // PARTS), dtype="<i8")
    for r in docs.select("text").mapInArrow(count, _sql(_COUNTS)).repartition("part").mapInArrow(add, _sql(_COUNTS)).collect():  # 8 MB at most
        counts[r["part"]] = np.frombuffer(r["counts"], dtype="<i8")
    return counts.ravel()


def _prefixes(docs: DataFrame, width: int, counts: np.ndarray, ratio: Fraction) -> DataFrame:
    """Of each row (ROW, text): 128 bits that stand for its set, the set's size, its rarest shingles, so many that two
    sets that have a share of `ratio` in common have one of these in common, and its print."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)  # 8 MB

    def rarest(x: np.ndarray) -> np.ndarray:
        most = len(x) - -(-len(x) * ratio.numerator // ratio.denominator) + 1 if len(x) else 0
        return x[np.lexsort((x, sent.value[(x & np.uint64(BUCKETS - 1)).astype(np.int64)]))[:most]].view(np.int64)

    def run(batches):
        for part in text_rounds(batches):
            sets = shingle_sets(encoded(part.column(4)), width)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), dtype="<i8").reshape(-1, 2)
            columns = [*part.columns[:4], pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array([len(x) for x in sets], pa.int32()), pa.array([rarest(x) for x in sets], pa.list_(pa.int64())), pa.array([wide_print(x) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=_PREFIXES)

    return docs.mapInArrow(run, _sql(_PREFIXES))


def _met(ratio: Fraction):
    """(node, size, low): the rows of cells that have a partner of a size that allows the similarity, each with the first
    row of its run: sizes of a cell, sorted, with no gap that no pair can bridge. Rows come sorted by (cell, size, node)."""

    def run(batches):
        cell = last = first = None
        alone = False
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, nodes, sizes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            sizes = sizes.astype(np.int64)
            goes_on = cell is not None and cells[0] == cell and last * ratio.denominator >= sizes[0] * ratio.numerator
            new = np.concatenate(([not goes_on], (cells[1:] != cells[:-1]) | (sizes[:-1] * ratio.denominator < sizes[1:] * ratio.numerator)))
            which = np.cumsum(new) - (not goes_on)
            counts = np.bincount(which)
            lows = np.concatenate(([first[0]] if goes_on else [], nodes[new])).astype(np.int64)
            many = counts > 1
            if goes_on:
                many[0] = True
            keep = many[which]
            columns = [nodes[keep], sizes[keep], lows[which][keep]]
            if goes_on and alone:  # the run's first row waited for a second
                columns = [np.concatenate(([x], c)) for x, c in zip((*first, first[0]), columns, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)).cast(f.type) for c, f in zip(columns, _MET, strict=True)], schema=_MET)
            if which[-1] or not goes_on:
                start = np.flatnonzero(new)[-1]
                first, alone = (int(nodes[start]), int(sizes[start])), bool(counts[-1] == 1)
            else:
                alone = False
            cell, last = cells[-1], int(sizes[-1])

    return run


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of the prints `a` to `b` (broadcast over rows)."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def references(prints: np.ndarray, most: int = REFERENCES) -> np.ndarray:
    """Rows of `prints` that are far from each other: the first, then each time the one farthest from those chosen."""
    chosen = [0]
    nearest = distances(prints, prints[0])
    while len(chosen) < most and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(prints, prints[chosen[-1]]))
    return prints[chosen]


def near_pairs(prints: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, measure: Measure) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, rows) of the pairs of a meeting within reach, some rows at a time: of one block all pairs, of two blocks
    those between them."""
    a, b = np.flatnonzero(blocks == blocks.min()), np.flatnonzero(blocks == blocks.max())
    same = blocks.min() == blocks.max()
    table = references(prints, REFERENCES if len(prints) > 16 else 1)
    coordinates = np.stack([distances(prints, r) for r in table], axis=1)
    for at in range(0, len(a), 128):
        own = a[at : at + 128]
        limit = measure.limits(sizes[own][:, None], sizes[b][None, :])
        near = limit >= 0
        if same:
            near &= own[:, None] < b[None, :]
        for c in coordinates.T:  # discard by the largest difference of distances to the references
            near &= np.abs(c[own][:, None] - c[b][None, :]) <= limit
        x, y = np.nonzero(near)
        kept = distances(prints[own[x]], prints[b[y]]) <= limit[x, y]
        yield own[x[kept]], b[y[kept]]


def _meetings(batches, columns: int):
    """The rows of each meeting as a list of columns; rows come sorted by meeting, in the first column."""
    rest: list | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        cuts = np.concatenate(([0], np.flatnonzero(now[0][1:] != now[0][:-1]) + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield [x[a:b] for x in now]
        rest = [x[cuts[-1] :] for x in now]  # the last meeting may go on
    if rest is not None:
        yield rest


def _with_partner(measure: Measure):
    """(meeting, node, size, block) of the rows that have a pair within reach in their meeting."""

    def run(batches):
        waiting: list[list[np.ndarray]] = []
        held = 0
        for rows in _meetings(batches, 5):
            prints = np.frombuffer(b"".join(rows[4]), dtype="<u8").reshape(-1, WORDS)
            hit = np.zeros(len(prints), dtype=bool)
            for x, y in near_pairs(prints, rows[2], rows[3], measure):
                hit[x] = hit[y] = True
            if hit.any():
                waiting.append([c[hit] for c in rows[:4]])
                held += int(hit.sum())
            if held > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*waiting, strict=True), _HELD, strict=True)], schema=_HELD)
                waiting, held = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*waiting, strict=True), _HELD, strict=True)], schema=_HELD)

    return run


def _verified(measure: Measure, width: int):
    """(u, v): links of a meeting whose sets are similar, so many that all that are linked
    directly or over others of the meeting are connected; at most one less than its rows."""

    def links(nodes, sizes, blocks, prints, sets):
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        ends = np.cumsum([len(x) for x in sets])
        marked = np.zeros(int(ids.max()) + 1, dtype=bool)
        group = np.arange(len(nodes))
        for x, y in near_pairs(prints, sizes, blocks, measure):
            if not len(x):
                continue
            starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            for a, b in zip(starts, [*starts[1:], len(x)], strict=True):
                u, vs = x[a], y[a:b]
                vs = vs[group[vs] != group[u]]  # the others are connected already
                if not len(vs):
                    continue
                own = ids[ends[u] - len(sets[u]) : ends[u]]
                marked[own] = True
                for v in vs.tolist():
                    if group[v] == group[u]:
                        continue
                    both = int(np.count_nonzero(marked[ids[ends[v] - len(sets[v]) : ends[v]]]))
                    if measure.holds(both, len(sets[u]), len(sets[v])):
                        group[group == group[v]] = group[u]
                        yield nodes[u], nodes[v]
                marked[own] = False

    def run(batches):
        out: list[tuple[int, int]] = []
        for rows in _meetings(batches, 6):
            prints = np.frombuffer(b"".join(rows[4]), dtype="<u8").reshape(-1, WORDS)
            sets = [x for part in np.array_split(rows[5], len(rows[5]) // 500 + 1) for x in shingle_sets([t.encode() for t in part], width)]
            out += links(rows[1], rows[2], rows[3], prints, sets)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array([int(r[i]) for r in out], pa.int64()) for i in (0, 1)], schema=_LINKS)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([int(r[i]) for r in out], pa.int64()) for i in (0, 1)], schema=_LINKS)

    return run


def similar_rows(docs: DataFrame, width: int = 5, similarity: float = 0.8, measure: str = "cosine", group_rows: int = 1024) -> DataFrame:
    """(ROW, component_id, kept): each row of `docs` with its group's smallest doc_id and whether it is the
    row of its group that stays: the smallest by doc_id (null last), then by the text's hash. Rows of equal id and text
    are one. See `similar_documents`."""
    like = Measure(Fraction(str(similarity)), {"cosine": True, "jaccard": False}[measure])
    docs = docs.select(*_row_key(docs), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    prints = materialize(_prefixes(docs, width, bucket_counts(docs, width), like.ratio), "prefixes")
    first = prints.groupBy("d0", "d1").agg(F.min(F.struct(*ROW)).alias("row"), *(F.first(c).alias(c) for c in ("size", "rare", "print")))
    first = materialize(first.withColumn("node", F.monotonically_increasing_id()), "sets")
    cells = first.select(F.explode("rare").alias("cell"), "node", "size").repartition("cell").sortWithinPartitions("cell", "size", "node")
    members = materialize(cells.mapInArrow(_met(like.ratio), _sql(_MET)).distinct(), "members")
    units = materialize(members.groupBy("low").agg(F.ceil(F.count(F.lit(1)) / group_rows).cast("long").alias("blocks")), "units")
    known = first.select("node", "print", "row")
    dealt = members.join(units, "low").join(known.drop("row").hint("merge"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("low", F.least("block", "other"), F.greatest("block", "other")).alias("meeting"), "node", "size", "block", "print")
    held = dealt.repartition("meeting").sortWithinPartitions("meeting", "node").mapInArrow(_with_partner(like), _sql(_HELD))
    held = materialize(held.join(known.hint("merge"), "node").select("row.*", "meeting", "node", "size", "block", "print"), "held")
    met = docs.join(held.hint("merge"), ROW).dropDuplicates([*ROW, "meeting"]).select("meeting", "node", "size", "block", "print", "text")
    roots = components(met.repartition("meeting").sortWithinPartitions("meeting", "node").mapInArrow(_verified(like, width), _sql(_LINKS)))
    rooted = materialize(first.join(roots, "node", "left").select("d0", "d1", F.coalesce("root", "node").alias("root"), "row"), "groups")
    best = materialize(rooted.groupBy("root").agg(F.min("row").alias("best")), "best")
    groups = materialize(rooted.join(best, "root").select("d0", "d1", "best"), "kept-groups")  # a set of very many rows can be split
    kept = F.struct(*ROW) == F.col("best")
    return prints.join(groups, ["d0", "d1"]).select(*ROW, F.when(~F.col("best.none"), F.col("best.id")).alias("component_id"), kept.alias("kept"))


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8, measure: str = "cosine", group_rows: int = 1024) -> DataFrame:
    """(doc_id, component_id) over links of texts whose sets of `width`-word shingles have a similarity (`measure`: cosine
    or jaccard) of at least `similarity`; component_id is the smallest doc_id of the group.

    Equal sets meet first. Similar sets have a share r of each in common (the similarity by Jaccard, its square by cosine);
    in any order of all shingles they then share one of the first n - ceil(r * n) + 1 of each; rare shingles come first, so that few texts have one in common. Texts that share one with the same
    shortest text meet as a group; one above `group_rows` is dealt into blocks, and each block meets each other one in a
    task of its own, so its size changes no result. Every link is verified on the sets; a pair at the very threshold is
    lost by its prints once in 10^8 (`reach`).

    Texts without words (null, empty, white space) are one group. Rows with a null doc_id take part and get their group's
    smallest id, or null if it has none. A doc_id that several rows carry may be in several groups. Every row gives a
    row; a text is one round of memory, so some 60 bytes for each of its bytes; an empty table gives an empty table;
    other columns are ignored.
    """
    rows = similar_rows(docs, width, similarity, measure, group_rows)
    return rows.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "component_id")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, measure: str = "cosine") -> DataFrame:
    """The rows of `docs`, all columns, without those that are near copies of another one: of each group of
    `similar_documents` the row with the smallest doc_id stays (null last, then by the text's hash), once where it
    repeats. A row is judged by its own text, also where ids clash."""
    with scratch(docs.sparkSession):
        gone = materialize(similar_rows(docs, width, similarity, measure).filter(~F.col("kept")).select(*ROW).distinct(), "near-copies", keep=True)
    rows = docs.select(*_row_key(docs), F.struct(*docs.columns).alias("row"))
    return rows.join(gone, ROW, "left_anti").dropDuplicates(ROW).select("row.*")
