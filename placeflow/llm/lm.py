"""Language-model scores: a unigram base and context-tree weighting.

Context-tree weighting: each byte is eight binary decisions; every node (the last d bytes, the
decisions so far) has Krichevsky-Trofimov counts, and a node's probability is half its own estimate
and half the product of its children's, mixed over all depths 0 to `depth`. The counts are summed
by Spark; the trees are weighted bottom-up in partitions by the two most recent bytes, which hold
whole subtrees; the few nodes above join them. The result is one log-probability for each distinct (context, byte)
of the corpus, so scoring a text is a sum of look-ups.

The unigram base needs the count of every word. Words of a bounded list of frequent ones are
counted apart and looked up where the texts are read; all others travel as (word hash, document,
count) blocks to their hash's partition, which counts them and returns blocks of sums by document.
Both kinds of blocks hold at most an entry for each (document, word) pair of the texts. Which words are in the list never changes a result, only the path a count takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeflow.llm.common import encoded, id_bucket, materialize, mix, shuffle_partitions, table, text_rounds, word_hashes

DEPTH = 4
#: Words in the frequent list at most, and documents (about) that are looked at to choose them.
FREQUENT, LOOKED_AT = 1 << 16, 2000
#: The most frequent (context, byte) pairs, whose log-probabilities are broadcast (16 bytes each and room); others are joined.
MOST_CODES = 4_000_000
#: Pairs, and bytes of text, that a partition is to hold, about: the more there are, the more partitions.
CODES_EACH, BYTES_EACH = 1_000_000, 64_000_000
_COUNTS = pa.schema([("code", pa.int64()), ("n", pa.int64())])
_BLOCKS = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary())])
_PARTS = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("known", pa.binary()), ("sums", pa.binary()), ("distinct", pa.int64())])
_SUMS = pa.schema([("kind", pa.int32()), ("row", pa.int64()), ("n_known", pa.int64()), ("sum_log", pa.float64())])
_TREES = pa.schema([("kind", pa.int32()), ("code", pa.int64()), ("v", pa.list_(pa.float64()))])
_SCORES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("sum_log", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])
_PAIRS = pa.schema([("row", pa.int64()), ("code", pa.int64()), ("n", pa.int64())])


def with_training(docs: DataFrame, modulus: int = 5, held_out: int = 1) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (id_bucket(F.col("doc_id"), modulus) != held_out).alias("train")).withColumn("row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))


# Context-tree weighting


def codes_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """((the last `depth` bytes, the byte) as one number, where each text's numbers begin). A text is its lower-cased
    bytes and an end byte 0; before it stand `depth` bytes 0."""
    gap = b"\0" * max(depth, 1)
    data = np.frombuffer(gap + gap.join(texts).lower() + gap, dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = len(gap) + np.concatenate(([0], np.cumsum(sizes[:-1] + len(gap)))).astype(np.int64)
    coded = np.ones(len(data) + 1, dtype=np.int8)
    coded[: len(gap)] = 0
    if len(gap) > 1:
        for k in range(1, len(gap)):
            coded[starts + sizes + k] = 0
    code = data.astype(np.uint64)
    for d in range(1, depth + 1):
        code[d:] |= data[:-d].astype(np.uint64) << np.uint64(8 * d)
    return code[coded[:-1] == 1].view(np.int64), np.concatenate(([0], np.cumsum(sizes + 1)))


class _Tally:
    """Counts by number, merged as they grow."""

    def __init__(self):
        self.keys, self.sums, self.more = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.more.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > max(500_000, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        if self.more:
            keys, place = np.unique(np.concatenate([self.keys, *(k for k, _ in self.more)]), return_inverse=True)
            self.sums = np.bincount(place, weights=np.concatenate([self.sums, *(c for _, c in self.more)]), minlength=len(keys)).astype(np.int64)
            self.keys, self.more, self.waiting = keys, [], 0

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        self.merge()
        for at in range(0, len(self.keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(self.keys[at : at + 50_000]), pa.array(self.sums[at : at + 50_000])], schema=schema)


def _count_codes(depth: int):
    def run(batches):
        tally = _Tally()
        for batch in text_rounds(batches):
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            texts = encoded(batch.column(1))
            for learn in (True, False):
                own = [t for t, x in zip(texts, train, strict=True) if x == learn]
                if own:
                    keys, counts = np.unique(codes_of(own, depth)[0], return_counts=True)
                    tally.add(keys, counts if learn else np.zeros_like(counts))
            if len(tally.keys) > 2_000_000:
                yield from tally.batches(_COUNTS)
                tally = _Tally()
        yield from tally.batches(_COUNTS)

    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function, by Stirling's series after a shift by eight."""
    shift = np.log(x)
    for i in range(1, 8):
        shift = shift + np.log(x + i)
    y = x + 8.0
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


_LOG_GAMMA_HALF = 0.5723649429247001


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - 2 * _LOG_GAMMA_HALF


def _weighted(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, below) + np.log(0.5)


def subtree(codes: np.ndarray, counts: np.ndarray, depth: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """For all codes of some choices of the `floor` most recent bytes: (their eight decisions' probabilities as mixed over depths
    `floor` to `depth`, rows (parent, zeros, ones, log of the weighted probability) of the nodes at depth `floor`)."""
    byte = codes & 255
    context = codes >> 8
    mixed = np.zeros((len(codes), 8))
    top = []
    for k in range(8):
        so_far = (1 << k) | (byte >> (8 - k))
        bit = (byte >> (7 - k)) & 1
        below, below_parent, p = None, None, None
        for d in range(depth, floor - 1, -1):
            keys, place = np.unique((context & ((1 << 8 * d) - 1)) * 256 + so_far, return_inverse=True)
            ones = np.bincount(place, weights=counts * bit, minlength=len(keys))
            zeros = np.bincount(place, weights=counts * (1 - bit), minlength=len(keys))
            own = log_kt(zeros, ones)
            estimate = (np.where(bit == 1, ones[place], zeros[place]) + 0.5) / (zeros[place] + ones[place] + 1)
            if d == depth:
                weighted, p = own, estimate
            else:
                children = np.bincount(np.searchsorted(keys, below_parent), weights=below, minlength=len(keys))
                weighted = _weighted(own, children)
                share = np.exp(own + np.log(0.5) - weighted)[place]
                p = share * estimate + (1 - share) * p
            below, below_parent = weighted, _parent(keys, d)
        mixed[:, k] = p
        top += list(zip(below_parent.tolist(), zeros.tolist(), ones.tolist(), weighted.tolist(), strict=True))
    return mixed, np.array(top)


def _parent(keys: np.ndarray, depth: int) -> np.ndarray:
    """The node without its oldest byte, of a node at `depth`."""
    return ((keys >> 8) & ((1 << 8 * (depth - 1)) - 1)) * 256 + (keys & 255)


def code_scores(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(code, log10 of its byte's probability after its context) for every code of `counts` (code, n).

    Codes of the same two recent bytes are weighted together: at most 2 ** 24 of them, at depth 4."""
    floor = min(2, depth)
    parts = max(shuffle_partitions(counts.sparkSession), counts.count() // CODES_EACH)

    def grow(batches):
        """All subtrees of a partition at once: their nodes differ in the most recent bytes, so none is shared."""
        parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if parts:
            codes, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            mixed, top = subtree(codes, n.astype(float), depth, floor)
            kind = np.concatenate([np.zeros(len(codes), dtype=np.int32), np.ones(len(top), dtype=np.int32)])
            key = np.concatenate([codes, top[:, 0].astype(np.int64)])
            ends = np.concatenate([np.arange(0, 8 * len(codes) + 1, 8), 8 * len(codes) + 3 * np.arange(1, len(top) + 1)])
            values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([mixed.reshape(-1), top[:, 1:].reshape(-1)])))
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), values], schema=_TREES)

    recent = F.shiftright("code", 8).bitwiseAND((1 << 8 * floor) - 1)
    dealt = counts.select("code", "n").repartition(parts, recent)
    grown = materialize(dealt.mapInArrow(grow, "kind int, code long, v array<double>"), "trees")
    nodes = grown.filter("kind = 1").groupBy("code").agg(*(F.sum(F.col("v")[i]).alias(c) for i, c in enumerate(("zeros", "ones", "below")))).toArrow()
    # At most 256 * 255 nodes of one recent byte, or 255 of none: the levels above the groups.
    keys, zeros, ones, below = (nodes[c].to_numpy() for c in ("code", "zeros", "ones", "below"))
    levels = []
    for d in range(floor - 1, -1, -1):
        own = log_kt(zeros, ones)
        weighted = _weighted(own, below)
        share, estimate = np.zeros(1 << 8 * (d + 1)), np.full((1 << 8 * (d + 1), 2), 0.5)
        share[keys] = np.exp(own + np.log(0.5) - weighted)
        estimate[keys] = np.stack([zeros, ones], axis=1) + 0.5
        estimate[keys] /= estimate[keys].sum(axis=1, keepdims=True)
        levels.append((d, share, estimate))
        keys, place = np.unique(_parent(keys, d) if d else keys, return_inverse=True)
        zeros, ones, below = (np.bincount(place, weights=x, minlength=len(keys)) for x in (zeros, ones, weighted))

    def finish(batches):
        for batch in batches:
            codes = batch.column(0).to_numpy(zero_copy_only=False)
            mixed = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 8)
            total = np.zeros(len(codes))
            for k in range(8):
                p = mixed[:, k]
                for d, share, estimate in levels:
                    node = ((codes >> 8) & ((1 << 8 * d) - 1)) * 256 + ((1 << k) | ((codes & 255) >> (8 - k)))
                    p = share[node] * estimate[node, (codes >> (7 - k)) & 1] + (1 - share[node]) * p
                total += np.log10(p)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(total)], names=["code", "logp"])

    return grown.filter("kind = 0").select("code", "v").mapInArrow(finish, "code long, logp double")


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def lookup_table(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(slots' codes, slots' values, bits, codes and values that found their slot taken, sorted)."""
    bits = max(4, int(np.ceil(np.log2(2 * len(codes) + 1))))  # 32 to 64 bytes a code
    slot = (codes.view(np.uint64) * _SPREAD) >> np.uint64(64 - bits)
    _, first = np.unique(slot, return_index=True)
    at, held = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits)
    at[slot[first]], held[slot[first]] = codes[first], values[first]
    rest = np.ones(len(codes), dtype=bool)
    rest[first] = False
    order = np.argsort(codes[rest])
    return at, held, np.array(bits), codes[rest][order], values[rest][order]


def look_up(tables: tuple[np.ndarray, ...], codes: np.ndarray) -> np.ndarray:
    at, held, bits, more, more_values = tables
    slot = (codes.view(np.uint64) * _SPREAD) >> np.uint64(64 - int(bits))
    found = held[slot]
    miss = np.flatnonzero(at[slot] != codes)
    place = np.minimum(np.searchsorted(more, codes[miss]), max(0, len(more) - 1))
    found[miss] = np.where(more[place] == codes[miss], more_values[place], np.nan) if len(more) else np.nan
    return found


# The unigram base


def frequent_words(docs: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of at most FREQUENT words that are common in some LOOKED_AT of the `n` documents; a choice of path only."""
    if not n:
        return np.zeros(0, dtype=np.uint64)
    share = min(1_000_000, max(1, 1_000_000 * LOOKED_AT // n))

    def run(batches):
        tally = _Tally()
        for batch in text_rounds(batches):
            keys, counts = np.unique(word_hashes(encoded(batch.column(0)))[0].view(np.int64), return_counts=True)
            tally.add(keys, counts)
        yield from tally.batches(_COUNTS)

    seen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).select("text").mapInArrow(run, "code long, n long")
    top = seen.groupBy("code").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "code").limit(FREQUENT).collect()
    return np.sort(np.array([r["code"] for r in top], dtype=np.int64).view(np.uint64))


def _in_list(words: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(words):
        return np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
    place = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return place, words[place] == h


def frequent_counts(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """Training counts of the listed words, in their order."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        counts = np.zeros(len(sent.value), dtype=np.int64)
        for batch in text_rounds(batches):
            place, known = _in_list(sent.value, word_hashes(encoded(batch.column(0)))[0])
            counts += np.bincount(place[known], minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], schema=_COUNTS)

    summed = docs.filter("train").select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()  # at most FREQUENT rows
    out = np.zeros(len(words), dtype=np.int64)
    for r in summed:
        out[r["code"]] = r["n"]
    return out


def rare_sums(docs: DataFrame, words: np.ndarray, targets: int) -> DataFrame:
    """Of the words outside the list: rows (0, row, tokens with a count, sum of log10(count + 0.5)), and rows
    (1, null, distinct training words, 0), both to be summed. `targets` partitions count them."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(words)
    bits = max(4, (4 * targets - 1).bit_length())

    def send(batches):
        held: list[tuple] = []
        size = 0

        def blocks():
            h, doc, count = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, doc, count = h[order], doc[order], count[order]
            bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(h)])) if len(h) else [0]
            pairs = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in pairs], pa.int32()), *(pa.array([x[a:b].tobytes() for a, b in pairs], pa.binary()) for x in (h, doc, count))], schema=_BLOCKS)

        for batch in text_rounds(batches):
            ids = batch.column(0).to_numpy()
            sign = np.where(batch.column(2).to_numpy(zero_copy_only=False).astype(bool), 1, -1)
            h, owner, _ = word_hashes(encoded(batch.column(1)))
            rare = ~_in_list(sent.value, h)[1]
            h, owner = h[rare], owner[rare]
            if len(h):
                order = np.argsort(h, kind="stable")
                h, owner = h[order], owner[order]
                new = np.concatenate(([0], np.flatnonzero((h[1:] != h[:-1]) | (owner[1:] != owner[:-1])) + 1))
                count = np.diff(np.concatenate((new, [len(h)]))) * sign[owner[new]]
                held.append((h[new], ids[owner[new]], count.astype(np.int32)))
                size += len(new)
                if size > 1_500_000:
                    yield from blocks()
                    held, size = [], 0
        if held:
            yield from blocks()

    def settle(batches):
        parts = [(np.frombuffer(w, dtype=np.uint64), np.frombuffer(d, dtype=np.int64), np.frombuffer(c, dtype=np.int32)) for batch in batches for w, d, c in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
        if not parts:
            return
        h, doc, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        keys, place = np.unique(h, return_inverse=True)
        known = np.bincount(place, weights=np.maximum(count, 0), minlength=len(keys))
        logs, often = np.log10(known + 0.5)[place], np.abs(count)
        docs_, at = np.unique(doc, return_inverse=True)
        n_known = np.bincount(at, weights=often * (known[place] > 0)).astype(np.int64)
        sums = np.bincount(at, weights=often * logs)
        bucket = (mix(docs_.view(np.uint64)) % np.uint64(targets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(targets + 1))
        pairs = [(t, order[a:b]) for t, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in pairs], pa.int32()), *(pa.array([x[o].tobytes() for _, o in pairs], pa.binary()) for x in (docs_, n_known, sums)), pa.array([int((known > 0).sum())] + [0] * (len(pairs) - 1), pa.int64())], schema=_PARTS)

    def join(batches):
        parts, distinct = [], 0
        for batch in batches:
            distinct += pc.sum(batch.column(4)).as_py() or 0
            parts += [tuple(np.frombuffer(x, dtype=k) for x, k in zip(row, (np.int64, np.int64, np.float64), strict=True)) for row in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
        if parts:
            doc, known, total = (np.concatenate(x) for x in zip(*parts, strict=True))
            docs_, at = np.unique(doc, return_inverse=True)
            n = len(docs_)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], [n, 1]), pa.int32()), pa.array([*docs_.tolist(), None], pa.int64()), pa.array([*np.bincount(at, weights=known).astype(np.int64).tolist(), distinct], pa.int64()), pa.array([*np.bincount(at, weights=total).tolist(), 0.0], pa.float64())], schema=_SUMS)

    sent_blocks = docs.select("row", "text", "train").mapInArrow(send, "bucket int, words binary, docs binary, counts binary")
    settled = sent_blocks.repartition(targets, "bucket").mapInArrow(settle, "bucket int, docs binary, known binary, sums binary, distinct long")
    return settled.repartition(targets, "bucket").mapInArrow(join, "kind int, row long, n_known long, sum_log double")


# Both


def _rare_pairs(depth: int, tables):
    """(row, code, how often) of the codes that the broadcast tables lack."""

    def run(batches):
        for batch in text_rounds(batches, most=200_000):
            for doc, text in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True):
                codes = codes_of([text], depth)[0]
                keys, counts = np.unique(codes[np.isnan(look_up(tables.value[2], codes))], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(keys), pa.int64()), pa.array(keys), pa.array(counts)], schema=_PAIRS)

    return run


def score(docs: DataFrame, modulus: int = 5, held_out: int = 1, depth: int = DEPTH, most_codes: int = MOST_CODES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), logarithms to base 10.

    bits_per_byte is the code length of a text's bytes and its end byte, a byte.

    Learns from the rows outside the held-out remainder. A null or empty text is one end token. Every row
    gives a row, scored by its own text, also where ids are missing or clash (rows are told apart by a 64-bit hash of id and text). Without training rows every count is zero and
    every decision has probability one half. An empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = with_training(docs, modulus, held_out)
    n_docs, n_bytes = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    words = frequent_words(docs, n_docs)
    counts = frequent_counts(docs, words)
    rare = materialize(rare_sums(docs, words, max(shuffle_partitions(spark), n_bytes // BYTES_EACH)), "rare")
    codes = docs.mapInArrow(_count_codes(depth), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    codes = materialize(codes, "code-counts")
    scored_codes = materialize(code_scores(codes, depth), "codes")
    small = scored_codes.count() <= most_codes
    listed = scored_codes if small else scored_codes.join(codes.orderBy(F.desc("n"), "code").limit(most_codes).select("code"), "code", "left_semi")
    got = listed.toArrow()  # bounded by most_codes
    tables = lookup_table(np.ascontiguousarray(got["code"].to_numpy()), np.ascontiguousarray(got["logp"].to_numpy()))
    sent = spark.sparkContext.broadcast((words, counts, tables))

    def run(batches):
        words, counts, tables = sent.value
        logs = np.log10(counts + 0.5)
        for batch in text_rounds(batches):
            texts = encoded(batch.column(2))
            h, owner, _ = word_hashes(texts)
            place, listed = _in_list(words, h)
            at, own = place[listed], owner[listed]
            n = len(texts)
            keys, cuts = codes_of(texts, depth)
            total = np.add.reduceat(np.nan_to_num(look_up(tables, keys), nan=0.0), cuts[:-1])
            known = np.bincount(own, weights=counts[at] > 0, minlength=n) if len(at) else np.zeros(n)
            sums = np.bincount(own, weights=logs[at], minlength=n) if len(at) else np.zeros(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.bincount(owner, minlength=n) + 1), pa.array(known.astype(np.int64)), pa.array(sums), pa.array(total), pa.array(map(len, texts), pa.int64())], schema=_SCORES)

    scored = materialize(docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, n_tokens long, n_known long, sum_log double, score double, n_bytes long"), "scored")
    trained = id_bucket(F.col("doc_id"), modulus) != held_out
    tokens, texts = scored.filter(trained).agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count(F.lit(1))).first()
    distinct = int((counts > 0).sum()) + (rare.filter("kind = 1").agg(F.sum("n_known")).first()[0] or 0) + (texts > 0)
    rest = rare.filter("kind = 0").select("row", "n_known", "sum_log", F.lit(0.0).alias("score"))
    if not small:
        pairs = docs.select("row", "text").mapInArrow(_rare_pairs(depth, sent), "row long, code long, n long").join(scored_codes, "code")
        rest = rest.unionByName(pairs.groupBy("row").agg(F.sum(F.col("n") * F.col("logp")).alias("score")).select("row", F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("sum_log"), "score"))
    # Rows of one id and text were summed together: each has its share.
    alike = scored.groupBy("row").agg(F.count(F.lit(1)).alias("m"))
    rest = rest.groupBy("row").agg(*(F.sum(c).alias(f"more_{c}") for c in ("n_known", "sum_log", "score"))).join(alike, "row")
    rest = materialize(rest, "rare-by-row")
    rows = scored.join(rest, "row", "left")
    known, logs, total = (F.col(c) + F.coalesce(F.col(f"more_{c}") / F.col("m"), F.lit(0.0)) for c in ("n_known", "sum_log", "score"))
    end = float(np.log10(texts + 0.5))
    return rows.select(
        "doc_id", (~trained).alias("held_out"), "n_tokens",
        (F.round(known).cast("long") + int(texts > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (logs + F.lit(end) - F.col("n_tokens") * F.lit(float(np.log10(tokens + 0.5 * (distinct + 1))))).alias("base_score"),
        total.alias("score"),
        (-total / F.lit(float(np.log10(2))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
