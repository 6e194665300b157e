"""SimHash near-duplicates over pivot distance tables.

Distances from each distinct fingerprint to fixed reference fingerprints (pivots) are tabulated,
over all bits and over blocks of bits. Two fingerprints within `radius` bits differ in at most
`radius` blocks, so in some choice of the other blocks all their block distances agree: those
distances are the join key, and no link can be missed. Within a cell, pairs are discarded by the
maximum difference of their pivot distances, survivors are verified by their exact distance, and
only a spanning star of each linked set is emitted, so a large group never emits its pairs. Cells
above `cell_rows` fingerprints are split again by the same rule on the bits that are still free,
until a cell cannot hold more fingerprints than its free bits allow.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeflow.llm.common import encoded, materialize, mix, table
from placeflow.llm.components import components

SEED = 42
#: Reference fingerprints: pseudo-random, the same everywhere.
PIVOTS = mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_CELLS = pa.schema([("cell", pa.int64()), ("held", pa.int64()), ("fp", pa.int64())])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the lower-cased word shingles, repeats included; of the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), dtype=np.int64, count=len(words)) - 1).tolist()
    k = min(width, len(words))
    stops = (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=False)], dtype="<u8")


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority bits of the shingles' hashes; 0 without words."""
    hashes = shingle_hashes(text, width)
    return int(majority(hashes[:, None])[0]) if len(hashes) else 0


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits set in over half of the rows of `hashes` (rows, 64-bit words)."""
    n, words = hashes.shape
    counts = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, n, 255 * 128):
        bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + 255 * 128]).view(np.uint8).reshape(-1, 8 * words), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255  # sums of 255 bits fit in a byte
        counts += bits[:whole].reshape(-1, 255, 64 * words).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n, bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp as a signed long). A null or empty text has fingerprint 0; every row gives a row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                prints = np.array([fingerprint(t, width) for t in encoded(part.column(1))], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], schema=_PRINTS)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, fp long")


def block_code(fps: np.ndarray, mask: int) -> np.ndarray:
    """The distances within `mask` to all pivots, as one number a fingerprint."""
    code = np.zeros(len(fps), dtype=np.uint64)
    for pivot in PIVOTS:
        code = mix(code * np.uint64(67) + np.bitwise_count((fps ^ pivot) & np.uint64(mask)).astype(np.uint64))
    return code


def split_mask(mask: int, parts: int) -> list[int]:
    """`parts` masks of neighbouring set bits of `mask`, of like size."""
    bits = [i for i in range(64) if mask >> i & 1]
    return [sum(1 << int(i) for i in part) for part in np.array_split(bits, parts)]


def _cells(blocks: int, radius: int):
    """Rows (cell, mask of the bits that agree in it, fp): one for each choice of blocks that may all agree."""

    def run(batches):
        for batch in batches:
            cell = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            held = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            fps = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for mask in np.unique(held):
                own = held == mask
                parts = split_mask(int(_FULL ^ mask), blocks)
                codes = [block_code(fps[own], p) for p in parts]
                for choice in combinations(range(blocks), blocks - radius):
                    key = mix(cell[own] + np.uint64(1 + sum(1 << c for c in choice)))
                    for c in choice:
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + codes[c])
                    now = np.full(int(own.sum()), int(mask) | sum(parts[c] for c in choice), dtype=np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, now, fps[own])], schema=_CELLS)

    return run


def link_cell(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the index of the smallest one that it is linked to, directly or over others of the cell."""
    n = len(fps)
    distances = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    root = np.full(n, -1)
    free = np.arange(n)
    while len(free):
        seed, free = free[0], free[1:]
        root[seed] = seed
        frontier = np.array([seed])
        while len(frontier) and len(free):
            hit = np.zeros(len(free), dtype=bool)
            step = max(1, 4_000_000 // (len(free) + 1))
            for at in range(0, len(frontier), step):
                part = frontier[at : at + step]
                near = np.ones((len(part), len(free)), dtype=bool)
                for j in range(distances.shape[1]):  # discard by the largest difference of pivot distances
                    near &= np.abs(distances[part, j][:, None] - distances[free, j][None, :]) <= radius
                a, b = np.nonzero(near)
                hit[b[np.bitwise_count(fps[part[a]] ^ fps[free[b]]) <= radius]] = True
            frontier, free = free[hit], free[~hit]
            root[frontier] = seed
    return root


def _links(radius: int):
    def linked(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fps = np.unique(fps)
        root = link_cell(fps, radius)
        other = root != np.arange(len(fps))
        return fps[other], fps[root[other]]

    def run(batches):
        cell, held = None, []
        for batch in batches:
            cells = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            us, vs = [], []
            cuts = np.concatenate(([0], np.flatnonzero(cells[1:] != cells[:-1]) + 1, [len(cells)]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if cells[a] != cell and held:
                    u, v = linked(np.concatenate(held))
                    us.append(u)
                    vs.append(v)
                    held = []
                cell = cells[a]
                held.append(fps[a:b])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], schema=_LINKS)
        if held:
            u, v = linked(np.concatenate(held))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, v)], schema=_LINKS)

    return run


def link_fingerprints(prints: DataFrame, radius: int = 2, blocks: int = 4, cell_rows: int = 2048) -> DataFrame:
    """Edges (u, v) between distinct fingerprints of `prints` (column fp): every two within `radius` bits are
    connected by them, and no edge joins two that are farther apart than links allow."""
    rows = prints.select(F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("held"), "fp").distinct()
    edges = None
    for level in range(4):
        shape = blocks if level == 0 else radius + 1
        cells = rows.mapInArrow(_cells(shape, radius), "cell long, held long, fp long")
        sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        cells = materialize(cells.join(sizes.hint("merge"), "cell"), "cells")  # Spark can't see how many cells there are
        last = level == 3
        small = cells if last else cells.filter(F.col("n") <= cell_rows)
        found = small.select("cell", "fp").repartition("cell").sortWithinPartitions("cell").mapInArrow(_links(radius), "u long, v long")
        edges = found if edges is None else edges.union(found)
        rows = cells.filter(F.col("n") > cell_rows).select("cell", "held", "fp")
        if last or rows.isEmpty():
            return edges
    return edges


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, blocks: int = 4) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id: the smallest doc_id reachable over links).

    Texts without words have fingerprint zero and are linked like any other. Exact copies meet in one
    fingerprint before anything is compared. Rows with a null doc_id take part and get their group's
    smallest id, or null if it has none. Every row gives a row; other columns are ignored. An empty
    table gives an empty table; a text of any length is fingerprinted in one task's memory. What is
    joined is written first, so that a fingerprint or group of very many rows can be split.
    """
    prints = materialize(fingerprints(docs, width), "prints")
    first = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "first")
    roots = components(link_fingerprints(prints, radius, blocks))
    rooted = first.join(roots, first["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    whole = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "whole")
    groups = materialize(rooted.join(whole, "root").select("fp", "component_id"), "groups")
    return prints.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
