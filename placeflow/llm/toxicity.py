"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeflow.llm.common import encoded, id_bucket, mix, table, text_rounds, word_hashes
from placeflow.llm.training import labelled_sample

BITS = 20
#: The bound of the fit: the sample's features come to some 50 MB in the driver.
MAX_TRAIN = 8000
_ROWS = pa.schema([("label", pa.int32()), ("features", pa.binary())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def gram_ids(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature id, index of its text), repeats included: words, pairs of neighbours and pairs with one word skipped."""
    h, owner, _ = word_hashes(texts, bare=True)
    ids, owners = [h], [owner]
    for gap, salt in ((1, 0x1B873593), (2, 0x85EBCA6B)):
        same = owner[gap:] == owner[:-gap] if len(owner) > gap else np.zeros(0, dtype=bool)
        if len(same):
            ids.append(mix(h[:-gap] * np.uint64(3) + h[gap:] + np.uint64(salt))[same])
            owners.append(owner[gap:][same])
    shift = np.uint64(64 - bits)
    return (np.concatenate(ids) >> shift).astype(np.int64), np.concatenate(owners)


def _feature_rows(batches):
    for batch in text_rounds(batches):
        texts = encoded(batch.column(1))
        ids, owner = gram_ids(texts)
        pairs = np.unique(owner * (1 << BITS) + ids)
        cut = np.searchsorted(pairs, np.arange(len(texts) + 1) << BITS)
        rows = [(pairs[a:b] & ((1 << BITS) - 1)).astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(rows, pa.binary())], schema=_ROWS)


def ftrl(rows: list[tuple[int, np.ndarray]], size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.0, epochs: int = 3, least: int = 4) -> tuple[np.ndarray, float]:
    """(weights, bias) by FTRL-proximal: a rate for each coordinate from its squared gradients, zero within `l1`.
    Coordinates enter once `least` rows have them, so that words of a single row can't carry its label."""
    seen = np.bincount(np.concatenate([x for _, x in rows]), minlength=size) if rows else np.zeros(size)
    rows = [(y, x[seen[x] >= least]) for y, x in rows]
    z, n = np.zeros(size), np.zeros(size)
    bz = bn = 0.0
    order = np.random.default_rng(7).permutation(len(rows))
    for _ in range(epochs):
        for i in order:
            label, ids = rows[i]
            zi, ni = z[ids], n[ids]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2))
            b = -bz / ((beta + np.sqrt(bn)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - label
            sigma = (np.sqrt(ni + g * g) - root) / alpha
            z[ids] = zi + g - sigma * w
            n[ids] = ni + g * g
            s = (np.sqrt(bn + g * g) - np.sqrt(bn)) / alpha
            bz, bn = bz + g - s * b, bn + g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return w, float(-bz / ((beta + np.sqrt(bn)) / alpha))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, held_out: int = 2, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray, float]:
    """(ids of the non-zero weights, the weights, bias), from at most `max_train` labelled rows; without rows nothing
    speaks for toxicity, and every score is next to 0."""
    sample = labelled_sample(docs, labels, label, modulus, held_out, max_train)
    got = sample.select("doc_id", "text", "label").mapInArrow(_feature_rows, "label int, features binary").toArrow()
    rows = sorted(zip(got["label"].to_pylist(), got["features"].to_pylist(), strict=True))
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0), -35.0
    w, bias = ftrl([(y, np.frombuffer(x, dtype="<i4")) for y, x in rows], 1 << BITS)
    ids = np.flatnonzero(w)
    return ids, w[ids], bias


class _Scorer:
    """Probabilities of texts under (ids, weights, bias); one per task."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray, float]):
        ids, weights, self.bias = model
        self.dense = np.zeros(1 << BITS)
        self.dense[ids] = weights
        self.used = self.dense != 0

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        found, owner = gram_ids(texts)
        keep = self.used[found]
        pairs = np.unique(owner[keep] * (1 << BITS) + found[keep])
        margin = np.bincount(pairs >> BITS, weights=self.dense[pairs & ((1 << BITS) - 1)], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns, that score below `threshold`."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        scorer = _Scorer(sent.value)
        for batch in text_rounds(batches):
            yield batch.filter(pa.array(scorer(encoded(batch.column(at))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, score from 0 to 1). A null or empty text gets the bias alone; every row, repeated or not, gives a row, and
    equal texts get equal scores. An empty table gives an empty table; other columns are ignored. A text beyond 2 MB is
    scored in a round of its own, in some 60 bytes of memory for each of its bytes."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the non-zero weights, at most 2**BITS

    def run(batches):
        scorer = _Scorer(sent.value)
        for batch in text_rounds(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer(encoded(batch.column(1))))], schema=_SCORED)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
