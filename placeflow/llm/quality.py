"""Quality: naive Bayes support vectors.

Indicators of hashed character 3-grams, words and word pairs are scaled by the class log-count
ratios, and a linear hinge-loss model is fitted to them by dual coordinate descent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeflow.llm.common import encoded, id_bucket, mix, table, text_rounds, word_hashes
from placeflow.llm.training import labelled_sample

#: Half the slots are character 3-grams', half are words' and word pairs'.
BITS = 17
MAX_TRAIN = 6000
_ROWS = pa.schema([("label", pa.int32()), ("features", pa.binary())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
#: Added to a row's squared length, so that the few indicators of a short text don't outweigh the bias.
_DAMP = 100.0
#: Lengths of repeating stretches that are features of their own.
_RUNS = 12
#: Texts in a round: the round's indicator table has this many rows of 2**BITS bytes.
_ROUND_ROWS = 192


def indicators(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, feature id), each pair once, in order."""
    half = BITS - 1
    h, owner, _ = word_hashes(texts)
    seen = np.zeros((len(texts), 1 << BITS), dtype=bool)
    flat = seen.reshape(-1)
    flat[(owner << BITS) + (h >> np.uint64(64 - half)).astype(np.int64)] = True
    if len(h) > 1:
        same = owner[1:] == owner[:-1]
        pairs = mix(h[:-1] * np.uint64(3) + h[1:]) >> np.uint64(64 - half)
        flat[(owner[1:][same] << BITS) + pairs[same].astype(np.int64)] = True
    for gap in range(1, 4):  # a stretch that repeats with this period is a feature for each of its lengths, whatever its words
        same = (h[gap:] == h[:-gap]) & (owner[gap:] == owner[:-gap])
        run = same
        for length in range(_RUNS):
            if not run.any():
                break
            flat[(owner[: len(run)][run] << BITS) + (1 << half) - 1 - gap * _RUNS - length] = True
            run = run[:-1] & same[length + 1 :]
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8).astype(np.uint32)  # as written: case is a sign of quality
    if len(raw) > 2:
        grams = (((raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]) * np.uint32(2654435761)) >> np.uint32(32 - half)
        place = np.repeat(np.arange(len(texts), dtype=np.int64), sizes + 1)[: len(grams)]
        inside = np.arange(len(grams)) + 2 < offsets[place + 1] - 1
        flat[((place << BITS) + grams + (1 << half))[inside]] = True
    hits = np.flatnonzero(flat)
    return hits >> BITS, hits & ((1 << BITS) - 1)


def _rounds(batches):
    for batch in text_rounds(batches):
        for at in range(0, batch.num_rows, _ROUND_ROWS):
            yield batch.slice(at, _ROUND_ROWS)


def _feature_rows(batches):
    for batch in _rounds(batches):
        texts = encoded(batch.column(1))
        owner, ids = indicators(texts)
        cut = np.searchsorted(owner, np.arange(len(texts) + 1))
        rows = [ids[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(rows, pa.binary())], schema=_ROWS)


def log_count_ratio(rows: list[tuple[int, np.ndarray]], size: int, smooth: float = 1.0) -> np.ndarray:
    """log of the ratio of the classes' smoothed, normalised indicator counts."""
    counts = np.full((2, size), smooth)
    for label, ids in rows:
        counts[label, ids] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_descent(rows: list[tuple[int, np.ndarray]], ratio: np.ndarray, c: float = 1.0, epochs: int = 15, tolerance: float = 1e-3) -> np.ndarray:
    """Weights of the hinge-loss model over rows of damped length; the last weight is the bias's."""
    size = len(ratio)
    w = np.zeros(size + 1)
    xs = []
    for y, ids in rows:
        v = ratio[ids]
        xs.append((1 if y else -1, np.append(ids, size), np.append(v / np.sqrt((v * v).sum() + _DAMP), 1.0)))
    alpha = np.zeros(len(xs))
    square = [float((v * v).sum()) for _, _, v in xs]
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(xs)):
            y, ids, v = xs[i]
            g = y * float(w[ids] @ v) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), c)
            if new != alpha[i]:
                w[ids] += (new - alpha[i]) * y * v
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < tolerance:
            break
    return w


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, with smoothed targets, by Newton steps."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    x = np.column_stack([margins, np.ones(len(margins))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target) + 1e-6 * np.array([a, b]))
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-9:
            break
    return a, b


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held_out: int = 1, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """(log-count ratios, weights, bias, slope, offset), from at most `max_train` labelled rows.
    With rows of one class only, every score is that class's smoothed share; with none it is 0.5."""
    sample = labelled_sample(docs, labels, label, modulus, held_out, max_train)
    got = sample.select("doc_id", "text", "label").mapInArrow(_feature_rows, "label int, features binary").toArrow()
    rows = [(int(y > 0), np.frombuffer(x, dtype="<i4")) for y, x in sorted(zip(got["label"].to_pylist(), got["features"].to_pylist(), strict=True))]
    zero = np.zeros(1 << BITS)
    ones = sum(y for y, _ in rows)
    if ones in (0, len(rows)):
        share = (ones + 1) / (len(rows) + 2)
        return zero, zero, 0.0, 0.0, float(np.log(share / (1 - share)))
    ratio = log_count_ratio(rows, 1 << BITS)
    # Margins that calibrate come from rows that their fold's weights have not seen.
    margins = np.zeros(len(rows))
    folds = np.arange(len(rows)) % 3
    for k in range(3):
        own = [r for r, f in zip(rows, folds, strict=True) if f != k]
        r = log_count_ratio(own, 1 << BITS)
        w = dual_descent(own, r, epochs=6)
        for i in np.flatnonzero(folds == k):
            margins[i] = _margin(rows[i][1], r, w)
    w = dual_descent(rows, ratio)
    slope, offset = platt(margins, np.array([y for y, _ in rows]))
    return ratio, w[:-1], float(w[-1]), slope, offset


def _margin(ids: np.ndarray, ratio: np.ndarray, w: np.ndarray) -> float:
    v = ratio[ids]
    return float(w[ids] @ v) / float(np.sqrt((v * v).sum() + _DAMP)) + float(w[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float, float, float]) -> DataFrame:
    """(doc_id, score from 0 to 1). A null or empty text has no indicators and gets the bias; every row, repeated or not,
    gives a row, and equal texts get equal scores. An empty table gives an empty table; other columns are ignored. A text
    beyond 2 MB is scored in a round of its own, in some 60 bytes of memory for each of its bytes."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS slots, whatever the input

    def run(batches):
        ratio, w, bias, slope, offset = sent.value
        scaled, squared = ratio * w, ratio * ratio
        for batch in _rounds(batches):
            texts = encoded(batch.column(1))
            owner, ids = indicators(texts)
            norm = np.sqrt(np.bincount(owner, weights=squared[ids], minlength=len(texts)) + _DAMP)
            margin = np.bincount(owner, weights=scaled[ids], minlength=len(texts)) / norm + bias
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(slope * margin + offset, -35, 35))))], schema=_SCORED)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
