"""PII by weak supervision.

Labelers (a strict pattern, a gazetteer, the words around, validity and the neighbouring characters)
vote on candidate spans. Votes are counted per pattern of votes over the whole corpus, expectation-
maximisation estimates each labeler's reliability from those counts, and its posteriors train a
logistic span classifier whose features are the votes and the span's shape. There are at most
4 * 3**5 * 16 codes of votes and shape, so what reaches the driver is bounded by construction.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeflow.llm.common import materialize, table, text_rounds

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "validity", "edges")
LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_HIDDEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[({](?:at|AT|@)[\])}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[({](?:dot|DOT|\.)[\])}])\x20?[A-Za-z0-9-]{1,63})+")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:00[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,5}\)|[0-9]{2,5})[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9A-Za-z])")

# Gazetteers and context words.
TLDS = {"com", "org", "net", "edu", "gov", "io", "co", "info", "biz", "de", "fr", "es", "uk", "eu", "us", "ch", "at", "it", "nl", "be", "mx", "ar", "ca"}
WORDS = {
    "email": ("mail", "contact", "write", "correo", "courriel", "schreib"),
    "ip": ("ip", "host", "server", "address", "adresse", "login", "client"),
    "card": ("card", "visa", "credit", "payment", "tarjeta", "carte", "karte", "mastercard"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "llama", "appel", "anruf"),
}
AGAINST = ("version", "isbn", "issn", "order", "invoice", "serial", "token", "key", "sha", "hash", "build", "release")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the address rule, found from each @: linear in the text."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        run = text[low:at]
        start = low + len(run.rstrip(LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            low = m.end()
        else:
            low = at + 1
        at = text.find("@", max(low, at + 1))
    return out


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """(spans of each kind that pass its rule, matches that fail it)."""
    good: list[list] = [[], [], [], []]
    bad: list[list] = [[], [], [], []]
    if "@" in text:
        good[0] = emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = m[0].split(".")
            (good if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts) else bad)[1].append(m.span())
        for m in _CARD.finditer(text):
            n = m.end() - m.start()
            if n >= 12:
                digits = _only_digits(m[0])
                (good if 12 <= len(digits) <= 19 and luhn(digits) else bad)[2].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                (good if 9 <= len(_only_digits(m[0])) <= 15 else bad)[3].append(m.span())
    return good, bad


def _shape(span: str) -> int:
    digits = sum("0" <= c <= "9" for c in span)
    return min(3, len(span) // 10) * 4 + (digits * 4 // (len(span) + 1))


def _votes(kind: int, text: str, start: int, end: int, strict: bool) -> list[int]:
    """0 abstains, 1 against, 2 for; in the order of LABELERS."""
    span = text[start:end]
    digits = _only_digits(span)
    before = text[max(0, start - 40) : start].lower()
    words = re.findall(r"\w+", before)
    name = KINDS[kind]
    context = 2 if any(w in before for w in WORDS[name]) and words else 1 if any(w in AGAINST for w in words[-3:]) else 0
    if kind == 0:
        gazetteer = 2 if re.split(r"[^A-Za-z0-9]+", span.strip("])}"))[-1].lower() in TLDS else 1
        valid = 2 if len(span) <= 254 and ".." not in span else 1
    elif kind == 1:
        gazetteer = 1 if span.startswith(("0.", "1.0", "1.1", "2.0")) else 0
        valid = 2 if all(len(p) <= 3 and int(p) <= 255 for p in span.split(".")) else 1
    elif kind == 2:
        gazetteer = 2 if span[0] in "3456" else 1
        valid = 2 if 12 <= len(digits) <= 19 and luhn(digits) else 1
    else:
        gazetteer = 2 if span[0] in "+(" or digits.startswith("00") else 0
        valid = 2 if 9 <= len(digits) <= 15 else 1
    edge = (text[start - 1] if start else " ") + (text[end] if end < len(text) else " ")
    edges = 1 if any(c.isalnum() or c in "_=/" for c in edge) else 2
    return [2 if strict else 0, gazetteer, context, valid, edges]


def _code(kind: int, votes: list[int], shape: int) -> int:
    code = kind
    for v in votes:
        code = code * 3 + v
    return code * 16 + shape


def _decode(code: int) -> tuple[int, list[int], int]:
    code, shape = divmod(code, 16)
    votes = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        votes.append(v)
    return code, votes[::-1], shape


def candidates(text: str) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int, int, int]]]:
    """(base spans by kind, candidates as (kind, start, end, code), base spans among them)."""
    good, bad = base_spans(text)
    loose = [list(b) for b in bad]
    if "[" in text or "(" in text or "{" in text:
        loose[0] += [m.span() for m in _HIDDEN.finditer(text)]
    if _DIGIT.search(text):
        loose[3] += [m.span() for m in _LOCAL_PHONE.finditer(text)]
    out = []
    for kind in range(4):
        rows = [(s, e, True) for s, e in good[kind]]
        if loose[kind]:
            taken = bytearray(len(text))
            for s, e in (x for k in range(4) for x in good[k]):
                taken[s:e] = b"\1" * (e - s)
            for s, e in sorted(set(loose[kind])):
                if not any(taken[s:e]):
                    rows.append((s, e, False))
                    taken[s:e] = b"\1" * (e - s)
        out += [(kind, s, e, _code(kind, _votes(kind, text, s, e, strict), _shape(text[s:e]))) for s, e, strict in rows]
    return good, out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


_CANDIDATE = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("code", pa.int32()), ("strict", pa.bool_())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("candidates", pa.list_(_CANDIDATE))])
_SPANS = pa.schema([("doc_id", pa.int64()), ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def _find(batches):
    for batch in text_rounds(batches):
        rows = []
        for text in batch.column(1).to_pylist():
            good, found = candidates(text or "")
            base = {(k, s, e) for k in range(4) for s, e in good[k]}
            rows.append([{"kind": k, "start": s, "end": e, "code": c, "strict": (k, s, e) in base} for k, s, e, c in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _FOUND.field(1).type)], schema=_FOUND)


def find_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, candidates): every span that a strict or a loose pattern finds, with its votes. A null text is empty."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_find, "doc_id long, candidates array<struct<kind:int,start:int,end:int,code:int,strict:boolean>>")


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over distinct vote patterns: (prior, P(vote | class) as [labeler, class, vote], posterior of each pattern)."""
    n, k = votes.shape
    prior = 0.5
    table_ = np.empty((k, 2, 3))
    table_[:, 0] = (0.4, 0.4, 0.2)
    table_[:, 1] = (0.4, 0.1, 0.5)
    post = np.zeros(n)
    for _ in range(rounds):
        log = np.log([1 - prior, prior]) + np.log(table_[np.arange(k)[None, :], :, votes]).sum(axis=1)
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))
        for c, weight in ((0, counts * (1 - post)), (1, counts * post)):
            for v in range(3):
                table_[:, c, v] = ((votes == v) * weight[:, None]).sum(axis=0) + (table_[:, c, v] * 2)
            table_[:, c] /= table_[:, c].sum(axis=1, keepdims=True)
        prior = float(np.clip((counts * post).sum() / counts.sum(), 0.01, 0.99))
    return prior, table_, post


def _design(codes: list[int]) -> np.ndarray:
    x = np.zeros((len(codes), 1 + 4 + len(LABELERS) * 3 + 16))
    for i, code in enumerate(codes):
        kind, votes, shape = _decode(code)
        x[i, [0, 1 + kind, 5 + 3 * len(LABELERS) + shape]] = 1
        for j, v in enumerate(votes):
            x[i, 5 + 3 * j + v] = 1
    return x


def fit_spans(counted: list[tuple[int, int]]) -> dict[int, float]:
    """Probability of each code, from (code, count): EM per kind, then a logistic classifier on all kinds."""
    if not counted:
        return {}
    codes = [c for c, _ in counted]
    counts = np.array([n for _, n in counted], dtype=float)
    parts = [_decode(c) for c in codes]
    kinds, votes = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    target = np.zeros(len(codes))
    for kind in range(4):
        own = kinds == kind
        if own.any():
            target[own] = reliabilities(votes[own], counts[own])[2]
    x, w = _design(codes), np.zeros(5 + 3 * len(LABELERS) + 16)
    weight = counts / counts.sum()
    for _ in range(200):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-3 * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(codes, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


def _label(scores: dict[int, float], threshold: float):
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for found in batch.column(1).to_pylist():
                base = [(c["start"], c["kind"], c["end"]) for c in found if c["strict"]]
                more = [(c["start"], c["kind"], c["end"]) for c in found if not c["strict"] and scores.get(c["code"], 0.0) >= threshold]
                for k in range(4):
                    out[k].append(sum(b[1] == k for b in base))
                out[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out[5].append(_joined(base + more))
                out[6].append(len(more))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip(out, list(_SPANS)[1:], strict=True))], schema=_SPANS)

    return run


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone of the strict spans, base_sha256, spans, n_added).

    Strict spans always stay; the classifier adds candidates at `threshold` or more that overlap none
    of them. A null or empty text has no spans; each row, repeated or not, gives a row; other columns
    are ignored; an empty table gives an empty table.
    """
    found = materialize(find_candidates(docs), "pii")
    counted = found.select(F.explode("candidates.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy("code").collect()  # bounded: codes
    scores = fit_spans([(r["code"], r["n"]) for r in counted])
    return found.mapInArrow(_label(scores, threshold), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
