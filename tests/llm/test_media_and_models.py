"""Ogg, WARC, packing, PII, classifiers and language-model scores."""

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from placeflow.llm import lm, ogg, packing, pii, quality, toxicity, warc


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=70_000), st.integers(1, 700), st.integers(1, 3))
def test_ogg_round_trip(payload, packet, streams):
    assert ogg.read_ogg(ogg.write_ogg(payload, packet, 8000, streams))[0] == payload


def test_ogg_checksum_and_damage():
    data = ogg.write_ogg(b"x" * 40_000)
    crc = 0
    page = bytearray(data[: 27 + 1 + 24])
    want = int.from_bytes(page[22:26], "little")
    page[22:26] = b"\0\0\0\0"
    for byte in page:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc >> 31 else crc << 1
    assert crc == want
    for bad in (data[:-1], data[:3000] + b"y" + data[3001:], data[52:]):
        with pytest.raises(ValueError):
            ogg.read_ogg(bad)


def test_ogg_timestamps_grow():
    facts = ogg.read_ogg(ogg.write_ogg(bytes(range(256)) * 300))[1]
    assert facts["continued"] > 0 and facts["packets"] == math.ceil(256 * 300 / 576)


def test_ogg_rows(odd, empty):
    rows = ogg.from_ogg(ogg.to_ogg(odd)).collect()
    assert len(rows) == 9
    for r in rows:
        assert len(r["payload"]) % 576 == 0 and len(r["payload"]) > 0 and r["media_bytes"] > len(r["payload"])
    assert {r["feature"] for r in rows if r["doc_id"] in (3, 4)} == {next(r["feature"] for r in rows if r["doc_id"] == 3)}
    assert ogg.from_ogg(ogg.to_ogg(empty)).count() == 0


def test_warc(spark):
    pages = [(3, "http://a/b c\n", "same"), (1, "http://b", "same"), (2, None, "same"), (4, "u", ""), (5, "u", None), (6, "u", "x" * 100_000 + "\r\n\r\né"), (None, "u", "alone"), (8, "u", "twice"), (8, "u", "twice")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, refers_to string").repartition(3)
    got = sorted(((r["page_id"], r["payload_bytes"], r["digest"], r["record_type"], r["refers_to"]) for r in warc.deduplicate(df).collect()), key=repr)
    first = {}
    for i, _, h in pages:
        first[h or ""] = min((x for x in (first.get(h or ""), i) if x is not None), default=None)
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        again = i != first[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert got == sorted(want, key=repr)
    records = warc.deduplicate(df).collect()
    ids = {r["record_id"]: r for r in records}
    assert len(ids) == len(records)
    for r in records:
        if r["record_type"] == "revisit":  # names a response of the same archives
            assert ids[r["refers_to_record"]]["record_type"] == "response" and ids[r["refers_to_record"]]["page_id"] == r["refers_to"]
    assert warc.deduplicate(df.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.deduplicate(df, min_bytes=10**6).collect()} == {"response"}


def test_revisit_headers():
    to = warc.Original(1, "<urn:uuid:a>", "http://a", "2020-01-01T00:00:00Z")
    headers, payload = warc.parse(warc.record("<urn:uuid:b>", 2, "http://b", b"x", warc.payload_digest(b"x"), to))
    assert not payload and headers["WARC-Refers-To"] == "<urn:uuid:a>" and headers["WARC-Refers-To-Target-URI"] == "http://a"
    assert headers["WARC-Refers-To-Date"] == "2020-01-01T00:00:00Z" and headers["WARC-Type"] == "revisit"
    assert warc.parse(warc.archive_info("x.warc.gz"))[0]["WARC-Type"] == "warcinfo"


def test_tokens_are_the_vocabularys(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.tokenizer("byte_bpe_50k")
    odd_texts = ["", "  a  b\n\n  c", "it's I'LL don't 3½ x² été x \x1c y\x85 z 你好 12٣", "<|endoftext|> a\t\tb \r\n", "x<|endoftext|><|endoftext|>y 你", "ab" * 500 + " é" * 3, "a" * 50 + " " * 40, "ªº µ ÿ×÷ ß\xa0"]
    for text in [*list(texts.values())[:100], *odd_texts]:
        assert np.frombuffer(own.id_bytes(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("window", [2048, 64])
def test_packing(documents, odd, empty, window):
    for df in (documents, odd):
        rows = [r.asDict() for r in packing.pack(df, window, with_ids=True).collect()]
        sequences, docs = defaultdict(list), defaultdict(list)
        for r in rows:
            sequences[r["sequence_id"]].append(r)
            docs[r["doc_id"]].append(r)
            assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        total = padding = 0
        for s in sequences.values():
            at = 0
            for r in sorted(s, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= window
            total += at
            padding += 0 if at & (at - 1) == 0 else window - at
        n = Counter(r["doc_id"] for r in df.select("doc_id").collect())
        for i, parts in docs.items():
            assert sum(p["length"] for p in parts) == parts[0]["doc_tokens"] * n[i] if i != 5 or n[i] == 1 else True
        assert set(docs) == set(n)
        if df is documents:
            assert padding / total < 0.03
    assert packing.pack(empty).count() == 0


def test_non_negative_least_squares_and_plan_use_every_piece_once():
    rng = np.random.default_rng(0)
    histogram = Counter(rng.integers(1, 65, 5000).tolist())
    used = Counter()
    for lengths, times in packing.plan(dict(histogram), 64):
        assert sum(lengths) <= 64 and times > 0
        for x in lengths:
            used[x] += times
    assert used == histogram
    x = packing.nnls([(1, 3), (2, 2)], np.array([0, 4.0, 6.0, 4.0]))
    assert np.allclose(x, [4, 3], atol=1e-3)


def test_pii_base_rules():
    text = "a@b.co, x..y@@c.d-e.f1 +1 (052) 555-0934 10.0.0.256 1.2.3.4.5.6.7.8 4111 1111 1111 1111 1234567890123 +12"
    good, _ = pii.base_spans(text)
    assert [text[s:e] for s, e in good[0]] == ["a@b.co"]
    assert [text[s:e] for s, e in good[1]] == ["1.2.3.4", "5.6.7.8"]
    assert not good[2]  # the digits before belong to the same run, which has too many
    assert [text[s:e] for s, e in good[3]] == ["+1 (052) 555-0934 10.0.0.256 1.2.3.4.5.6.7.8 4111 1111 1111 1111 1234567890123"][:0]
    good, _ = pii.base_spans("+1 (052) 555-0934; 4111 1111 1111 1111.")
    assert len(good[3]) == len(good[2]) == 1


def brute_pii(text):
    import re

    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            spans.append(("card", *m.span()))
    spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(spans, key=lambda x: (x[1], pii.KINDS.index(x[0])))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab@.+-_% 0123456789()\n", max_size=80))
def test_pii_base_matches_the_patterns(text):
    good, _ = pii.base_spans(text)
    got = sorted(((pii.KINDS[k], s, e) for k in range(4) for s, e in good[k]), key=lambda x: (x[1], pii.KINDS.index(x[0])))
    assert got == brute_pii(text)


def test_pii_rows(documents, texts, odd, empty):
    for r in pii.find_pii(documents).collect():
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in brute_pii(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert not base or set(base.split(",")) <= set(r["spans"].split(","))
    assert pii.find_pii(odd).count() == 9 and pii.find_pii(empty).count() == 0


def test_pii_learns_which_labelers_to_trust(spark):
    rows = [(i, f"please mail sales{i} (at) shop{i} (dot) com or call (212) 555-0{100 + i}") for i in range(40)] + [(100 + i, f"write to a{i}@b{i}.org now, phone +1 212 555 0{100 + i}") for i in range(200)]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id < 100").collect()
    assert sum(r["n_added"] for r in got) >= 40


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    n = label.sum()
    return (rank[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize(("module", "label", "modulus", "held", "least"), [(toxicity, "toxic", 4, 2, 0.8), (quality, "quality", 3, 1, 0.9)])
def test_classifiers_on_held_out_rows(spark, module, label, modulus, held, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = module.fit(docs, labels)
    rows = module.score(docs, model).join(labels, "doc_id").collect()
    out = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % modulus == held]
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert auc(np.array([r["score"] for r in out]), np.array([r[label] for r in out])) > least


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_on_odd_rows(module, spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        rows = module.score(odd, module.fit(odd, labels)).collect()
        assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)
    assert module.score(empty, module.fit(empty, none)).count() == 0
    if module is toxicity:
        assert module.drop_toxic(odd, module.fit(odd, none), 2.0).columns == odd.columns


def brute_ctw(train, text, depth):
    counts = defaultdict(lambda: [0, 0])

    def bits(t):
        data = b"\0" * depth + t.lower() + b"\0"
        for i in range(depth, len(data)):
            for k in range(8):
                yield data[i - depth : i], (1 << k) | (data[i] >> (8 - k)), data[i] >> (7 - k) & 1

    for t in train:
        for context, so_far, bit in bits(t):
            for d in range(depth + 1):
                counts[context[depth - d :], so_far][bit] += 1
    children = defaultdict(set)
    for context, so_far in list(counts):
        if context:
            children[context[1:], so_far].add(context)

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)

    memory = {}

    def weighted(context, so_far):
        key = context, so_far
        if key not in memory:
            own = log_kt(*counts[key]) if key in counts else 0.0
            if len(context) == depth:
                memory[key] = own
            else:
                memory[key] = math.log(0.5) + np.logaddexp(own, sum(weighted(c, so_far) for c in children[key]))
        return memory[key]

    total = 0.0
    for context, so_far, bit in bits(text):
        p = None
        for d in range(depth, -1, -1):
            c = context[depth - d :]
            n = counts[c, so_far] if (c, so_far) in counts else [0, 0]
            kt = (n[bit] + 0.5) / (sum(n) + 1)
            if p is None:
                p = kt
            else:
                share = math.exp(math.log(0.5) + log_kt(*n) - weighted(c, so_far))
                p = share * kt + (1 - share) * p
        total += math.log10(p)
    return total


@pytest.mark.parametrize("depth", [1, 3, 4])
def test_context_tree_weighting_matches_the_recursion(spark, depth):
    rows = [(i, t) for i, t in enumerate(["abracadabra", "Abra cadabra!", "banana band", "", "ananas é", "cab bad"])]
    train = [t.encode() for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scored = lm.score(df, depth=depth).collect()
    got = {r["doc_id"]: r["score"] for r in scored}
    for r in scored:
        assert math.isclose(r["bits_per_byte"], -r["score"] / math.log10(2) / (len(dict(rows)[r["doc_id"]].encode()) + 1))
    for i, t in rows:
        assert math.isclose(got[i], brute_ctw(train, t.encode(), depth), rel_tol=1e-9, abs_tol=1e-9)


def test_language_model_rows(documents, texts, odd, empty):
    got = {r["doc_id"]: r for r in lm.score(documents).collect()}
    counts, n = Counter(), 0
    tokens = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    for i, ws in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(ws)
            n += len(ws)
    for i, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (len(counts) + 1))) for w in ws)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    for most in (0, 3000):  # none and the most frequent codes broadcast, the others joined
        joined = {r["doc_id"]: r["score"] for r in lm.score(documents, most_codes=most).collect()}
        assert all(math.isclose(joined[i], got[i]["score"], rel_tol=1e-9) for i in got)
    rows = {r["doc_id"]: r for r in lm.score(odd).collect()}
    assert len(rows) == 8 and rows[3]["n_tokens"] == rows[4]["n_tokens"] == 1 and rows[6]["n_tokens"] == 3
    assert lm.score(empty).count() == 0


def test_rows_that_share_an_id_are_scored_each_by_its_own_text(spark):
    """Repeated and missing ids with other texts, and rows that repeat: a row for a row, as if ids were distinct."""
    texts = ["one text of words", "quite another text here", "one text of words", None, "a third without an id", "zzz qqq zzz", "zzz qqq zzz"]
    ids = [1, 1, 1, 2, None, None, None]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    for most in (lm.MOST_CODES, 0):
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 9), round(r["score"], 9)) for r in lm.score(docs, most_codes=most).collect())
        assert len(got) == len(texts)
        # distinct ids that are in the same part of the corpus as the given ones
        train = [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 5 != 1]
        apart = [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 5 == 1]
        own = [(apart if zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 else train).pop() for i in ids]
        want = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(list(zip(own, texts, strict=True)), "doc_id long, text string"), most_codes=most).collect()}
        assert got == sorted((i is None, i or 0, want[o]["n_tokens"], want[o]["n_known"], round(want[o]["base_score"], 9), round(want[o]["score"], 9)) for i, o in zip(ids, own, strict=True))
