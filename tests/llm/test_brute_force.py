"""Results recomputed by plain Python: FTRL, dual coordinate descent, Ogg pages, packed pieces, pipeline stages."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from placeflow.llm import linededup, ogg, packing, quality, toxicity, training


def sparse_rows(n, size, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        label = rng.randrange(2)
        ids = sorted(set(rng.choices(range(size), k=rng.randrange(1, 20))) | ({0, 1} if label else {2}))
        rows.append((label, np.array(ids)))
    return rows


def test_ftrl_matches_plain_python():
    rows = sparse_rows(120, 40, 1)
    alpha, beta, l1, l2, least = 0.7, 1.0, 0.5, 0.1, 3
    got, bias = toxicity.ftrl(rows, 40, alpha, beta, l1, l2, 3, least)
    seen = Counter(i for _, ids in rows for i in ids.tolist())
    z, n, bz, bn = Counter(), Counter(), 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(7).permutation(len(rows))
    for _ in range(3):
        for k in order:
            label, ids = rows[k][0], [i for i in rows[k][1].tolist() if seen[i] >= least]
            w = {i: weight(i) for i in ids}
            b = -bz / ((beta + math.sqrt(bn)) / alpha)
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - label
            for i in ids:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
            sigma = (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha
            bz, bn = bz + g - sigma * b, bn + g * g
    assert all(math.isclose(got[i], weight(i), rel_tol=1e-9, abs_tol=1e-9) for i in range(40))
    assert math.isclose(bias, -bz / ((beta + math.sqrt(bn)) / alpha), rel_tol=1e-9) and 0 < np.count_nonzero(got) < 40


def test_toxicity_scores_match_plain_python(spark):
    """Words, pairs and skip-pairs of a text, each once, by their hashes."""
    texts = ["you are a Fool, a fool", "", "kind words", "fool"]
    ids = {t: np.unique(toxicity.gram_ids([t.encode()])[0]) for t in texts}
    chosen = np.unique(np.concatenate(list(ids.values())))
    weights = np.linspace(-1, 1, len(chosen))
    rows = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (chosen, weights, -0.5)).collect()
    table = dict(zip(chosen.tolist(), weights.tolist(), strict=True))
    for r in rows:
        margin = sum(table[i] for i in ids[texts[r["doc_id"]]].tolist()) - 0.5
        assert math.isclose(r["score"], 1 / (1 + math.exp(-margin)), rel_tol=1e-9)
    words = ["you", "are", "a", "fool", "a", "fool"]
    grams = {*words, *zip(words, words[1:], strict=False), *((a, "_", b) for a, b in zip(words, words[2:], strict=False))}
    assert len(ids[texts[0]]) == len(grams)


def test_ratios_and_dual_descent_match_plain_python():
    rows = sparse_rows(80, 30, 2)
    ratio = quality.log_count_ratio(rows, 30)
    counts = [[1.0 + sum(i in ids for y, ids in rows if y == c) for i in range(30)] for c in (0, 1)]
    assert np.allclose(ratio, [math.log((counts[1][i] / sum(counts[1])) / (counts[0][i] / sum(counts[0]))) for i in range(30)], rtol=1e-12)
    got = quality.dual_descent(rows, ratio, c=0.8, epochs=4, tolerance=0)
    xs = []
    for y, ids in rows:
        norm = math.sqrt(sum(ratio[i] ** 2 for i in ids) + 100.0)
        xs.append((1 if y else -1, {**{int(i): ratio[i] / norm for i in ids}, 30: 1.0}))
    w, alpha, rng = [0.0] * 31, [0.0] * len(xs), np.random.default_rng(11)
    for _ in range(4):
        for k in rng.permutation(len(xs)):
            y, x = xs[k]
            g = y * sum(w[i] * v for i, v in x.items()) - 1
            new = min(max(alpha[k] - g / sum(v * v for v in x.values()), 0.0), 0.8)
            for i, v in x.items():
                w[i] += (new - alpha[k]) * y * v
            alpha[k] = new
    assert np.allclose(got, w, rtol=1e-9, atol=1e-9)


def plain_pages(data):
    """(serial, flags, granule, lacing, body) of each page."""
    at = 0
    while at < len(data):
        _, _, flags, granule, serial, _, _, n = struct.unpack_from("<4sBBqIIIB", data, at)
        lacing = data[at + 27 : at + 27 + n]
        yield serial, flags, granule, lacing, data[at + 27 + n : at + 27 + n + sum(lacing)]
        at += 27 + n + sum(lacing)


def test_ogg_columns_match_plain_python(spark, documents, texts, sf_dir):
    for r in ogg.query(spark, sf_dir).collect():
        text = texts[r["doc_id"]].encode()
        payload = text + b"\xff" * (max(1, -(-len(text) // 576)) * 576 - len(text))
        media = ogg.write_ogg(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
        pages = list(plain_pages(media))
        streams, ended, marks = {}, Counter(), {}
        for serial, flags, granule, lacing, body in pages:
            if flags & 2:
                streams[serial], marks[serial] = b"", []
                continue
            streams[serial] += body
            if any(x < 255 for x in lacing):  # a packet of 576 samples ends here: its end's place over the rate
                ended[serial] += sum(x < 255 for x in lacing)
                marks[serial].append(ended[serial] * 576 / 8000)
                assert granule == ended[serial] * 576
        assert r["timestamps"] == [m for own in marks.values() for m in own]
        dealt = list(streams.values())
        order = [dealt[k % 2][k // 2 * 576 : k // 2 * 576 + 576] for k in range(len(payload) // 576)]
        assert b"".join(order) == payload
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:], strict=False))
        want = f"pages={len(pages)};streams=2;packets={len(payload) // 576};continued={sum(p[1] & 1 for p in pages)};seconds={max(len(x) for x in dealt) / 8000:.4f};mean={sum(payload) / len(payload):.4f};crossings={crossings}"
        assert r["feature"] == want


def test_packed_pieces_match_the_tokenizer(spark, texts, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    rows = packing.query(spark, sf_dir).collect()
    ids = {i: [*encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    places = Counter()
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and 0 < r["length"] <= 2048
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
        places.update((r["doc_id"], k) for k in range(r["start"], r["start"] + r["length"]))
    assert places == Counter((i, k) for i, own in ids.items() for k in range(len(own)))
    used = Counter()
    for r in rows:
        used.update((r["sequence_id"], k) for k in range(r["offset"], r["offset"] + r["length"]))
    assert max(used.values()) == 1
    lengths = Counter(s for s, _ in used)
    assert all(max(k for s, k in used if s == q) + 1 == lengths[q] for q in list(lengths)[:20])


def test_repeated_ids_do_not_widen_the_sample(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c"), (3, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")
    rows = training.labelled_sample(docs, labels, "toxic", 4, 2, 1000).collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) and all(r["text"] == "a" for r in rows if r["doc_id"] == 1)


pipeline = pytest.importorskip("corpus_pipeline")


def words_of(text, width=5):
    words = text.lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def test_pipeline_stages_match_brute_force(spark):
    """Line dedup and near copies as stages, by hand, over ids that are missing, clash and repeat."""
    rng = random.Random(8)
    shared = "a line that many of these texts have"
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(40):
        own = list(base if i % 4 == 0 else [f"t{i}w{k}" for k in range(60)])
        for k in rng.sample(range(len(own)), 3 if i % 4 == 0 else 0):
            own[k] = f"e{i}x{k}"
        text = " ".join(own) + (f"\n{shared.upper()}" if i % 2 else "")
        rows.append((None if i % 10 == 3 else 7 if i in (5, 6) else i, text))
    rows += [rows[0], rows[3], (50, rows[1][1]), (None, rows[2][1]), (51, ""), (52, None), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(pipeline.STAGES)
    lined = [(r["doc_id"], r["text"]) for r in stages["line_dedup"](spark, df, "").collect()]
    keys = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            keys.setdefault(linededup.line_key(line.encode()), set()).add(i)
    want = [(i, "\n".join(x for x in (t or "").split("\n") if not (k := linededup.line_key(x.encode())) or len(keys[k]) < 10)) for i, t in rows]
    assert sorted(lined, key=repr) == sorted(want, key=repr)
    kept = [(r["doc_id"], r["text"]) for r in stages["simhash_near_dedup"](spark, df, "").collect()]
    distinct = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r))
    sets = [words_of(t) for _, t in distinct]
    group = list(range(len(distinct)))
    for a in range(len(distinct)):
        for b in range(a):
            if sets[a] == sets[b] or (sets[a] and sets[b] and 25 * len(sets[a] & sets[b]) ** 2 >= 16 * len(sets[a]) * len(sets[b])):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    assert len(kept) == len(set(group))
    members = {}
    for row, g in zip(distinct, group, strict=True):
        members.setdefault(g, []).append(row)
    by_text = {(i, t): g for g, own in members.items() for i, t in own}
    for i, t in kept:
        own = members[by_text[i, t or ""]]
        assert i == min((x for x, _ in own if x is not None), default=None)
