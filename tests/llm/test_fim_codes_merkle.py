"""Fill-in-middle, token codes and the Merkle manifest against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeflow.llm import codes, fim, merkle
from placeflow.llm.common import id_bucket


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# fill-in-middle


def rearranged(doc_id, text):
    """(form, prefix, middle, output) by the definition."""
    h = sha("1:", "" if doc_id is None else str(doc_id))
    a, b, c, d = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or c % 100 >= 90:
        return "plain", None, None, text
    low, high = sorted((a % (len(text) + 1), b % (len(text) + 1)))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if d % 100 < 20:
        return "spm", low, high - low, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return "psm", low, high - low, f"<P>{prefix}<S>{suffix}<M>{middle}"


HARD = [(1, "<S"), (2, "<P>"), (3, "a<"), (4, "<<<<<S <M P>"), (5, "é" * 70_000 + "x"), (6, "\U0001f600<" * 999), (7, ""), (8, None), (None, "no id at all"), (None, "another text"), (9, "twice"), (9, "twice"), (9, "but not this"), (10, "a\x00b\n")]


def expected(rows):
    out = []
    for i, t in rows:
        form, prefix, middle, output = rearranged(i, t or "")
        out.append((i, len(t or ""), form, prefix, middle, sha(output), sha(t or "")))
    return sorted(out, key=repr)


@pytest.mark.parametrize("units", [1, 7, fim.UNITS])
def test_digests_are_those_of_whole_outputs(spark, units):
    rows = [r for r in HARD if units > 1 or len(r[1] or "") < 100] + [(100 + i, "ab<S" * (i % 5) + "<M") for i in range(60)]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, form string, key int").repartition(5)
    got = sorted((tuple(r) for r in fim.digests(fim.pieces(docs, units=units)).collect()), key=repr)
    assert got == expected(rows)


def test_outputs_are_texts_that_can_be_restored(spark, texts, documents):
    cuts = fim.pieces(documents, units=500)
    got = {r["doc_id"]: (r["form"], r["text"]) for r in fim.texts(cuts).collect()}
    assert {form for form, _ in got.values()} == {"plain", "psm", "spm"}
    for i, text in texts.items():
        form, _, _, output = rearranged(i, text)
        assert got[i] == (form, output)
        assert fim.restore(form, output) == text


def test_other_rates_and_no_rows(spark, empty):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    forms = {k: r["count"] for k, r in ((r["form"], r) for r in fim.pieces(docs, fim.Rates(seed=7, rearranged=100, suffix_first=100)).groupBy("form").count().collect())}
    assert set(forms) == {"spm"}
    assert fim.digests(fim.pieces(empty)).count() == fim.texts(fim.pieces(empty)).count() == 0


def test_one_shuffle_and_no_group_meets_by_id(spark, documents):
    plan = fim.digests(fim.pieces(documents))._jdf.queryExecution().toString()
    physical = plan[plan.index("Physical Plan") :]
    assert physical.count("Exchange") == 1 and physical.count("Sort [") == 2
    copies = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("copy").alias("text")).repartition(16)
    assert fim.pieces(copies).select("key").distinct().count() == 16  # a key for each partition they were read in


# token codes


@pytest.mark.parametrize("most", [1, 2, 200, 49_408, 2**32])
def test_codes_give_back_any_place(most):
    rng = np.random.default_rng(most)
    for size in (0, 1, 63, 64, 513, 5000):
        ids = rng.integers(0, most, size, dtype=np.uint64).astype("<u4")
        cut = sorted(rng.integers(0, size + 1, 2))
        docs = [(5, ids[: cut[0]].tobytes()), (None, ids[cut[0] : cut[1]].tobytes()), (-7, ids[cut[1] :].tobytes())]
        data = codes.encode_file(docs)
        for c in (codes.Codes(lambda at, n, d=data: d[at : at + n], check=True), codes.Codes(lambda at, n, d=data: d[at : at + n]).load()):
            places = rng.permutation(size)
            assert (c.take(places) == ids[places]).all()
            for low, high in [(0, size), (cut[0], cut[1]), (cut[1], cut[1]), (size // 2, size)]:
                assert (c.run(int(low), int(high)) == ids[low:high]).all()
            assert [(i, n) for i, _, n in c.documents()] == [(i, len(d) // 4) for i, d in docs]
            assert list(codes._crcs(c)) == [zlib.crc32(d) for _, d in docs]
            with pytest.raises(IndexError):
                c.take(np.array([size]))


def test_damage_is_found_and_lookups_read_little():
    ids = np.random.default_rng(0).integers(0, 49_408, 400_000).astype("<u4")
    data = codes.encode_file([(1, ids.tobytes())])
    assert len(data) < 4 * len(ids) * 0.6
    broken = bytearray(data)
    broken[len(data) // 2] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        codes.Codes(lambda at, n: bytes(broken[at : at + n]), check=True)
    read = []
    c = codes.Codes(lambda at, n: read.append(n) or data[at : at + n])
    assert c.take(np.array([123_456]))[0] == ids[123_456]
    assert sum(read) < 3000


def test_widths_are_the_best_of_all_splits():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.zeros(34, np.int64)
        lengths[1:7] = rng.integers(0, 100, 6)
        lengths[6] += 1

        def cost(ws, lengths=lengths):
            low, total = 0, 0.0
            for k, w in enumerate(ws):
                here = lengths[1:].sum() if low == 0 else lengths[low + 1 :].sum()
                total += here * (w + (1 + 1 / codes.BLOCK if k < len(ws) - 1 else 0))
                low += w
            return total

        splits = [[]]
        done = []
        while splits:
            s = splits.pop()
            if sum(s) == 6:
                done.append(s)
            else:
                splits += [[*s, w] for w in range(1, 7 - sum(s))]
        assert cost(codes.widths(lengths)) == pytest.approx(min(map(cost, done)))


def test_encoder_gives_the_tokenizers_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    own, rng = codes.encoder("word_bpe_49k"), random.Random(3)
    assert own.by_word
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    letters = [*"abcXYZ019 '.,!-_<|>\t\n\x0b\x0c\r\x1c\x85\xa0éÉßÿÀµªº²½×÷İſΣσςḱǆ漢　​😀", "'s", "'RE", "don't", "<|endoftext|>", "  "]
    cases = ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(4000)] + list(texts.values())[:200] + ["x" * 20_000, " " * 20_000, "<|startoftext|>", ""]
    for lo in range(0, len(cases), 500):
        part = cases[lo : lo + 500]
        want = [e.ids for e in whole.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(part)] == want


def test_words_of_letters_by_rank_are_those_of_the_model():
    import json

    import public_tokenizers

    own, rng = codes.encoder("word_bpe_49k"), random.Random(9)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    byte = {c: b for b, c in codes._letters().items()}
    words = {bytes(byte[c] for c in t.removesuffix("</w>") if c in byte).decode(errors="replace") for t in vocabulary}
    letters = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
    words |= {"".join(rng.choices(letters[: rng.choice((3, 26, len(letters)))], k=rng.randrange(1, 14))) for _ in range(20_000)}
    words = sorted(w for w in words if w.isalpha() and w == w.lower() and not codes._OTHER.search(w))
    ids, ends = own.quick.encode(words)
    want = own.words.encode([w.encode().decode("latin-1").translate(own.letters) for w in words], is_pretokenized=True, add_special_tokens=False)
    assert len(words) > 50_000 and ids.tolist() == want.ids
    assert (np.diff(ends, prepend=0) == np.bincount(want.word_ids)).all()


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(codes, "LONGEST", 50)
    own, rng = codes.encoder("word_bpe_49k"), random.Random(4)
    texts = ["".join(rng.choices("ab,c1 \n\t'sÉ", k=n)) for n in (0, 49, 50, 51, 400, 3000)] + ["x" * 300, " " * 300, "y" * 60 + " z"]
    want = [e.ids for e in own.whole.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == want


def test_a_tokenizer_of_another_kind_is_used_whole():
    own = codes.encoder("byte_bpe_50k")
    assert not own.by_word
    assert np.frombuffer(own.encode(["Some text"])[0], "<u4").tolist() == own.whole.encode("Some text", add_special_tokens=False).ids


def brute_codes(rows):
    whole = codes.encoder("word_bpe_49k").whole
    at, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, codes.END], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_documents_are_read_back_from_the_files(spark, texts, documents):
    store = codes.write_store(documents, roll=5_000)
    assert store.count() > 8 and store.agg(F.sum("docs")).first()[0] == len(texts)
    got = sorted(tuple(r)[:4] for r in codes.read_documents(store).collect())
    assert got == brute_codes(list(texts.items()))
    ids = np.concatenate([np.array([*codes.encoder("word_bpe_49k").whole.encode(t, add_special_tokens=False).ids, codes.END]) for _, t in sorted(texts.items())])
    places = [0, 1, len(ids) - 1, len(ids), -1, None, 77, 77, *range(100, len(ids), 997)]
    wanted = spark.createDataFrame([(p, "x") for p in places], "place long, id string")
    found = sorted(tuple(r) for r in codes.take(store, wanted, stride=3_000).collect())
    assert found == sorted((p, int(ids[p])) for p in places if p is not None and 0 <= p < len(ids))


def test_token_store_of_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    rows += [(None, "another row without an id"), (6, "a third of them")]
    docs = odd.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(*r, 0.0) for r in rows[-2:]], "doc_id long, text string, score double"))
    got = codes.read_documents(codes.write_store(docs)).collect()
    want = brute_codes(rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i is not None, i or 0, n, c) for i, _, n, c in want)
    by_start = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in got if r["doc_id"] is not None)
    assert [a + n for a, n, _ in by_start][:-1] == [a for a, _, _ in by_start][1:]
    assert [i for _, _, i in by_start] == sorted(i for _, _, i in by_start)
    store = codes.write_store(empty)
    assert store.count() == codes.read_documents(store).count() == codes.take(store, spark.range(3).withColumnRenamed("id", "place")).count() == 0


# the Merkle manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def brute_merkle(rows):
    """doc_id, leaf, subroot, root, proof, folded root of each row."""
    by_lang = {}
    for r in rows:
        leaf = sha(*(framed(r[c]) for c in FIELDS))
        low = sha(*(framed("".join(x.lower() if "A" <= x <= "Z" else x for x in r[c]) if c == "text" and r[c] is not None else r[c]) for c in FIELDS))
        by_lang.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, low))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: levels_of([leaf for _, _, leaf, _ in sorted(v)]) for k, v in by_lang.items()}
    upper = levels_of([trees[k][-1][0] for k in langs])
    out = []
    for at, lang in enumerate(langs):
        for i, (known, doc_id, leaf, low) in enumerate(sorted(by_lang[lang])):
            proof, acc = [], low if zlib.crc32(str(doc_id).encode() if known else b"") % 3 == 0 else leaf
            for tree, place in ((trees[lang], i), (upper, at)):
                for level in tree[:-1]:
                    run = level[place // 8 * 8 : place // 8 * 8 + 8]
                    before, after = run[: place % 8], run[place % 8 + 1 :]
                    proof += before + after
                    acc = sha(*before, acc, *after)
                    place //= 8
            out.append((doc_id if known else None, leaf, trees[lang][-1][0], upper[-1][0], sha(*proof), acc))
    return sorted(out, key=repr)


def proved(docs):
    found = merkle.prove(docs, id_bucket(F.col("doc_id"), 3) == 0).withColumn("folded", merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256), "folded").collect()), key=repr)


def test_manifest_of_the_table(documents):
    rows = [r.asDict() for r in documents.select(*FIELDS).collect()]
    assert proved(documents) == brute_merkle(rows)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, None: 1}, {"en": 65, "": 1, None: 2, "é": 8, "z": 73}, {f"l{i}": 1 + i % 3 for i in range(70)}])
def test_manifest_of_groups_of_every_size(spark, sizes):
    rng = random.Random(5)
    rows = [(rng.choice([None, rng.randrange(-50, 50)]), rng.choice([None, "a", "ä"]), lang, rng.choice([None, 3]), rng.choice([None, "", "Some Text É", "lower"]), "c0", 1) for lang, n in sizes.items() for _ in range(n)]
    rows += rows[:2] if len(rows) > 20 else []
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, digest string, idx int").repartition(4)
    assert proved(docs) == brute_merkle([dict(zip(FIELDS, r, strict=False)) for r in rows])


def test_manifest_of_nothing_and_what_its_plan_holds(spark, documents):
    assert merkle.prove(documents.limit(0)).count() == 0
    plan = merkle.prove(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "Window" not in plan[plan.index("Physical Plan") :]
