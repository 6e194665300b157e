import zlib

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark):
    sf_dir = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, kept = documents, {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == documents.columns
        kept[name] = out.count()
        docs = out
    assert documents.count() > kept["toxicity"] == kept["line_dedup"] > kept["simhash_near_dedup"] > kept["decontamination"] > 0
    assert docs.select("doc_id").distinct().count() == kept["decontamination"]


def test_run_packs_the_documents_that_brute_force_keeps(spark, documents, texts, sf_dir):
    """Each stage is checked by brute force on what the stage before it kept."""
    from placeflow.llm import packing

    docs, before = documents, None
    for name, stage in pipeline.STAGES:
        rows = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()} if name != "packing" else None
        if name == "simhash_near_dedup":
            assert len(set(rows.values())) <= len(rows)
        if name == "decontamination":
            assert len(set(rows.values())) == len(rows)
            items = [r["text"].lower() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            clean = {i for i, t in rows.items() if not any(q in t.lower() for q in items)}
            kept = {r["doc_id"] for r in stage(spark, docs, sf_dir).collect()}
            assert kept == clean
        before, docs = docs, stage(spark, docs, sf_dir)
    encode = packing.tokenizer("byte_bpe_50k").id_bytes
    whole = {r["doc_id"]: r["text"] or "" for r in before.collect()}
    got = {}
    for r in docs.collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == set(whole)
    for i, parts in got.items():
        ids = np.append(np.frombuffer(encode(whole[i]), "<u4"), np.uint32(1)).astype("<u4")
        assert sum(p["length"] for p in parts) == len(ids)
        for p in parts:
            assert zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]


def test_stages_on_odd_and_empty_rows(spark, odd):
    """Nulls, empty texts, repeated rows, no rows, and columns named like the operators' own."""
    sf_dir = "/root/testdata/sf0.001"
    clashing = ("component_id", "gone", "n_dropped", "cut_id", "cut_hash", "f0", "id", "fp", "salt", "key", "label", "train")
    docs = odd.withColumn("doc_id", odd["doc_id"] + 1_000_000)  # no labels for these
    docs = docs.selectExpr("*", "'en' AS lang", "'web' AS source", "CAST(length(text) AS long) AS n_chars", *(f"7 AS {c}" for c in clashing))
    for given in (docs, docs.limit(0)):
        n, now = given.count(), given
        for name, stage in pipeline.STAGES:
            now = stage(spark, now, sf_dir)
            rows = [r.asDict() for r in now.collect()]
            if name != "packing":
                assert now.columns == docs.columns
                assert all(r["cut_id"] == 7 and r["n_lines"] == 1 and r["fingerprint"] == "x" for r in rows)
            if name == "simhash_near_dedup" and n:  # 2 copies 1; 4 and 7 have no words, like 3; a repeated row stays once
                assert sorted((r["doc_id"] is not None, (r["doc_id"] or 0) % 1_000_000) for r in rows) == [(False, 0), (True, 1), (True, 3), (True, 5), (True, 6)]
            assert bool(rows) == bool(n)
