"""A corpus pipeline over `documents`: toxic documents go, then lines that many documents share, then near copies,
then documents that hold benchmark questions; what is left is packed into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeflow.llm import decontaminate, linededup, packing, similar, toxicity
from placeflow.llm.common import materialize, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more by a model fitted on a bounded sample of the labelled ones go.
    Without labelled documents all stay."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go; n_chars follows the text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    packed = docs.select("doc_id", "text", F.struct(*(rest or ["doc_id"])).alias("rest"))  # no name can clash in there
    kept = linededup.drop_shared_lines(packed, keep=("rest",))
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return kept.select(*(own.get(c, F.col("rest")[c]).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact or near copies the document with the smallest id stays, once where its row repeats;
    of a group without ids one document stays."""
    return similar.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's template go. A row is judged by its own text: where ids are missing or
    clash, rows are told apart by a hash of id and text."""
    row = F.xxhash64(docs["doc_id"], F.coalesce(docs["text"].cast("string"), F.lit("")))
    with scratch(spark):
        found = decontaminate.contaminated(docs.select(row.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
        leaks = materialize(found.select("doc_id").distinct(), "leaks", keep=True)
    return docs.join(leaks, row == leaks["doc_id"], "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids with their sequences and offsets."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Not expressible in SQL: a fitted classifier, fingerprints and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
