"""The bounded sample of labelled rows that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeflow.llm.common import id_bucket


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, max_train: int) -> DataFrame:
    """(doc_id, text, label) of at most `max_train` labelled documents outside the held-out remainder.

    The labels are cut to the `max_train` smallest hashes of their ids before the join, so the side
    that is broadcast has a fixed bound and the texts are never shuffled. Null labels and ids are skipped; of
    several labels of one id the largest counts, of several texts the first in order.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
        .filter(id_bucket(F.col("doc_id"), modulus) != held_out)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))  # repeated ids don't widen the sample
