"""Costly work on narrow rows runs on all cores, however few tasks read their file."""

import pytest

from placeflow.functions import contacts
from placeflow.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["place_lookup", "details_fields", "parse_hours_rating", "emails_extract"])
def test_rows_of_one_file_are_dealt_to_all_cores(spark, sf_dir, name):
    cores = spark.sparkContext.defaultParallelism
    assert spark.read.parquet(f"{sf_dir}/customer.parquet").rdd.getNumPartitions() < cores
    parts = QUERIES[name](spark, sf_dir).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(parts) >= (2 if name == "place_lookup" else 1) * cores


def test_a_sites_host_is_bound_once(spark):
    rows = spark.createDataFrame([("a@shop.com b@x.org c@gmail.com d@mail.shop.com", w) for w in ("https://www.shop.com/a", "", "  ", None, "shop.com")], "html string, website string")
    out = rows.select(contacts.emails(rows["html"], rows["website"]).alias("e"))
    assert [len(r["e"]) for r in out.collect()] == [3, 4, 4, 4, 3]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("[0-9]*$") == 1  # the port is cut off once
