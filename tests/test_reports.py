"""Small reports and request parameters."""

from urllib.parse import urlencode

from pyspark.sql import functions as F

from placeflow.functions import requests
from placeflow.operators import reports


def test_sites_and_cells(spark):
    rows = spark.createDataFrame([("c1", ["a@b.c"], None), ("c1", [], {"x": "u"}), ("c2", None, None), (None, [], {})], "cell_key string, emails array<string>, social_links map<string, string>")
    assert tuple(reports.found_sites(rows).first()) == (4, 2)
    assert tuple(reports.cells_touched(rows).first()) == (4, 2)
    assert tuple(reports.cells_touched(rows.limit(0)).first()) == (0, 0)


def test_categories_ages(spark):
    rows = spark.createDataFrame([(["Coffee Shop", None], 0.0), (None, 3600.0 * 7), ([], None)], "c array<string>, at double")
    got = rows.select(reports.category_holds(F.col("c"), "COFFEE"), reports.category_holds(F.col("c"), ""), reports.is_fresh(F.col("at"), F.lit(3600.0 * 12)), reports.is_stale(F.col("at"), F.lit(3600.0 * 7 + 900))).collect()
    assert [tuple(r) for r in got] == [(True, False, False, True), (False, False, True, False), (False, False, False, False)]


def test_runs_with_and_without_a_manifest(spark):
    runs = spark.createDataFrame([("a", "r1", k, k > 1) for k in (1, 2, 3)] + [("a", "r2", 3, True), ("a", "r2", 4, False)], "city string, run string, key int, relevant boolean")
    told = spark.createDataFrame([("a", "r1", 6, 2, 3, 12)], "city string, run string, discovery_requests long, duplicates long, outside_boundary long, raw_occurrences long")
    got = {r["run"]: r for r in reports.run_report(runs, told).collect()}
    assert (got["r1"]["recall"], got["r1"]["unique_per_request"], got["r1"]["outside_share"], got["r1"]["floor"]) == (0.75, 0.5, 0.25, 4)
    assert got["r2"]["requests"] is None and got["r2"]["outside_share"] is None and got["r2"]["relevant_recall"] == 0.5
    files = spark.createDataFrame([("x.jsonl", "k"), ("y.jsonl", "k")], "file string, key string")
    manifests = spark.createDataFrame([("x.manifest.json", 7)], "file string, requests int")
    assert {r["run"]: r["requests"] for r in reports.runs_of(files, manifests).collect()} == {"x": 7, "y": None}


def test_reviews_in_four_columns(spark):
    rows = spark.createDataFrame([("A", 5, None), (None, None, "t")], "author_name string, rating int, text string")
    assert [tuple(r) for r in reports.review_rows(rows).collect()] == [("A", 5, "", ""), ("Anonymous", 0, "t", "")]


def test_request_parameters(spark):
    rows = spark.createDataFrame([("Café & co*~ x", 1.5, -2.25, 7), ("q", None, 3.0, None)], "q string, lat double, lon double, radius long")
    q, lat, lon = F.col("q"), F.col("lat"), F.col("lon")
    got = rows.select(requests.query_string(requests.search_params(q, lat, lon, "de", zoom=F.lit(3))), requests.query_string(requests.autocomplete_params(q, lat, lon, F.col("radius"))), requests.query_string(requests.photo_params(q))).collect()
    assert got[0][0] == urlencode({"q": "Café & co*~ x", "hl": "de", "center": "1.5,-2.25", "zoom": "3"})
    assert got[0][1] == urlencode({"input": "Café & co*~ x", "hl": "en", "location": "1.5,-2.25", "radius": "7"})
    assert got[1][0] == "q=q&hl=de&zoom=3" and got[1][1] == "input=q&hl=en" and got[1][2] == "photo_reference=q&max_width=800&max_height=800"
