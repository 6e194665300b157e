import pytest
from pyspark.sql import functions as F

from placeflow.api import Places
from placeflow.functions import geo
from placeflow.operators import collect, grid

BOX = (0.0, 0.0, 0.09, 0.09)
SCHEMA = "cell_key string, page int, rank int, key string, lat double, lon double"


def key_of(spark, lat, lon):
    return spark.range(1).select(geo.cell_key(F.lit(lat), F.lit(lon)).alias("k")).first()["k"]


@pytest.fixture(scope="module")
def world(spark):
    settings = collect.Settings(cell_km=10.0, max_depth=1, min_cell_km=1.0)
    cell = collect.seeds(spark, BOX, None, settings).first()
    root = key_of(spark, cell["lat"], cell["lon"])
    rows = [(root, p, r, f"k{p * 20 + r}", cell["lat"] + 0.0001 * r, cell["lon"]) for p in range(6) for r in range(20)]
    child = collect._children(spark.createDataFrame([cell])).first()
    rows += [(key_of(spark, child["lat"], child["lon"]), 0, r, k, child["lat"], child["lon"]) for r, k in enumerate(["k1", "new"])]
    rows += [(root, 0, 99, "far", 5.0, 5.0)]
    return spark.createDataFrame(rows, SCHEMA), settings


def test_saturated_cell_splits_and_keeps_its_results(world):
    pages, settings = world
    got = collect.collect(pages, BOX, settings=settings)
    counts = got.counters().first()
    assert (counts["cells_total"], counts["cells_subdivided"], counts["cells_saturated"]) == (5, 1, 0)
    assert got.places.count() == 121
    assert counts["raw"] == counts["kept"] + counts["duplicates"] + counts["outside_boundary"] + counts["outside_footprint"]
    assert counts["outside_boundary"] == 1 and counts["duplicates"] == 1
    assert got.manifest().first()["status"] == "complete"


def test_cap_makes_it_incomplete(world):
    pages, settings = world
    capped = collect.Settings(**(settings.__dict__ | {"max_results": 50}))
    got = collect.collect(pages, BOX, settings=capped)
    assert got.places.count() == 50
    assert got.manifest().first()["reasons"][0] == "result cap reached"


def test_resume_skips_cells_and_seen_keys(spark, world):
    pages, settings = world
    done = pages.select("cell_key").distinct()
    assert collect.collect(pages, BOX, settings=settings, completed=done).places.count() == 0
    seen = spark.createDataFrame([(f"k{i}",) for i in range(100)], "key string")
    assert collect.collect(pages, BOX, settings=settings, seen=seen).places.filter("key < 'k1'").count() == 0


def test_gap_fill(spark):
    found = spark.createDataFrame([("a", 0.005, 0.005)], "key string, lat double, lon double")
    cells = grid.generate_cells(spark, (0, 0, 0.09, 0.09), 2.0).collect()
    rows = [(f"gap:{key_of(spark, c['lat'], c['lon'])}", 0, 0, f"g{n}", c["lat"], c["lon"]) for n, c in enumerate(cells) if n in (3, 20)]
    pages = spark.createDataFrame(rows, SCHEMA)
    assert {r["key"] for r in collect.gap_fill(pages, found, (0, 0, 0.09, 0.09), streak=30).collect()} == {"g3", "g20"}
    assert {r["key"] for r in collect.gap_fill(pages, found, (0, 0, 0.09, 0.09), streak=12).collect()} == {"g3"}


def test_contacts_and_reviews(spark):
    pages = spark.createDataFrame([("https://a.com", 0, "https://a.com", '<a href="mailto:x@a.com">'), ("https://a.com", 1, "https://a.com/contact", "x@a.com y@a.com https://x.com/acme")], "site string, page_order int, url string, html string")
    places = spark.createDataFrame([("P1", "A", "https://a.com", 5, ["Shop"]), ("P2", "B", "", 9, ["Shop"]), ("P3", "C", "https://c.com", 1, ["Shop"])], "place_id string, name string, website string, review_count int, categories array<string>")
    rows = {r["place_id"]: r for r in Places({"pages": pages}).contacts(places, "shops", 2).collect()}
    assert rows["P1"]["emails"] == ["x@a.com", "y@a.com"] and rows["P1"]["sources"]["y@a.com"] == "https://a.com/contact"
    assert [rows[p]["contact_status"] for p in ("P1", "P2", "P3")] == ["completed", "not_eligible_no_website", "failed"]
    reviews = spark.createDataFrame([("h", n, f'[null,[null,"t"],[["r{n}",null,[[{n}]]]]]') for n in range(3)], "hex_id string, page int, r string").withColumn("response", F.parse_json("r"))
    assert [r["rating"] for r in Places({"reviews": reviews}).reviews("h", max_reviews=2).collect()] == [0, 1]


def test_collection_refuses_and_resumes(world, tmp_path):
    pages, settings = world
    small = collect.Settings(**(settings.__dict__ | {"max_depth": 0}))
    api, out = Places({"grid_pages": pages}), f"file://{tmp_path}/c"
    assert api.collect(out, "q", BOX, settings=small).first()["kept"] == 120
    with pytest.raises(ValueError):
        api.collect(out, "q", BOX, settings=small)
    with pytest.raises(ValueError):
        api.collect(out, "other", BOX, settings=small, resume=True)
    again = api.collect(out, "q", BOX, settings=small, resume=True).first()
    assert (again["kept"], again["requests"]) == (120, 6)


def test_command_line(world, tmp_path):
    from placeflow.__main__ import main

    pages, _ = world
    pages.write.parquet(f"{tmp_path}/t/grid_pages.parquet")
    main(["grid", "--tables", f"file://{tmp_path}/t", "--out", f"file://{tmp_path}/o", "--bbox", "0,0,0.09,0.09", "--cell-size", "10"])
    assert pages.sparkSession.read.json(f"file://{tmp_path}/o").count() == 121


def test_all_phases_of_a_run(spark, world, tmp_path):
    """Cells, sub-areas, gaps, details and contacts, one after the other; only what is new is added."""
    pages, settings = world
    small = collect.Settings(**(settings.__dict__ | {"max_depth": 0, "cell_km": 10.0}))
    details = pages.select("key").distinct().select(F.col("key"), F.concat(F.lit("P"), "key").alias("place_id"), F.concat(F.lit("Shop "), "key").alias("name"), F.when(F.col("key") < "k2", F.concat(F.lit("https://"), "key", F.lit(".com"))).otherwise("").alias("website"))
    described = pages.join(details, "key").withColumn("review_count", F.lit(1)).withColumn("categories", F.array(F.lit("Shop")))
    gap = grid.generate_cells(spark, BOX, 10.0).first()
    row = "key string, cell {0}, page int, rank int, lat double, lon double, place_id string, name string, website string, review_count int, categories array<string>"
    subareas = spark.createDataFrame([("sub", "midtown", 0, 0, 0.05, 0.05, "Psub", "Sub", "", 1, ["Shop"]), ("k1", "midtown", 0, 1, 0.05, 0.05, "Pk1", "One", "", 1, ["Shop"]), ("off", "midtown", 0, 2, 9.0, 9.0, "Poff", "Off", "", 1, ["Shop"])], row.format("string"))
    sites = spark.createDataFrame([("https://k1.com", 0, "https://k1.com", "mailto:info@k1.com info@k1.com")], "site string, page_order int, url string, html string")
    pd = [None] * 12
    pd[11] = "Renamed"
    body = __import__("json").dumps([None] * 6 + [pd + [None] * 66 + ["Pk0"]])
    answers = spark.createDataFrame([(body,)], "r string").select(F.parse_json("r").alias("response"))
    levels = []
    api, out = Places({"grid_pages": described, "subarea_pages": subareas, "pages": sites, "details": answers}), f"file://{tmp_path}/run"
    row = api.collect(out, "shops", BOX, settings=small, enrich_places=True, max_contacts=5, observer=levels.append).first()
    places = {r["key"]: r for r in api.collected(spark, out).collect()}
    assert gap is not None and [x["kept"] for x in levels] == [120] and row["retained"] == len(places) == 121
    assert places["sub"]["pass"] == "subareas" and "off" not in places and places["k0"]["name"] == "Renamed"
    assert places["k1"]["emails"] == ["info@k1.com"] and row["contact_attempted"] == 5 and row["skipped_limit"] > 0


def test_a_broken_run_leaves_no_trace(spark, world, tmp_path):
    pages, settings = world
    small = collect.Settings(**(settings.__dict__ | {"max_depth": 0}))
    api, out = Places({"grid_pages": pages}), f"file://{tmp_path}/c"
    pages.write.parquet(f"{out}/places/run=1")  # a run that never wrote its line of the manifest
    assert api.manifest(spark, out) is None
    assert api.collect(out, "q", BOX, settings=small).first()["retained"] == 120
    pages.write.parquet(f"{out}/places/run=2")
    assert api.collected(spark, out).count() == 120
    again = api.collect(out, "q", BOX, settings=small, resume=True).first()
    assert (again["retained"], again["run"]) == (120, 2)


def test_keys_of_earlier_runs_are_not_new(spark):
    """A page whose keys were all seen ends the cell, though they are new in it."""
    settings = collect.Settings(cell_km=10.0, max_depth=0)
    cell = collect.seeds(spark, BOX, None, settings).first()
    root = key_of(spark, cell["lat"], cell["lon"])
    rows = [(root, p, r, f"p{p}r{r}", cell["lat"], cell["lon"]) for p in range(3) for r in range(20)]
    pages = spark.createDataFrame(rows, SCHEMA)
    seen = spark.createDataFrame([(f"p1r{r}",) for r in range(20)], "key string")
    got = collect.collect(pages, BOX, settings=settings, seen=seen)
    assert got.places.count() == 20 and got.counters().first()["requests"] == 2


def test_command_line_formats_and_areas(spark, world, tmp_path):
    import json

    from placeflow.__main__ import main

    pages, _ = world
    pages.withColumn("name", F.col("key")).withColumn("rating", F.lit(4.5)).withColumn("categories", F.array(F.lit("Shop"))).write.parquet(f"{tmp_path}/t/grid_pages.parquet")
    hit = {"osm_type": "node", "osm_id": "1", "class": "place", "type": "city", "name": "A", "lat": "0.04", "lon": "0.04", "boundingbox": ["0", "0.09", "0", "0.09"]}
    spark.createDataFrame([("A town", json.dumps([hit]))], "query string, body string").write.parquet(f"{tmp_path}/t/locations.parquet")
    for kind in ("csv", "text"):
        main(["grid", "--tables", f"file://{tmp_path}/t", "--out", f"file://{tmp_path}/{kind}", "--location", "A town", "--cell-size", "10", "--format", kind])
    assert spark.read.option("header", "true").csv(f"file://{tmp_path}/csv").columns == ["name", "place_id", "rating", "reviews", "phone", "website", "emails", "socials", "address", "lat", "lng"]
    assert "k1 | 4.5 | Shop" in {r["value"] for r in spark.read.text(f"file://{tmp_path}/text").collect()}
    with pytest.raises(ValueError):
        main(["grid", "--tables", f"file://{tmp_path}/t", "--out", f"file://{tmp_path}/x", "--location", "Nowhere"])


def test_cells_of_a_level_are_read_in_turn(spark):
    """Overlapping cells at random against a plain reader: what is new depends on how far earlier cells were read."""
    import random

    rng, settings = random.Random(5), collect.Settings(cell_km=2.0, max_depth=0, full_page=3, max_results=10_000)
    cells = sorted((key_of(spark, c["lat"], c["lon"]), c["lat"], c["lon"]) for c in collect.seeds(spark, BOX, None, settings).collect())
    rows = []
    for at, (cell, lat, lon) in enumerate(cells):
        for page in range(rng.randrange(1, 6)):
            error = "TimeoutError" if rng.random() < 0.05 else None
            for rank in range(3 if rng.random() < 0.95 else 2):
                far = rng.random() < 0.1
                rows.append((cell, page, rank, f"k{max(0, at + rng.randrange(-4, 3)) * 5 + rng.randrange(5)}", lat + (5 if far else 0), lon, error))
    seen, want = set(), {}
    for cell, lat, _ in cells:
        pages, kept, requests, failed = {}, 0, 0, False
        for r in rows:
            if r[0] == cell:
                pages.setdefault(r[1], []).append(r)
        for page in sorted(pages):
            if pages[page][0][6]:
                failed = True
                break
            requests += 1
            new = {r[3] for r in pages[page] if r[4] == lat} - seen
            seen |= new
            kept += len(new)
            if len(pages[page]) < 3 or not new:
                break
        want[cell] = (requests, kept, failed)
    df = spark.createDataFrame(rows, SCHEMA + ", error string")
    got = {r["cell_key"]: (r["requests"], r["kept"], r["failed"]) for r in collect.collect(df, BOX, settings=settings).cells.collect()}
    assert got == want and any(f for _, _, f in want.values())
    alone = collect.collect(df, BOX, settings=collect.Settings(**(settings.__dict__ | {"across_cells": False}))).counters().first()
    assert alone["requests"] > sum(n for n, _, _ in want.values())


def test_refused_cells_are_read_again(spark, tmp_path):
    settings = collect.Settings(cell_km=10.0, max_depth=0)
    cell = collect.seeds(spark, BOX, None, settings).first()
    root = key_of(spark, cell["lat"], cell["lon"])
    refused = spark.createDataFrame([(root, 0, 0, None, None, None, "HTTP 429")], SCHEMA + ", error string")
    out = f"file://{tmp_path}/c"
    first = Places({"grid_pages": refused}).collect(out, "q", BOX, settings=settings).first()
    assert (first["cells_failed"], first["cells_completed"], first["status"], first["retained"]) == (1, 0, "incomplete", 0) and "cells failed" in first["reasons"]
    answered = spark.createDataFrame([(root, 0, 0, "a", cell["lat"], cell["lon"], None)], SCHEMA + ", error string")
    again = Places({"grid_pages": answered}).collect(out, "q", BOX, settings=settings, resume=True).first()
    assert (again["retained"], again["requests"]) == (1, 1)
