"""A quadtree over a user's own search, and paths of any depth."""

import random

from pyspark.sql import functions as F

from placeflow.operators import grid, quality

BOX = (36.0, -87.0, 36.4, -86.6)
SCHEMA = "place_id string, lat double, lon double"


def catalogue():
    rng = random.Random(3)
    spots = [(f"c{i}", 36.011 + rng.random() * 0.02, -86.93 + rng.random() * 0.02) for i in range(400)] + [(f"s{i}", 36.0 + rng.random() * 0.4, -87.0 + rng.random() * 0.4) for i in range(40)]
    return [*spots, (None, 36.3, -86.7), (None, 36.3001, -86.7)]


def searching(spots, cap):
    def search(lat, lon, zoom, km):
        half = km / 2 / 111.32 * 1.01  # a bit more than the cell: neighbours show a place twice
        return [s for s in spots if abs(s[1] - lat) <= half and abs(s[2] - lon) <= half][:cap]

    return search


def plain(box, search, saturation, min_km, max_depth):
    """The same tree by a stack."""
    stack, seen, kept, cells = [(box, 0)], set(), 0, 0
    while stack:
        (s, w, n, e), depth = stack.pop(0)
        lat, lon, km = (s + n) / 2, (w + e) / 2, (n - s) * 111.32
        found = search(lat, lon, min(15 + depth, 19), km)
        cells += 1
        if len(found) >= saturation and depth < max_depth and km / 2 >= min_km:
            stack += [((a, b, c, d), depth + 1) for a, b, c, d in ((s, w, lat, lon), (s, lon, lat, e), (lat, w, n, lon), (lat, lon, n, e))]
            continue
        for place, *_ in found:
            if place is None or place not in seen:
                kept += 1
            seen.add(place)
    return cells, kept, seen


def test_tree_over_a_search_recovers_what_one_cell_hides(spark):
    spots = catalogue()
    search = searching(spots, 120)
    got = grid.adaptive_search(spark, BOX, search, SCHEMA, saturation=120)
    cells, kept, seen = plain(BOX, search, 120, 0.2, 6)
    row = got.report().first()
    assert (row["cells_searched"], row["unique_places"]) == (cells, kept)
    assert {r["place_id"] for r in got.places.collect()} == seen == {s[0] for s in spots}
    assert row["max_depth"] > 2 and row["cells_searched"] == row["leaf_cells"] + row["cells_subdivided"]
    one = grid.adaptive_search(spark, BOX, search, SCHEMA, saturation=120, max_depth=0)
    assert one.places.filter("place_id IS NOT NULL").count() <= 120 and one.report().first()["saturated_cells"] == 1


def test_a_search_without_results(spark):
    got = grid.adaptive_search(spark, BOX, lambda *_: [], SCHEMA)
    assert got.places.count() == 0 and got.report().first()["cells_searched"] == 1


def test_leaves_at_any_depth(spark):
    deep = '["a",[[[[["six",2.5,true,null]]]]],{"k":[1]}]'
    for _ in range(40):
        deep = f"[{deep}]"
    entries = spark.createDataFrame([(1, '[[[[[["six"]]]]],"x"]'), (2, deep), (3, "7"), (4, "[]")], "e int, j string").select("e", F.parse_json("j").alias("pd"))
    with quality.unlimited(spark):
        got = {(r["e"], tuple(r["path"])): r["text"] for r in quality.leaf_paths(entries, ("e",)).collect()}
    assert got[1, (0,) * 6] == "six" and got[1, (1,)] == "x" and got[3, ()] == "7"
    assert got[2, (0,) * 40 + (1, 0, 0, 0, 0, 0)] == "six" and len(got) == 7
