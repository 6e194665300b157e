"""Points in a table of polygons against whole rings, and tilings of boxes of a table."""

import json
import random

import pytest
from pyspark.sql import functions as F

from placeflow.operators import grid, regions


def ring_holds(ring, lat, lon):
    inside = False
    for (x1, y1), (x2, y2) in zip([ring[-1], *ring[:-1]], ring, strict=True):
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            inside = not inside
    return len(ring) > 2 and inside


def holds(geometry, lat, lon):
    polygons = [geometry["coordinates"]] if geometry["type"] == "Polygon" else geometry["coordinates"]
    return any(p and ring_holds(p[0], lat, lon) and not any(ring_holds(h, lat, lon) for h in p[1:]) for p in polygons)


def shapes():
    rng = random.Random(8)
    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    wild = lambda n: [[rng.uniform(-1, 1), rng.uniform(-1, 1)] for _ in range(n)]
    out = {f"wild{n}": {"type": "Polygon", "coordinates": [wild(n)]} for n in (3, 5, 9, 40)}
    out["holes"] = {"type": "Polygon", "coordinates": [square(-0.9, -0.9, 1.8), square(-0.5, -0.5, 0.3), square(-0.4, -0.4, 0.5)]}
    out["parts"] = {"type": "MultiPolygon", "coordinates": [[square(-1, -1, 0.5)], [square(-0.8, -0.8, 0.6), square(-0.7, -0.7, 0.1)], [square(0.25, 0.25, 0.05)]]}
    out["on cell edges"] = {"type": "Polygon", "coordinates": [square(-0.5, 0.0, 0.5)]}
    out["needle"] = {"type": "Polygon", "coordinates": [[[-1, -1], [1, 1], [1, 1.000001]]]}
    out["two points"] = {"type": "Polygon", "coordinates": [[[0, 0], [1, 1]]]}
    out["empty"] = {"type": "MultiPolygon", "coordinates": []}
    return out


@pytest.mark.parametrize("step", [0.05, 0.25, 3.0])
def test_join_is_a_test_against_whole_rings(spark, step):
    rng, known = random.Random(1), shapes()
    points = [(i, rng.uniform(-1.1, 1.1), rng.uniform(-1.1, 1.1)) for i in range(400)] + [(1000 + 50 * a + b, a / 20 - 1, b / 20 - 1) for a in range(0, 41, 2) for b in range(0, 41, 3)] + [(9999, None, 0.0)]
    areas = [(n, json.dumps(g)) for n, g in known.items()] + [("line", '{"type": "LineString", "coordinates": [[0, 0], [1, 1]]}'), ("broken", "{"), ("none", None)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    got = {(r["id"], r["region"]) for r in regions.join(df, spark.createDataFrame(areas, "region string, geometry string"), step).collect()}
    assert got == {(i, n) for i, lat, lon in points if lat is not None for n, g in known.items() if holds(g, lat, lon)}


def test_inner_cells_hold_no_edges_and_points_meet_by_cells(spark):
    areas = spark.createDataFrame([("big", json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10]]]}))], "region string, geometry string")
    cells = regions.cover(areas, 0.5)
    inner = cells.filter("parts[0].edges IS NULL").count()
    assert inner > 300 and cells.count() - inner < 130  # an edge on a cell edge has both sides
    points = spark.range(10).select((F.col("id") + 0.5).cast("double").alias("lat"), F.lit(5.0).alias("lon"))
    found = regions.locate(points, cells, 0.5)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and found.count() == 10
    assert regions.locate(points.withColumn("lon", F.lit(50.0)), cells, 0.5, how="left").filter("region IS NULL").count() == 10


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_position_meets_a_shape_once(spark, monkeypatch, how):
    met, locate = [], regions.locate

    def counted(points, cells, *rest, **more):
        met.append((points.count(), cells.select("region").distinct().count()))
        return locate(points, cells, *rest, **more)

    monkeypatch.setattr(regions, "locate", counted)
    square = json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1]]]})
    areas = [(f"r{i}", square) for i in range(30)] + [("r0", square)]  # a row that repeats is one area
    points = [(i, 0.5 if i % 2 else 5.0, 0.25) for i in range(200)] + [(200, None, 0.25), (201, 0.5, None)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    got = sorted((r["id"], r["region"]) for r in regions.join(df, spark.createDataFrame(areas, "region string, geometry string"), 0.25, how=how).collect() if r["region"])
    assert got == sorted((i, f"r{k}") for i in range(1, 200, 2) for k in range(30)) and met == [(2, 1)]
    if how == "left":
        assert regions.join(df, spark.createDataFrame(areas, "region string, geometry string"), 0.25, how=how).filter("region IS NULL").count() == 102


def test_boxes_of_a_table_are_tiled_like_single_ones(spark):
    places = spark.createDataFrame([("a", 10.0, 20.0), ("a", 10.3, 20.2), ("b", -5.0, 1.0), ("b", -5.0, 1.0), ("c", None, 3.0)], "city string, lat double, lon double")
    boxes = grid.boxes_of(places, "city")
    rows = grid.cells_of(boxes, F.lit(3.0)).collect()
    assert {r["city"] for r in rows} == {"a", "b"} and [(r["lat"], r["lon"]) for r in rows if r["city"] == "b"] == [(-5.0, 1.0)]
    one = grid.generate_cells(spark, (10.0, 20.0, 10.3, 20.2), 3.0).collect()
    assert sorted((r["i"], r["j"], round(r["lat"], 9), round(r["lon"], 9)) for r in rows if r["city"] == "a") == sorted((r["i"], r["j"], round(r["lat"], 9), round(r["lon"], 9)) for r in one)
    ladder = {r["km"]: (r["cells"], r["chosen"]) for r in grid.estimates_of(boxes.filter("city = 'a'"), 50).collect()}
    assert {r["km"]: (r["cells"], r["chosen"]) for r in grid.estimates(spark, (10.0, 20.0, 10.3, 20.2), 50).collect()} == ladder


@pytest.mark.parametrize("box", [(36.0, -87.0, 36.4, -86.6), (-0.2, 179.0, 0.2, 179.5), (68.0, 10.0, 68.3, 10.8)])
def test_gaps_are_the_cells_without_a_place_in_their_circle(spark, box):
    import math

    rng = random.Random(box[0])
    spots = [(rng.uniform(box[0] - 0.05, box[2] + 0.05), rng.uniform(box[1] - 0.05, box[3] + 0.05)) for _ in range(60)] + [(box[0] + 0.1, box[1] + 0.1)] * 200 + [(None, 1.0)]
    cells = grid.generate_cells(spark, box, 2.0)

    def metres(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))

    for radius in (0.3, 1.0, 4.0):
        got = {(r["i"], r["j"]) for r in grid.uncovered_cells(cells, spark.createDataFrame(spots, "lat double, lon double"), radius, box).collect()}
        assert got == {(r["i"], r["j"]) for r in cells.collect() if not any(a is not None and metres(r["lat"], r["lon"], a, o) <= radius * 1000 for a, o in spots)}
