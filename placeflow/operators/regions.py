"""Points in the polygons of a table.

Each polygon is covered with cells of a grid: border cells, which an edge passes, and inner ones. Points meet cells in an
equi-join. A point of an inner cell is inside; one of a border cell is tested with a ray along its row, for which the
cell has the edges of the polygon in that row and no others. The test is the same arithmetic as a test against whole rings.
Points of one position and areas of one shape share their tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeflow.operators import shared

#: Degrees that a border is widened by, far above the rounding of coordinates.
EDGE = 1e-9
_POLYGON = "type string, coordinates array<array<array<double>>>"
_MULTI = "type string, coordinates array<array<array<array<double>>>>"


def edges(areas: DataFrame, region: str = "region", geometry: str = "geometry") -> DataFrame:
    """(region, part, ring, x1, y1, x2, y2): the edges of GeoJSON Polygons and MultiPolygons; ring 0 is the outer one.
    Other types, broken texts and rings of fewer than three points have none."""
    one, many = F.from_json(geometry, _POLYGON), F.from_json(geometry, _MULTI)
    parts = F.when(one["type"] == "Polygon", F.array(one["coordinates"])).when(many["type"] == "MultiPolygon", many["coordinates"])
    rings = areas.select(F.col(region).alias("region"), F.posexplode(parts).alias("part", "rings")).select("region", "part", F.posexplode("rings").alias("ring", "points"))
    whole = rings.filter((F.size("points") >= 3) & ~F.exists("points", lambda p: p.isNull() | (F.size(p) < 2)))
    points = F.col("points")
    pairs = F.transform(points, lambda p, i: F.struct(F.element_at(points, F.when(i == 0, -1).otherwise(i)).alias("a"), p.alias("b")))
    ends = [F.col("e")[side][k].alias(name) for side, k, name in (("a", 0, "x1"), ("a", 1, "y1"), ("b", 0, "x2"), ("b", 1, "y2"))]
    return whole.select("region", "part", "ring", F.explode(pairs).alias("e")).select("region", "part", "ring", *ends)


def _band(value: Column, step: float) -> Column:
    return F.floor(value / step).cast("long")


def inside(lat: Column, lon: Column, row_edges: Column) -> Column:
    """Even-odd rule over array<struct<ring, x1, y1, x2, y2>>: inside ring 0 and in no other."""

    def meets(e: Column) -> Column:
        return ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])

    met = F.transform(F.filter(row_edges, meets), lambda e: e["ring"])
    odd = F.filter(F.array_distinct(met), lambda r: F.size(F.filter(met, lambda x: x == r)) % 2 == 1)
    return (F.size(odd) == 1) & (F.coalesce(odd[0], F.lit(-1)) == 0)


def cover(areas: DataFrame, step: float = 0.05, region: str = "region", geometry: str = "geometry") -> DataFrame:
    """(row, col, region, parts): the cells of `step` degrees that the polygons cover; `parts` has an entry for each part of
    the region there, with its edges in the row for a border cell and null for an inner one.

    Cells grow with border length and area over `step`; a row's edges of one part are held together, and no more.
    """
    path = shared.folder(areas.sparkSession, "regions")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    banded = edges(areas, region, geometry).withColumn("row", F.explode(F.sequence(_band(low, step), _band(high, step))))
    banded = shared.kept(banded, f"{path}/edges")
    bands = banded.groupBy("region", "part", "row").agg(F.collect_list(F.struct("ring", "x1", "y1", "x2", "y2")).alias("edges"))

    def x_at(y: Column) -> Column:
        return F.coalesce(F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)), F.col("x1"))

    bottom, top = x_at(F.greatest(low, F.col("row") * step)), x_at(F.least(high, (F.col("row") + 1) * step))
    flat = F.col("y1") == F.col("y2")
    left = F.when(flat, F.least("x1", "x2")).otherwise(F.least(bottom, top)) - EDGE
    right = F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(bottom, top)) + EDGE
    border = banded.select("region", "part", "row", F.explode(F.sequence(_band(left, step), _band(right, step))).alias("col")).distinct()
    border = shared.kept(border, f"{path}/border")
    following = F.lead("col").over(Window.partitionBy("region", "part", "row").orderBy("col"))
    gaps = border.withColumn("next", following).filter("next > col + 1").join(bands, ["region", "part", "row"])
    filled = gaps.filter(inside((F.col("row") + 0.5) * step, (F.col("col") + 1.5) * step, F.col("edges")))
    inner = filled.select("region", "row", F.explode(F.sequence(F.col("col") + 1, F.col("next") - 1)).alias("col"), F.lit(None).cast(dict(bands.dtypes)["edges"]).alias("edges"))
    outer = border.join(bands, ["region", "part", "row"]).select("region", "row", "col", "edges")
    cells = inner.unionByName(outer).groupBy("row", "col", "region").agg(F.collect_list(F.struct("edges")).alias("parts"))
    return shared.kept(cells, f"{path}/cells")


def locate(points: DataFrame, cells: DataFrame, step: float = 0.05, lat: str = "lat", lon: str = "lon", how: str = "inner") -> DataFrame:
    """The points with `region`, a row for each region that holds one (`how="left"`: also points in none, region null).
    A point without coordinates lies in none. `cells` come from `cover` with the same `step`."""
    keyed = points.withColumn("_row", _band(F.col(lat), step)).withColumn("_col", _band(F.col(lon), step))
    cells = cells.withColumnsRenamed({"row": "_r", "col": "_c", "parts": "_parts"})
    within = F.exists("_parts", lambda p: p["edges"].isNull() | inside(F.col(lat), F.col(lon), p["edges"]))
    on = (F.col("_row") == F.col("_r")) & (F.col("_col") == F.col("_c")) & within
    return keyed.join(cells, on, how).drop("_row", "_col", "_r", "_c", "_parts")


def join(points: DataFrame, areas: DataFrame, step: float = 0.05, region: str = "region", geometry: str = "geometry", how: str = "inner") -> DataFrame:
    """The points with the `region` of each area that holds them.

    Each position meets each shape once, however many points stand there and however many areas have that shape; what was
    found is then joined to the points, and nothing of the result's size is shuffled where positions or shapes repeat.
    """
    path = shared.folder(points.sparkSession, "shapes")
    areas = areas.select(F.col(region).alias("region"), F.col(geometry).alias("geometry")).distinct()
    shapes = areas.select("geometry").distinct().withColumn("_shape", F.monotonically_increasing_id())
    shapes = shared.kept(shapes, f"{path}/shapes")  # ids that stay
    members = areas.join(shapes, "geometry").select("_shape", "region")
    at = F.concat((F.col("lat") + 0.0).cast("string"), F.lit(","), (F.col("lon") + 0.0).cast("string"))  # -0.0 is 0.0
    positions = shared.kept(points.select(at.alias("_at"), F.col("lat") + 0.0, F.col("lon") + 0.0).toDF("_at", "lat", "lon").dropna().distinct(), f"{path}/positions")
    cells = shared.spread(cover(shapes, step, "_shape"), "row", "col", "region")
    found = locate(positions, cells, step).select("_at", F.col("region").alias("_shape")).join(members, "_shape").select("_at", "region")
    found = shared.kept(found, f"{path}/found")
    return shared.spread(points.withColumn("_at", at), "_at").join(shared.spread(found, "_at").hint("merge"), "_at", how).drop("_at")
