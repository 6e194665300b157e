"""Geometry as columns. Coordinates are degrees, distances metres, boxes closed on every edge."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6_371_000.0
KM_PER_DEGREE = 111.32
#: Metres a map view spans at zoom 16.
VIEW_METRES_AT_16 = 6634.902757720493


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_METRES * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def accept_radius(cell_km: Column, buffer: float = 1.5) -> Column:
    """The circle around a square cell's centre that reaches its corners, times `buffer`."""
    return F.greatest(cell_km, F.lit(0.01)) / 2 * math.sqrt(2) * 1000 * buffer


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """`box` is (min_lat, min_lon, max_lat, max_lon); null coordinates are outside."""
    return F.coalesce(lat.between(box[0], box[2]) & lon.between(box[1], box[3]), F.lit(False))


def _ring_column(ring: list[tuple[float, float]]) -> Column:
    edges = list(zip(ring, [*ring[-1:], *ring[:-1]], strict=True))
    return F.array(*(F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (*a, *b), strict=True))) for a, b in edges))


def in_ring(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule with half-open edges; `ring` is [lon, lat] points; fewer than three are outside."""
    if len(ring) < 3:
        return F.lit(False)

    def cross(inside: Column, e: Column) -> Column:
        meets = ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])
        return inside != F.coalesce(meets, F.lit(False))

    return F.aggregate(_ring_column(ring), F.lit(False), cross)


def in_geometry(lat: Column, lon: Column, geometry: dict) -> Column:
    """GeoJSON Polygon or MultiPolygon, holes excluded; other types contain nothing. A box test comes first."""
    polygons = {"Polygon": [geometry.get("coordinates")], "MultiPolygon": geometry.get("coordinates")}.get(geometry.get("type"))
    if not polygons:
        return F.lit(False)
    points = [p for rings in polygons for ring in rings[:1] for p in ring]
    if not points:
        return F.lit(False)
    box = (min(p[1] for p in points), min(p[0] for p in points), max(p[1] for p in points), max(p[0] for p in points))
    inside = F.lit(False)
    for outer, *holes in polygons:
        own = in_ring(lat, lon, outer)
        for hole in holes:
            own = own & ~in_ring(lat, lon, hole)
        inside = inside | own
    return in_box(lat, lon, box) & inside


def in_location(lat: Column, lon: Column, box: tuple[float, float, float, float], geometry: dict | None) -> Column:
    """The polygon where there is one, else the box."""
    if geometry and geometry.get("type") in ("Polygon", "MultiPolygon"):
        return in_geometry(lat, lon, geometry)
    return in_box(lat, lon, box)


def cell_key(lat: Column, lon: Column) -> Column:
    return F.format_string("%.6f,%.6f", lat, lon)


def view_metres(zoom: Column) -> Column:
    return F.lit(VIEW_METRES_AT_16) * F.pow(F.lit(2.0), F.lit(16) - zoom)


def box_around(lat: Column, lon: Column, radius_km: Column) -> Column:
    dlat = radius_km / KM_PER_DEGREE
    dlon = radius_km / (F.lit(KM_PER_DEGREE) * F.cos(F.radians(lat)))
    return F.struct((lat - dlat).alias("min_lat"), (lon - dlon).alias("min_lon"), (lat + dlat).alias("max_lat"), (lon + dlon).alias("max_lon"))


def box_from_text(text: Column) -> Column:
    """Four comma-separated numbers; null if there are not four."""
    parts = F.transform(F.split(text, ","), lambda x: x.try_cast("double"))
    return F.when((F.size(parts) == 4) & ~F.exists(parts, lambda x: x.isNull()), F.struct(*(parts[i].alias(n) for i, n in enumerate(("min_lat", "min_lon", "max_lat", "max_lon")))))


def quarters(box: Column) -> Column:
    """The four quarters of a box: south-west, south-east, north-west, north-east."""
    lat, lon = (box["min_lat"] + box["max_lat"]) / 2, (box["min_lon"] + box["max_lon"]) / 2

    def part(*values: Column) -> Column:
        return F.struct(*(v.alias(n) for v, n in zip(values, ("min_lat", "min_lon", "max_lat", "max_lon"), strict=True)))

    s, w, n, e = box["min_lat"], box["min_lon"], box["max_lat"], box["max_lon"]
    return F.array(part(s, w, lat, lon), part(s, lon, lat, e), part(lat, w, n, lon), part(lat, lon, n, e))


def box_km(box: Column) -> Column:
    """North-south extent."""
    return (box["max_lat"] - box["min_lat"]) * KM_PER_DEGREE


def zoom_at(depth: Column, base: int = 15, most: int = 19) -> Column:
    return F.least(F.lit(base) + depth, F.lit(most))
