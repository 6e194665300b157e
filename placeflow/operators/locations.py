"""Named areas from recorded answers of a geocoder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeflow.functions import geo
from placeflow.functions.keys import filled

#: Kinds of sub-areas in the order in which they are asked for, and classes that are areas.
AREA_TYPES = ("borough", "city_district", "district", "suburb", "neighbourhood", "quarter", "postal_code")
AREA_CLASSES = ("place", "boundary", "landuse")

_HIT = "struct<osm_type: string, osm_id: string, class: string, type: string, name: string, display_name: string, lat: string, lon: string, boundingbox: array<string>, geojson: string>"


def _hits(answers: DataFrame, body: str, keep: tuple[str, ...]) -> DataFrame:
    """A row for each hit, with numbers parsed; hits without a proper box or centre are dropped."""
    rows = answers.select(*keep, F.posexplode(F.from_json(body, f"array<{_HIT}>")).alias("pos", "h"))
    box = F.transform("h.boundingbox", lambda x: x.try_cast("double"))
    rows = rows.withColumn("_box", box).withColumn("lat", F.col("h.lat").try_cast("double")).withColumn("lon", F.col("h.lon").try_cast("double"))
    rows = rows.filter((F.size("_box") == 4) & ~F.exists("_box", lambda x: x.isNull()) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return rows.withColumn("box", F.struct(F.col("_box")[0].alias("min_lat"), F.col("_box")[2].alias("min_lon"), F.col("_box")[1].alias("max_lat"), F.col("_box")[3].alias("max_lon"))).drop("_box")


def resolve(answers: DataFrame, query: str = "query", body: str = "body") -> DataFrame:
    """(query, display_name, box, lat, lon, type, provider_id, geojson) of each answer's first hit, if it is a proper one."""
    rows = _hits(answers, body, (query,)).filter("pos = 0")
    provider = F.concat_ws(":", filled(F.col("h.osm_type")), filled(F.col("h.osm_id")))
    return rows.select(query, F.coalesce(filled(F.col("h.display_name")), F.col(query)).alias("display_name"), "box", "lat", "lon", F.coalesce("h.type", F.lit("")).alias("type"), provider.alias("provider_id"), F.col("h.geojson").alias("geojson"))


def subareas(answers: DataFrame, parent: tuple[float, float, float, float], geometry: dict | None = None, most: int = 60, order: str = "request", body: str = "body") -> DataFrame:
    """(name, type, osm_id, box, lat, lon), the first `most` in order of request and hit: named areas, each osm_id once,
    boxes clipped to the parent's; the hit's centre, or else the clipped box's, must lie inside the parent."""
    h = _hits(answers, body, (order,)).filter(F.col("h.class").isin(*AREA_CLASSES) & filled(F.trim(F.col("h.name"))).isNotNull())
    clipped = F.struct(F.greatest("box.min_lat", F.lit(parent[0])).alias("min_lat"), F.greatest("box.min_lon", F.lit(parent[1])).alias("min_lon"), F.least("box.max_lat", F.lit(parent[2])).alias("max_lat"), F.least("box.max_lon", F.lit(parent[3])).alias("max_lon"))
    h = h.withColumn("box", clipped).filter("box.max_lat > box.min_lat AND box.max_lon > box.min_lon")
    mid_lat, mid_lon = (F.col("box.min_lat") + F.col("box.max_lat")) / 2, (F.col("box.min_lon") + F.col("box.max_lon")) / 2
    own, mid = (geo.in_location(a, o, parent, geometry) for a, o in ((F.col("lat"), F.col("lon")), (mid_lat, mid_lon)))
    h = h.withColumn("_lat", F.when(own, F.col("lat")).otherwise(mid_lat)).withColumn("_lon", F.when(own, F.col("lon")).otherwise(mid_lon)).filter(own | mid)
    key = F.coalesce(filled(F.col("h.osm_id")), F.concat_ws("/", F.col(order).cast("string"), F.col("pos").cast("string")))
    h = h.withColumn("_key", key).withColumn("_rn", F.row_number().over(Window.partitionBy("_key").orderBy(order, "pos"))).filter("_rn = 1")
    return h.orderBy(order, "pos").limit(most).select(F.trim("h.name").alias("name"), F.col("h.type").alias("type"), F.col("h.osm_id").alias("osm_id"), "box", F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))
