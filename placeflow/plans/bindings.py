"""The test tables as places, occurrences, cells, requests and sites.

The tables have no coordinates or contacts, so these are derived by integer arithmetic that Spark and
an SQL oracle do alike. Each binding has the same definition in SQL below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeflow.operators import shared

BOX = (36.0, -87.0, 36.4, -86.6)
FENCE = [(-86.95, 36.05), (-86.65, 36.1), (-86.7, 36.35), (-86.9, 36.3)]
HOLE = [(-86.85, 36.15), (-86.8, 36.15), (-86.8, 36.2), (-86.85, 36.2)]
GEOMETRY = {"type": "Polygon", "coordinates": [[list(p) for p in FENCE], [list(p) for p in HOLE]]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table of narrow rows from which long texts are made: dealt to all cores, as its file is read by one or two."""
    return shared.spread(table(spark, sf_dir, name), key)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, "customer", "c_custkey")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    dense = F.col("c_custkey") % 5 == 0
    a, b = F.col("c_custkey") * 7919 % 4000, F.col("c_custkey") * 104729 % 4000
    rows = c.select("c_custkey", F.concat(F.lit("P"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("place_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"), F.col("c_nationkey").cast("long").alias("city"), "c_acctbal", F.when(dense, F.floor(a / 16)).otherwise(a).cast("long").alias("a"), F.when(dense, F.floor(b / 16)).otherwise(b).cast("long").alias("b"))
    return rows.withColumn("lat", 36.0 + F.col("a") / 10000.0).withColumn("lon", -87.0 + F.col("b") / 10000.0)


PLACES = """places AS (
  SELECT c_custkey, 'P' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS place_id, c_name AS name, c_mktsegment AS category,
         CAST(c_nationkey AS BIGINT) AS city, c_acctbal, a, b, 36.0 + a / 10000.0 AS lat, -87.0 + b / 10000.0 AS lon
  FROM (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN (c_custkey * 7919 % 4000) // 16 ELSE c_custkey * 7919 % 4000 END AS a,
               CASE WHEN c_custkey % 5 = 0 THEN (c_custkey * 104729 % 4000) // 16 ELSE c_custkey * 104729 % 4000 END AS b
        FROM (SELECT c_custkey, c_name, c_mktsegment, c_nationkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer)))"""


def occurrences(spark: SparkSession, sf_dir: str, per_cell: int = 100, keys: int | None = None, cap: int | None = None) -> DataFrame:
    """(cell, page, rank, key): every order as a result of a search, `per_cell` orders a cell, twenty a page; with `cap`
    the pages that a search has at most. Keys are customers, or `keys` of them where they must repeat in a cell."""
    key = F.col("o_custkey") if keys is None else F.col("o_custkey") % keys
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / per_cell).cast("long").alias("cell"), key.alias("key"), F.col("o_orderkey").alias("rank"))
    n = F.row_number().over(Window.partitionBy("cell").orderBy("rank")) - 1
    rows = o.withColumn("page", F.floor(n / 20).cast("long"))
    return (rows if cap is None else rows.filter(F.col("page") < cap)).select("cell", "page", "rank", "key")


def occurrences_sql(per_cell: int = 100, keys: int | None = None, cap: int | None = None) -> str:
    return f"""occ AS (SELECT cell, CAST(n // 20 AS BIGINT) AS page, rank, key FROM (
      SELECT o_orderkey // {per_cell} AS cell, o_custkey{'' if keys is None else f' % {keys}'} AS key, o_orderkey AS rank,
             row_number() OVER (PARTITION BY o_orderkey // {per_cell} ORDER BY o_orderkey) - 1 AS n FROM orders){'' if cap is None else f' WHERE n // 20 < {cap}'})"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place_id, website, html): pages made from customers, with real, hidden-in-name, foreign and placeholder addresses."""
    p = places(spark, sf_dir)
    k = F.col("c_custkey").cast("string")
    website = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("www.shop"), k, F.lit(".com"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("https://shop"), k, F.lit(".com"))).when(F.col("c_custkey") % 4 == 2, F.lit("")).otherwise(F.concat(F.lit("http://www.shop"), k, F.lit(".com/")))
    html = F.concat(F.lit('<a href="mailto:Info@Shop'), k, F.lit('.com?subject=Hi">x</a> logo@2x.png sales%2Bx@shop'), k, F.lit(".com a"), k, F.lit("@gmail.com b@other"), k, F.lit('.org c@example.com <a href="https://www.facebook.com/sharer/s">s</a> <a href="https://www.facebook.com/shop'), k, F.lit('/?ref=1">f</a> <a href="https://x.com/shop'), k, F.lit('">t</a> <a href="/contact-us#top">c</a> <a href="about/team">a</a> <a href="/menu">m</a>'))
    return p.select("c_custkey", "place_id", website.alias("website"), html.alias("html"))


SITES = (
    PLACES
    + """, sites AS (
  SELECT c_custkey, place_id,
         CASE c_custkey % 4 WHEN 0 THEN 'www.shop' || k || '.com' WHEN 1 THEN 'https://shop' || k || '.com' WHEN 2 THEN '' ELSE 'http://www.shop' || k || '.com/' END AS website,
         '<a href="mailto:Info@Shop' || k || '.com?subject=Hi">x</a> logo@2x.png sales%2Bx@shop' || k || '.com a' || k || '@gmail.com b@other' || k || '.org c@example.com <a href="https://www.facebook.com/sharer/s">s</a> <a href="https://www.facebook.com/shop' || k || '/?ref=1">f</a> <a href="https://x.com/shop' || k || '">t</a> <a href="/contact-us#top">c</a> <a href="about/team">a</a> <a href="/menu">m</a>' AS html
  FROM (SELECT *, CAST(c_custkey AS VARCHAR) AS k FROM places))"""
)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, raw): recorded search responses of twenty places each, positional JSON behind a guard."""
    p = places(spark, sf_dir)

    def q(c) -> F.Column:
        return F.concat(F.lit('"'), c, F.lit('"'))

    slots = {0: q(F.concat(F.lit("D"), F.col("c_custkey").cast("string"))), 4: F.concat(F.lit("[null,null,null,null,null,null,null,"), (F.col("c_custkey") % 50 / 10.0).cast("string"), F.lit(","), (F.col("c_custkey") % 300).cast("string"), F.lit("]")), 7: F.concat(F.lit('["https://shop'), F.col("c_custkey").cast("string"), F.lit('.com"]')), 9: F.concat(F.lit("[null,null,"), F.col("a").cast("string"), F.lit(","), F.col("b").cast("string"), F.lit("]")), 10: q(F.concat(F.lit("0x"), F.col("c_custkey").cast("string"))), 11: q(F.col("name")), 13: F.concat(F.lit("["), q(F.col("category")), F.lit("]")), 18: q(F.concat(F.col("category"), F.lit(" street"))), 78: F.when(F.col("c_custkey") % 25 != 0, q(F.col("place_id"))).otherwise(F.lit("null"))}
    body = F.concat(F.lit("["), F.concat_ws(",", *(slots.get(i, F.lit("null")) for i in range(79))), F.lit("]"))
    entry = F.concat(F.lit("[null,null,null,null,null,null,null,null,null,null,null,null,null,null,"), body, F.lit("]"))
    page = F.floor(F.col("c_custkey") / 20).cast("long")
    pages = p.select(page.alias("page"), F.struct("c_custkey", entry.alias("e")).alias("x")).groupBy("page").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return pages.select("page", F.concat(F.lit(")]}'\n[[\"q\",[\"meta\","), F.array_join(F.transform("xs", lambda x: x["e"]), ","), F.lit("]]]")).alias("raw"))


def grid_pages(spark: SparkSession, sf_dir: str, cell_km: float = 5.0) -> DataFrame:
    """Recorded pages of a grid over BOX and of its children: a place is shown by its cell of each size, twenty a page
    and six pages a cell at most, and every ninth place also by the next cell to the east."""
    from placeflow.functions import geo
    from placeflow.operators import grid

    rows = None
    dlat, dlon = grid.steps(BOX, cell_km)
    for half in (1, 2):
        a, o = dlat / half, dlon / half
        own = places(spark, sf_dir).select("c_custkey", F.col("place_id").alias("key"), "lat", "lon", F.floor((F.col("lat") - BOX[0]) / a).alias("i"), F.floor((F.col("lon") - BOX[1]) / o).alias("j"))
        own = own.unionByName(own.filter("c_custkey % 9 = 0").withColumn("j", F.col("j") + 1))
        keyed = own.withColumn("cell_key", geo.cell_key(BOX[0] + (F.col("i") + 0.5) * a, BOX[1] + (F.col("j") + 0.5) * o))
        rows = keyed if rows is None else rows.unionByName(keyed)
    n = F.row_number().over(Window.partitionBy("cell_key").orderBy("c_custkey")) - 1
    return rows.withColumn("n", n).filter("n < 120").select("cell_key", F.floor(F.col("n") / 20).cast("int").alias("page"), F.pmod("n", F.lit(20)).cast("int").alias("rank"), "key", "lat", "lon")


def overlapping_pages(spark: SparkSession, sf_dir: str, cell_km: float = 5.0) -> DataFrame:
    """Recorded pages of a grid over BOX whose cells overlap: a place is shown by its cell and by the next ones to the
    north, the east and the north-east, in an order of the cell's own. The second page of every eleventh cell was refused."""
    from placeflow.functions import geo
    from placeflow.operators import grid

    dlat, dlon = grid.steps(BOX, cell_km)
    own = places(spark, sf_dir).select("c_custkey", F.col("place_id").alias("key"), "lat", "lon", F.floor((F.col("lat") - BOX[0]) / dlat).alias("i0"), F.floor((F.col("lon") - BOX[1]) / dlon).alias("j0"))
    corners = F.array(*(F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u in (0, 1) for v in (0, 1)))
    rows = own.withColumn("at", F.explode(corners)).withColumn("i", F.col("i0") + F.col("at.u")).withColumn("j", F.col("j0") + F.col("at.v"))
    rows = rows.withColumn("cell_key", geo.cell_key(BOX[0] + (F.col("i") + 0.5) * dlat, BOX[1] + (F.col("j") + 0.5) * dlon))
    n = F.row_number().over(Window.partitionBy("cell_key").orderBy((F.col("c_custkey") * 31 + F.col("i") * 97) % 1009, "c_custkey")) - 1
    rows = rows.withColumn("n", n).filter("n < 120").withColumn("page", F.floor(F.col("n") / 20).cast("int"))
    error = F.when(((F.col("i") * 7 + F.col("j") * 3) % 11 == 0) & (F.col("page") == 1), F.lit("TimeoutError"))
    return rows.select("cell_key", "page", F.pmod("n", F.lit(20)).cast("int").alias("rank"), "key", "lat", "lon", error.alias("error"))


def _listed(slots: dict[int, Column]) -> Column:
    """The text of a JSON list with these items and nulls between them."""
    parts, last = [F.lit("[")], -1
    for i in sorted(slots):
        parts += [F.lit("," * (last >= 0) + "null," * (i - last - 1)), slots[i]]
        last = i
    return F.concat(*parts, F.lit("]"))


def _quoted(*parts: Column | str) -> Column:
    return F.concat(F.lit('"'), *(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit('"'))


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, response): a recorded details response of every place, positional JSON decoded to VARIANT."""
    k = F.col("c_custkey").cast("string")

    def of(template: str) -> Column:
        """The template with the place's number for #."""
        return F.replace(F.lit(template), F.lit("#"), k)

    slots = {
        0: of('"D#"'), 2: of('["# Old St","Oldtown"]'), 4: F.concat(F.lit('[null,null,"$$",["http://r"],null,null,null,'), (F.col("c_custkey") % 50 / 10.0).cast("string"), F.lit(","), (F.col("c_custkey") % 300).cast("string"), F.lit("]")),
        9: F.concat(F.lit("[null,null,"), F.col("a").cast("string"), F.lit(","), F.col("b").cast("string"), F.lit("]")), 10: of('"0x#"'), 11: F.when(F.col("c_custkey") % 3 == 0, F.lit('""')).otherwise(of('"Shop # Inc"')),
        13: F.concat(F.lit("["), _quoted(F.col("category")), F.lit(',"Shop"]')), 14: of('"Hood #"'), 18: of('"# Main St, Nashville"'), 30: F.lit('"America/Chicago"'), 36: of('[["ref#","http://p/#"]]'), 38: of('["http://menu/#","Menu"]'),
        46: of('[["http://book/#","Book"]]'), 57: of('["#","Owner #","http://o/#"]'), 72: of('[[[null,null,null,null,null,null,["http://t/#"]]]]'), 78: _quoted(F.col("place_id")),
        100: F.lit('[null,[["Service",[["Delivery",true],["Pickup",0]]],["Credit cards",["Visa","MC"]]]]'), 116: F.lit("2"), 171: of('[[null,null,"Street View",[[null,null,null,null,null,null,["http://sv/#"]]]],[null,null,"All",[[null,null,null,null,null,null,["http://i/#"]]]]]'),
        175: F.concat(F.lit("[null,null,null,[3,0,null,"), (F.col("c_custkey") % 7).cast("string"), F.lit(",10]]")), 178: of('[["555-#"]]'), 183: of('[null,["Boro","# Main St",null,"Nashville","37-#","TN","US"],[null,null,["PLUS#"]]]'),
        203: of('[[["Mon",1,null,[["9-12"],["13-#"]]],["Tue",2,null,[["9-17"]]],["Mon",1,null,[["20-22"]]]]]'),
    }
    body = F.concat(F.lit("[null,null,null,null,null,null,"), _listed(slots), F.lit("]"))
    # Written, as a filter on what is parsed would else move ahead of the dealing, and the parsing with it.
    rows = shared.kept(places(spark, sf_dir).select("c_custkey", "place_id", "category", "a", "b"), shared.folder(spark, "details"))
    return rows.select("c_custkey", F.parse_json(body).alias("response"))


def moved_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, response): search responses of a changed layout, each field at another position."""
    k = F.col("c_custkey").cast("string")
    moved = {40: _quoted(F.col("name")), 41: _quoted("0x", k), 43: _quoted("D", k), 44: _quoted(k, " ", F.col("category"), " street"), 46: F.concat(F.lit("["), _quoted("https://shop", k, ".com"), F.lit("]")), 50: F.concat(F.lit("[null,null,"), (F.col("a") + 0.25).cast("string"), F.lit(","), (F.col("b") + 0.75).cast("string"), F.lit("]")), 80: _quoted(F.col("place_id"))}
    entry = _listed({14: _listed(moved)})
    rows = places(spark, sf_dir).select(F.floor(F.col("c_custkey") / 20).cast("long").alias("page"), F.struct("c_custkey", entry.alias("e")).alias("x")).groupBy("page").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return rows.select("page", F.parse_json(F.concat(F.lit('[["q",["meta",'), F.array_join(F.transform("xs", lambda x: x["e"]), ","), F.lit("]]]"))).alias("response"))


def geocoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request, query, body): a geocoder's answer for every customer, one hit each; every seventh isn't an area, and some
    lie outside BOX in part or whole."""
    k = F.col("c_custkey")
    south, west = 35.9 + (k * 31 % 500) / 1000.0, -87.1 + (k * 17 % 500) / 1000.0
    hit = F.struct(F.lit("node").alias("osm_type"), (k % 900).cast("string").alias("osm_id"), F.when(k % 7 == 0, "shop").otherwise("place").alias("class"), F.lit("suburb").alias("type"), F.col("c_name").alias("name"), F.concat(F.col("c_name"), F.lit(", TN")).alias("display_name"), (south + 0.01).cast("string").alias("lat"), (west + 0.01).cast("string").alias("lon"), F.transform(F.array(south, south + 0.02, west, west + 0.02), lambda x: x.cast("string")).alias("boundingbox"))
    return customers(spark, sf_dir).select(k.alias("request"), F.concat(F.lit("area "), k.cast("string")).alias("query"), F.to_json(F.array(hit)).alias("body"))


#: Corners of the areas' rings, in units of an area's size around its centre: (part, ring, u, v).
AREA_RINGS = {
    (0, 0): [(4, 0), (1, 1), (0, 4), (-1, 1), (-4, 0), (-1, -1), (0, -4), (1, -1)],
    (0, 1): [(1, 0), (0, 1), (-1, 0), (0, -1)],
    (1, 0): [(5, -1), (7, -1), (7, 1), (5, 1)],
}


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, geometry): an area for each supplier, a star with a hole, and for every third a MultiPolygon with a square beside it."""
    s = F.col("s_suppkey")
    size = 50 + s * 13 % 300
    east, north = s * 7919 % 4000, s * 104729 % 4000

    def ring(part: int, hole: int) -> Column:
        scale = F.floor(size / 2) if hole else size
        points = [F.concat(F.lit("["), (-87.0 + (east + u * scale) / 10000.0).cast("string"), F.lit(","), (36.0 + (north + v * scale) / 10000.0).cast("string"), F.lit("]")) for u, v in AREA_RINGS[part, hole]]
        return F.concat(F.lit("["), F.concat_ws(",", *points), F.lit("]"))

    star = F.concat(F.lit("["), ring(0, 0), F.lit(","), ring(0, 1), F.lit("]"))
    one = F.concat(F.lit('{"type":"Polygon","coordinates":'), star, F.lit("}"))
    two = F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), star, F.lit(",["), ring(1, 0), F.lit("]]}"))
    return table(spark, sf_dir, "supplier").select(s.alias("region"), F.when(s % 3 == 0, two).otherwise(one).alias("geometry"))


AREAS = f"""corners(part, ring, k, n, u, v) AS (VALUES {', '.join(f'({p}, {r}, {k}, {len(c)}, {u}, {v})' for (p, r), c in AREA_RINGS.items() for k, (u, v) in enumerate(c))}),
sized AS (SELECT s_suppkey AS region, 50 + s_suppkey * 13 % 300 AS size, s_suppkey * 7919 % 4000 AS east, s_suppkey * 104729 % 4000 AS north FROM supplier),
points AS (SELECT region, part, ring, k, n, -87.0::DOUBLE + (east + u * CASE ring WHEN 0 THEN size ELSE size // 2 END) / 10000.0::DOUBLE AS x, 36.0::DOUBLE + (north + v * CASE ring WHEN 0 THEN size ELSE size // 2 END) / 10000.0::DOUBLE AS y
           FROM sized CROSS JOIN corners WHERE part = 0 OR region % 3 = 0),
sides AS (SELECT b.region, b.part, b.ring, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM points b JOIN points a ON a.region = b.region AND a.part = b.part AND a.ring = b.ring AND a.k = (b.k + b.n - 1) % b.n)"""
