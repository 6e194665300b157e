"""Every operator as a query over the test tables, with SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeflow import sql
from placeflow.api import Places
from placeflow.functions import contacts, decode, geo, keys, pb, requests
from placeflow.operators import collect, discover, enrich, folds, grid, locations, metrics, parse, quality, regions, reports, shared
from placeflow.plans import bindings as b
from placeflow.sources import recorded, sink
from placeflow.streaming import collect as streaming
from placeflow.streaming import state
from placeflow.plans.bindings import BOX, FENCE, GEOMETRY, HOLE, PLACES, SITES, occurrences, occurrences_sql, places, responses, sites, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(call: Query) -> Query:
        QUERIES[call.__name__] = call
        if sql is not None:
            ORACLE_SQL[call.__name__] = sql
        return call

    return add


# Tilings

_DLAT = "2.0 / 111.32"
_DLON = "2.0 / (111.32 * cos(radians(36.2)))"
_GRID = f"SELECT i, j, 36.0 + (i + 0.5) * {_DLAT} AS lat, -87.0 + (j + 0.5) * {_DLON} AS lon FROM (SELECT unnest(range(400)) AS i) CROSS JOIN (SELECT unnest(range(400)) AS j) WHERE 36.0 + (i + 0.5) * {_DLAT} < 36.4 AND -87.0 + (j + 0.5) * {_DLON} < -86.6"
_HAVERSINE = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


_BOXES = f"""{PLACES}, bx AS (SELECT city, min(lat) AS s, min(lon) AS w, max(lat) AS n, max(lon) AS e FROM places GROUP BY city)"""
_CITY_CELLS = """{name} AS (SELECT * EXCLUDE (lat, lon), lat, lon FROM (
  SELECT *, s + (i + 0.5) * dlat AS lat, w + (j + 0.5) * dlon AS lon FROM (SELECT *, {km} / 111.32 AS dlat, {km} / (111.32 * greatest(cos(radians((s + n) / 2)), 1e-6)) AS dlon FROM {boxes})
  CROSS JOIN (SELECT unnest(range(60)) AS i) CROSS JOIN (SELECT unnest(range(60)) AS j)) WHERE lat < n AND lon < e)"""


@query(f"""WITH {_BOXES}, {_CITY_CELLS.format(name='c', km='2.0', boxes='bx')}
SELECT city, i, j, round(lat, 6) AS lat, round(lon, 6) AS lon FROM c UNION ALL SELECT city, 0, 0, round((s + n) / 2, 6), round((w + e) / 2, 6) FROM bx WHERE city NOT IN (SELECT city FROM c)""")
def cells_grid(spark, sf_dir):
    """The grid over each city's own box."""
    cells = grid.cells_of(grid.boxes_of(places(spark, sf_dir), "city"), F.lit(2.0))
    return cells.select("city", "i", "j", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"""WITH {_BOXES}, z AS (SELECT *, exp(ln(1.0) + lvl / 2.0 * (ln(10.0) - ln(1.0))) AS km FROM bx CROSS JOIN (SELECT unnest(range(3)) AS lvl)), {_CITY_CELLS.format(name='c', km='km', boxes='z')},
u AS (SELECT city, lvl, i, j, lat, lon FROM c UNION ALL SELECT city, lvl, 0, 0, (s + n) / 2, (w + e) / 2 FROM z WHERE (city, lvl) NOT IN (SELECT (city, lvl) FROM c)),
k AS (SELECT *, row_number() OVER (PARTITION BY city, round(lat, 6), round(lon, 6) ORDER BY lvl, i, j) AS rn FROM u)
SELECT city, CAST(lvl AS INTEGER) AS level, count(*) AS n FROM k WHERE rn = 1 GROUP BY city, lvl""")
def cells_zoom_levels(spark, sf_dir):
    return grid.zoom_cells_of(grid.boxes_of(places(spark, sf_dir), "city"), ("city",)).groupBy("city", "level").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_BOXES}, k AS (SELECT city, km, CAST(ceil((n - s) / (km / 111.32)) * ceil((e - w) / (km / (111.32 * greatest(cos(radians((s + n) / 2)), 1e-6)))) AS BIGINT) AS cells
  FROM bx CROSS JOIN (SELECT unnest([0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 10.0, 15.0, 20.0, 50.0, 100.0])::DOUBLE AS km))
SELECT *, km IS NOT DISTINCT FROM min(km) FILTER (WHERE cells <= 100) OVER (PARTITION BY city) AS chosen FROM k""")
def cell_estimate_ladder(spark, sf_dir):
    return grid.estimates_of(grid.boxes_of(places(spark, sf_dir), "city"), 100).select("city", "km", "cells", "chosen")


@query(f"""WITH {PLACES} SELECT city, printf('%.6f,%.6f', round(lat, 1), round(lon, 1)) AS cell, count(*) AS n, round(sum({_HAVERSINE.format(lat1='lat', lon1='lon', lat2='36.2', lon2='-86.8')}), 1) AS metres, count(*) FILTER (WHERE lat BETWEEN 36.1 AND 36.3 AND lon BETWEEN -86.9 AND -86.7) AS inside,
  (SELECT count(*) FROM ({_GRID})) AS cells, round(5 / 2.0 * sqrt(2) * 1000 * 1.5, 3) AS radius FROM places GROUP BY ALL""")
def sql_functions(spark, sf_dir):
    """The library called from SQL text: scalar functions and a table function."""
    sql.register(spark)
    return spark.sql(
        """SELECT city, pf_cell_key(round(lat, 1), round(lon, 1)) AS cell, count(*) AS n, round(sum(pf_haversine(lat, lon, 36.2D, -86.8D)), 1) AS metres,
                  count_if(pf_in_box(lat, lon, 36.1D, -86.9D, 36.3D, -86.7D)) AS inside, (SELECT count(*) FROM pf_cells(36.0D, -87.0D, 36.4D, -86.6D, 2.0D)) AS cells, round(pf_accept_radius(5.0D), 3) AS radius
           FROM {places} GROUP BY ALL""",
        places=places(spark, sf_dir),
    )


@query("""SELECT c_custkey, replace(lower(replace(CASE c_custkey % 3 WHEN 0 THEN c_name || ' STRASSE' WHEN 1 THEN replace(c_name, 'Customer', 'Fußball') || ' Straße' ELSE c_name || ' ΣΟΦΟΣ' END, 'ß', 'ss')), 'ς', 'σ') || '|' || lower(c_mktsegment) || '|1.5|2.5' AS key FROM customer""")
def folded_keys(spark, sf_dir):
    """Keys of places without ids: sharp s and ss, and both sigmas, are one."""
    k, name = F.col("c_custkey"), F.col("c_name")
    name = F.when(k % 3 == 0, F.concat(name, F.lit(" STRASSE"))).when(k % 3 == 1, F.concat(F.replace(name, F.lit("Customer"), F.lit("Fußball")), F.lit(" Straße"))).otherwise(F.concat(name, F.lit(" ΣΟΦΟΣ")))
    empty = F.lit("")
    return table(spark, sf_dir, "customer").select("c_custkey", keys.dedup_key(empty, empty, empty, name, F.col("c_mktsegment"), F.lit(1.5), F.lit(2.5)).alias("key"))


@query(f"WITH {PLACES} SELECT city, count(*) AS n FROM places WHERE lat BETWEEN 36.1 AND 36.3 AND lon BETWEEN -86.9 AND -86.7 GROUP BY city")
def bbox_fence(spark, sf_dir):
    return places(spark, sf_dir).filter(geo.in_box(F.col("lat"), F.col("lon"), (36.1, -86.9, 36.3, -86.7))).groupBy("city").agg(F.count(F.lit(1)).alias("n"))


def _ring_sql(ring: list[tuple[float, float]]) -> str:
    edges = zip(ring, [*ring[-1:], *ring[:-1]], strict=True)
    return "(" + " + ".join(f"CASE WHEN (({y1} > lat) <> ({y2} > lat)) AND lon < ({x2} - ({x1})) * (lat - {y1}) / ({y2} - {y1}) + ({x1}) THEN 1 ELSE 0 END" if y1 != y2 else "0" for (x1, y1), (x2, y2) in edges) + ") % 2"


@query(f"WITH {PLACES} SELECT place_id FROM places WHERE {_ring_sql(FENCE)} = 1 AND {_ring_sql(HOLE)} = 0")
def polygon_fence(spark, sf_dir):
    return places(spark, sf_dir).filter(geo.in_geometry(F.col("lat"), F.col("lon"), GEOMETRY)).select("place_id")


_IN_AREAS = f"""WITH {PLACES}, {b.AREAS},
met AS (SELECT c_custkey, region, part, ring FROM places JOIN sides ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY c_custkey, region, part, ring HAVING count(*) % 2 = 1),
found AS (SELECT DISTINCT c_custkey, region FROM (SELECT c_custkey, region, bool_or(ring = 0) AND NOT bool_or(ring > 0) AS within FROM met GROUP BY c_custkey, region, part) WHERE within)"""


@query(f"{_IN_AREAS} SELECT c_custkey, region FROM found")
def polygon_join(spark, sf_dir):
    """Places in the areas of a table: polygons with holes and several parts, met by cells and tested at borders alone."""
    return regions.join(places(spark, sf_dir), b.areas(spark, sf_dir), 0.01).select("c_custkey", "region")


@query(f"{_IN_AREAS} SELECT c.c_custkey, f.region FROM customer c LEFT JOIN found f USING (c_custkey)")
def polygon_join_left(spark, sf_dir):
    """The same on a coarse grid, with the places that no area holds."""
    return regions.join(places(spark, sf_dir), b.areas(spark, sf_dir), 0.1, how="left").select("c_custkey", "region")




@query(f"WITH {PLACES}, d AS (SELECT place_id, {_HAVERSINE.format(lat1='lat', lon1='lon', lat2='36.2', lon2='-86.8')} AS m FROM places) SELECT place_id, round(m, 1) AS metres, m <= 20 / 2.0 * sqrt(2) * 1000 * 1.5 AS kept FROM d")
def haversine_footprint(spark, sf_dir):
    m = geo.haversine(F.col("lat"), F.col("lon"), F.lit(36.2), F.lit(-86.8))
    return places(spark, sf_dir).select("place_id", F.round(m, 1).alias("metres"), (m <= geo.accept_radius(F.lit(20.0))).alias("kept"))


@query(f"WITH c AS ({_GRID}) SELECT 'some' AS fence, i, j FROM c WHERE lat BETWEEN 36.1 AND 36.2 AND lon BETWEEN -86.9 AND -86.8 UNION ALL SELECT 'none', i, j FROM c")
def seed_fence_fallback(spark, sf_dir):
    cells = grid.generate_cells(spark, BOX, 2.0)
    some = grid.fence_with_fallback(cells, geo.in_box(F.col("lat"), F.col("lon"), (36.1, -86.9, 36.2, -86.8)))
    none = grid.fence_with_fallback(cells, geo.in_box(F.col("lat"), F.col("lon"), (0.0, 0.0, 1.0, 1.0)))
    return some.select(F.lit("some").alias("fence"), "i", "j").union(none.select(F.lit("none"), "i", "j"))


@query(f"""WITH {PLACES}, occ AS (SELECT o_custkey, min(o_orderkey) AS first_order, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT CAST(floor((lat - 36.0) / ({_DLAT})) AS BIGINT) AS i, CAST(floor((lon + 87.0) / ({_DLON})) AS BIGINT) AS j, count(*) AS places, CAST(sum(n) AS BIGINT) AS occurrences, min(first_order) AS first_order
FROM places JOIN occ ON c_custkey = o_custkey WHERE lat BETWEEN 36.05 AND 36.35 AND lon BETWEEN -86.95 AND -86.65 GROUP BY 1, 2""")
def cell_assign_counts(spark, sf_dir):
    """Places fenced, deduplicated over their occurrences and counted by cell; orders are pre-aggregated before the join."""
    fenced = places(spark, sf_dir).filter(geo.in_box(F.col("lat"), F.col("lon"), (36.05, -86.95, 36.35, -86.65)))
    occ = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"), F.count(F.lit(1)).alias("n"))
    rows = grid.assign_cells(fenced, BOX, 2.0).join(occ, F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy("i", "j").agg(F.count(F.lit(1)).alias("places"), F.sum("n").alias("occurrences"), F.min("first_order").alias("first_order"))


_TREE = f"""WITH RECURSIVE {PLACES}, lv AS (SELECT unnest(range(7)) AS d),
n AS (SELECT d, a >> CAST(12 - d AS INTEGER) AS r, b >> CAST(12 - d AS INTEGER) AS c, count(*) AS n FROM places CROSS JOIN lv GROUP BY 1, 2, 3),
s AS (SELECT *, n >= 120 AND d < 6 AND 44.5 / pow(2, d + 1) >= 0.2 AS splits FROM n),
tree AS (SELECT s.* FROM s WHERE d = 0 UNION ALL SELECT s.* FROM s JOIN tree t ON s.d = t.d + 1 AND s.r >> 1 = t.r AND s.c >> 1 = t.c AND t.splits)"""


def _tree(spark, sf_dir):
    return grid.quadtree(places(spark, sf_dir), F.col("a"), F.col("b"))


@query(f"{_TREE} SELECT CAST(d AS INTEGER) AS depth, r AS row, c AS col, CAST(n AS BIGINT) AS n FROM tree WHERE NOT splits")
def quadtree_leaves(spark, sf_dir):
    return _tree(spark, sf_dir).filter("NOT splits").select("depth", "row", "col", "n")


@query(f"{_TREE} SELECT count(*) AS searched, count(*) FILTER (WHERE splits) AS subdivided, count(*) FILTER (WHERE n >= 120 AND NOT splits) AS saturated, count(*) FILTER (WHERE NOT splits) AS leaves, CAST(max(d) AS INTEGER) AS max_depth FROM tree")
def quadtree_report(spark, sf_dir):
    t = _tree(spark, sf_dir)
    return t.agg(F.count(F.lit(1)).alias("searched"), F.count_if("splits").alias("subdivided"), F.count_if((F.col("n") >= 120) & ~F.col("splits")).alias("saturated"), F.count_if(~F.col("splits")).alias("leaves"), F.max("depth").alias("max_depth"))


@query(f"WITH {PLACES}, c AS ({_GRID}) SELECT i, j FROM c WHERE NOT EXISTS (SELECT 1 FROM places p WHERE {_HAVERSINE.format(lat1='c.lat', lon1='c.lon', lat2='p.lat', lon2='p.lon')} <= 250)")
def gap_cells_anti(spark, sf_dir):
    return grid.uncovered_cells(grid.generate_cells(spark, BOX, 2.0), places(spark, sf_dir), 0.25, BOX).select("i", "j")


# Discovery


@query(f"WITH {occurrences_sql()} SELECT key, cell, page, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cell, page, rank) AS rn FROM occ) WHERE rn = 1")
def dedup_first_wins(spark, sf_dir):
    return discover.first_wins(occurrences(spark, sf_dir)).select("key", "cell", "page", "rank")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'P' || c_custkey WHEN c_custkey % 4 = 1 THEN '0x' || c_custkey WHEN c_custkey % 4 = 2 THEN 'C' || c_custkey
ELSE lower(c_name) || '|' || lower(c_mktsegment) || '|' || CASE WHEN c_custkey % 8 = 3 THEN 'None|None' ELSE '36.5|-87.25' END END AS key FROM customer""")
def dedup_key_fallback(spark, sf_dir):
    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    lat = F.when(k % 8 != 3, F.lit(36.5))
    lon = F.when(k % 8 != 3, F.lit(-87.25))
    key = keys.dedup_key(F.when(k % 4 == 0, F.concat(F.lit("P"), text)).otherwise(""), F.when(k % 4 == 1, F.concat(F.lit("0x"), text)), F.when(k % 4 == 2, F.concat(F.lit("C"), text)).otherwise(""), F.col("c_name"), F.col("c_mktsegment"), lat, lon)
    return table(spark, sf_dir, "customer").select("c_custkey", key.alias("key"))


@query(f"WITH {occurrences_sql()} SELECT key, string_agg(CAST(cell AS VARCHAR), ',' ORDER BY cell) AS cells, min(cell) AS first_cell FROM (SELECT DISTINCT key, cell FROM occ) GROUP BY key")
def provenance_cells(spark, sf_dir):
    return discover.provenance(occurrences(spark, sf_dir)).select("key", F.concat_ws(",", F.col("cells").cast("array<string>")).alias("cells"), "first_cell")


_NEW = "p AS (SELECT cell, page, count(*) AS n, count(*) FILTER (WHERE rn = 1) AS new FROM (SELECT *, row_number() OVER (PARTITION BY cell, key ORDER BY page, rank) AS rn FROM occ) GROUP BY cell, page)"


@query(f"WITH {occurrences_sql(150, 40, 6)}, {_NEW} SELECT cell, page, n, new FROM p")
def page_new_counts(spark, sf_dir):
    return discover.page_novelty(occurrences(spark, sf_dir, 150, 40, 6))


@query(f"WITH {occurrences_sql(150, 40, 6)}, {_NEW} SELECT cell, coalesce(min(page) FILTER (WHERE new = 0), -1) AS stop_page, max(page) AS last_page FROM p GROUP BY cell")
def paginate_cutoff(spark, sf_dir):
    return discover.page_stops(occurrences(spark, sf_dir, 150, 40, 6)).withColumn("stop_page", F.coalesce("stop_page", F.lit(-1).cast("long")))


@query(f"""WITH {occurrences_sql(150, 40, 6)}, {_NEW}, s AS (SELECT cell, min(page) FILTER (WHERE new = 0 OR n < 20) AS stop FROM p GROUP BY cell)
SELECT cell, key, min(rank) AS rank FROM occ JOIN s USING (cell) WHERE stop IS NULL OR page <= stop GROUP BY cell, key""")
def paginate_rows(spark, sf_dir):
    return discover.paginate(occurrences(spark, sf_dir, 150, 40, 6), full_page=20).select("cell", "key", "rank")


@query(f"WITH {occurrences_sql()}, f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cell, page, rank) AS rn FROM occ) SELECT key, cell, rank FROM f WHERE rn = 1 ORDER BY cell, page, rank LIMIT 100")
def global_cap(spark, sf_dir):
    return discover.global_cap(occurrences(spark, sf_dir), 100).select("key", "cell", "rank")


@query("""WITH c AS (SELECT o_custkey AS seq, CASE WHEN sum(o_totalprice) > 1000000 AND o_custkey % 3 = 0 THEN 1 ELSE 0 END AS kept FROM orders GROUP BY o_custkey),
r AS (SELECT *, sum(kept) OVER w AS k, count(*) OVER w AS n FROM c WINDOW w AS (ORDER BY seq ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
s AS (SELECT min(seq) AS stop FROM r WHERE n = 12 AND k = 0) SELECT seq, CAST(kept AS INTEGER) AS kept FROM c, s WHERE stop IS NULL OR seq <= stop""")
def empty_streak_stop(spark, sf_dir):
    cells = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.when((F.sum("o_totalprice") > 1000000) & (F.col("custkey") % 3 == 0), 1).otherwise(0).alias("kept"))
    return discover.empty_streak(collect.dense_ranks(cells, F.col("custkey")).withColumnsRenamed({"seq": "_n"}).withColumn("seq", F.col("custkey")), seq="_n").select("seq", "kept")


@query("WITH c AS (SELECT DISTINCT o_orderkey % 500 AS cell_key FROM orders), d AS (SELECT DISTINCT o_orderkey % 500 AS cell_key FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 500 % 7 < 3) SELECT cell_key FROM c WHERE cell_key NOT IN (SELECT cell_key FROM d)")
def resume_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("cell_key", F.col("o_orderkey") % 500)
    return discover.resume(o.select("cell_key").distinct(), o.filter("o_orderstatus = 'F' AND cell_key % 7 < 3"))


@query(f"WITH {occurrences_sql()}, two AS (SELECT 0 AS pass, * FROM occ WHERE cell % 10 < 6 UNION ALL SELECT 1, * FROM occ WHERE cell % 10 >= 3), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pass, cell, page, rank) AS rn FROM two) SELECT CAST(pass AS INTEGER) AS pass, key, cell, rank FROM f WHERE rn = 1")
def pass_union_merge(spark, sf_dir):
    occ = occurrences(spark, sf_dir)
    return discover.merge_passes([occ.filter("cell % 10 < 6"), occ.filter("cell % 10 >= 3")]).select("pass", "key", "cell", "rank")


@query(f"""WITH {occurrences_sql()}, r AS (SELECT cell, page, rank, key, rank AS seq FROM occ), s AS (SELECT *, max(seq) OVER (PARTITION BY key) AS l, min(seq) OVER (PARTITION BY key) AS f FROM r WHERE cell % 10 < 3)
SELECT key, rank, f AS position, 'snapshot' AS origin FROM s WHERE seq = l UNION ALL
SELECT key, min(rank), min(seq), 'lines' FROM r WHERE cell % 10 >= 1 AND key NOT IN (SELECT key FROM s) GROUP BY key""")
def snapshot_precedence(spark, sf_dir):
    rows = occurrences(spark, sf_dir).withColumn("seq", F.col("rank"))
    return discover.snapshot_precedence(rows.filter("cell % 10 < 3"), rows.filter("cell % 10 >= 1")).select("key", "rank", "position", "origin")


@query(f"""WITH {occurrences_sql(150, 4000)}, seen AS (SELECT DISTINCT key FROM occ WHERE cell % 10 < 2), {_NEW}, s AS (SELECT cell, min(page) FILTER (WHERE new = 0 OR n < 20) AS stop FROM (SELECT * FROM p WHERE page < 2 AND cell % 10 >= 2) GROUP BY cell),
rd AS (SELECT cell, key, min(page) AS page, min(rank) AS rank FROM occ JOIN s USING (cell) WHERE page < 2 AND (stop IS NULL OR page <= stop) GROUP BY cell, key)
SELECT key, min(cell) AS cell FROM rd WHERE key NOT IN (SELECT key FROM seen) GROUP BY key""")
def diversity_pass(spark, sf_dir):
    occ = occurrences(spark, sf_dir, 150, 4000)
    return discover.diversity_pass(occ.filter("cell % 10 >= 2"), occ.filter("cell % 10 < 2"))[0].select("key", "cell")


@query(f"""WITH {PLACES}, r AS (SELECT CASE WHEN NOT (lat BETWEEN 36.05 AND 36.35 AND lon BETWEEN -86.95 AND -86.65) THEN 'b' WHEN {_HAVERSINE.format(lat1='lat', lon1='lon', lat2='36.2', lon2='-86.8')} > 20 / 2.0 * sqrt(2) * 1000 * 1.0 THEN 'f' END AS why, c_custkey % 700 AS key FROM places)
SELECT count(*) AS raw, count(*) FILTER (WHERE why = 'b') AS outside_boundary, count(*) FILTER (WHERE why = 'f') AS outside_footprint, count(DISTINCT key) FILTER (WHERE why IS NULL) AS kept, count(*) FILTER (WHERE why IS NULL) - count(DISTINCT key) FILTER (WHERE why IS NULL) AS duplicates FROM r""")
def discovery_counters(spark, sf_dir):
    rows = places(spark, sf_dir).select(F.lit(0).alias("cell"), F.lit(0).alias("page"), F.col("c_custkey").alias("rank"), (F.col("c_custkey") % 700).alias("key"), "lat", "lon")
    lat, lon = F.col("lat"), F.col("lon")
    return discover.cell_results(rows, geo.in_box(lat, lon, (36.05, -86.95, 36.35, -86.65)), geo.haversine(lat, lon, F.lit(36.2), F.lit(-86.8)) <= geo.accept_radius(F.lit(20.0), 1.0))[1]


@query(f"""WITH {occurrences_sql(150, None, 6)}, f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cell, page, rank) AS rn FROM occ),
p AS (SELECT cell, page, count(*) AS n, count(*) FILTER (WHERE rn = 1) AS k FROM f GROUP BY cell, page), c AS (SELECT cell, sum(n) AS raw, count(*) FILTER (WHERE n = 20) AS full_pages, sum(k) AS kept FROM p GROUP BY cell)
SELECT cell, CAST(raw AS BIGINT) AS raw, full_pages, CAST(kept AS BIGINT) AS kept, raw >= 120 OR full_pages >= 6 AS saturated, (raw >= 120 OR full_pages >= 6) AND kept >= 24 AND 1 < 4 AS splits FROM c""")
def split_decisions(spark, sf_dir):
    pages = discover.page_novelty(occurrences(spark, sf_dir, 150, None, 6), scope=())
    cells = pages.groupBy("cell").agg(F.sum("n").alias("raw"), F.count_if(F.col("n") == 20).alias("full_pages"), F.sum("new").alias("kept"), F.lit(1).alias("depth"), F.lit(5.0).alias("cell_km"), F.lit(17).alias("zoom"))
    saturated, splits = discover.split_decision()
    return cells.select("cell", "raw", "full_pages", "kept", saturated.alias("saturated"), splits.alias("splits"))


_COLLECT = collect.Settings(max_results=1_000_000, across_cells=False)



def _level_sql(d: int) -> str:
    """CTEs of a level of the collection: the frontier f, pages read r, the first rows k and the cells c."""
    half, known = 2**d, "SELECT key FROM k0" if d else "SELECT NULL WHERE false"
    frontier = f"SELECT i, j FROM g{half} WHERE lat < 36.4 AND lon < -86.6" if d == 0 else "SELECT 2 * i + u AS i, 2 * j + v AS j FROM c0, (SELECT unnest([0, 1]) AS u), (SELECT unnest([0, 1]) AS v) WHERE splits"
    return f"""f{d} AS (SELECT f.i, f.j, g.lat AS clat, g.lon AS clon, printf('%.6f,%.6f', g.lat, g.lon) AS cell_key FROM ({frontier}) f JOIN g{half} g USING (i, j)),
m{d} AS (SELECT r.*, f.cell_key, r.lat BETWEEN 36.0 AND 36.4 AND r.lon BETWEEN -87.0 AND -86.6 AS infence, r.lat BETWEEN 36.0 AND 36.4 AND r.lon BETWEEN -87.0 AND -86.6 AND {_HAVERSINE.format(lat1='r.lat', lon1='r.lon', lat2='f.clat', lon2='f.clon')} <= {5.0 / half} / 2.0 * sqrt(2) * 1000 * 1.5 AS good FROM rec{half} r JOIN f{d} f USING (i, j)),
w{d} AS (SELECT cell_key, page, count(*) AS new FROM (SELECT *, row_number() OVER (PARTITION BY cell_key, key ORDER BY page, rank) AS rn FROM m{d} WHERE good AND key NOT IN ({known})) WHERE rn = 1 GROUP BY cell_key, page),
s{d} AS (SELECT cell_key, min(page) FILTER (WHERE n < 20 OR coalesce(new, 0) = 0) AS stop FROM (SELECT cell_key, page, count(*) AS n FROM m{d} GROUP BY cell_key, page) LEFT JOIN w{d} USING (cell_key, page) GROUP BY cell_key),
r{d} AS (SELECT m.* FROM m{d} m JOIN s{d} USING (cell_key) WHERE stop IS NULL OR page <= stop),
k{d} AS (SELECT key, cell_key, page, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cell_key, page, rank) AS rn FROM r{d} WHERE good AND key NOT IN ({known})) WHERE rn = 1),
z{d} AS (SELECT cell_key, count(*) AS requests, sum(n) AS raw, sum(ob) AS ob, sum(nf) AS nf, count(*) FILTER (WHERE n >= 20) AS full_pages FROM (SELECT cell_key, page, count(*) AS n, count(*) FILTER (WHERE NOT infence) AS ob, count(*) FILTER (WHERE infence AND NOT good) AS nf FROM r{d} GROUP BY cell_key, page) GROUP BY cell_key),
c{d} AS (SELECT f.i, f.j, coalesce(requests, 0) AS requests, coalesce(raw, 0) AS raw, coalesce(ob, 0) AS ob, coalesce(nf, 0) AS nf, coalesce(kept, 0) AS kept, coalesce(raw, 0) >= 120 OR coalesce(full_pages, 0) >= 6 AS saturated, (coalesce(raw, 0) >= 120 OR coalesce(full_pages, 0) >= 6) AND coalesce(kept, 0) >= 24 AND {d} < 1 AS splits FROM f{d} f LEFT JOIN z{d} USING (cell_key) LEFT JOIN (SELECT cell_key, count(*) AS kept FROM k{d} GROUP BY cell_key) USING (cell_key))"""


def _recorded_sql(half: int) -> str:
    dlat, dlon = f"(5.0 / 111.32 / {half})", f"(5.0 / (111.32 * cos(radians(36.2))) / {half})"
    return f"""g{half} AS (SELECT i, j, 36.0 + (i + 0.5) * {dlat} AS lat, -87.0 + (j + 0.5) * {dlon} AS lon FROM (SELECT unnest(range(40)) AS i), (SELECT unnest(range(40)) AS j)),
o{half} AS (SELECT c_custkey, place_id AS key, lat, lon, CAST(floor((lat - 36.0) / {dlat}) AS BIGINT) AS i, CAST(floor((lon + 87.0) / {dlon}) AS BIGINT) AS j FROM places),
rec{half} AS (SELECT i, j, CAST(n // 20 AS INTEGER) AS page, CAST(n % 20 AS INTEGER) AS rank, key, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY c_custkey) - 1 AS n FROM (SELECT * FROM o{half} UNION ALL SELECT c_custkey, key, lat, lon, i, j + 1 FROM o{half} WHERE c_custkey % 9 = 0)) WHERE n < 120)"""


_LEVELS = f"WITH {PLACES}, {_recorded_sql(1)}, {_recorded_sql(2)}, {_level_sql(0)}, {_level_sql(1)}"


@query(f"{_LEVELS} SELECT key, cell_key, 0 AS depth, page, rank FROM k0 UNION ALL SELECT key, cell_key, 1, page, rank FROM k1")
def collect_levels(spark, sf_dir):
    """The production collection: frontier and recorded pages joined level by level, saturated cells split."""
    return collect.collect(b.grid_pages(spark, sf_dir), BOX, settings=_COLLECT).places.select("key", "cell_key", "depth", "page", "rank")


@query(f"""{_LEVELS}, c AS (SELECT * FROM c0 UNION ALL SELECT * FROM c1), t AS (SELECT count(*) AS cells_total, count(*) FILTER (WHERE splits) AS cells_subdivided, count(*) FILTER (WHERE saturated AND NOT splits) AS cells_saturated,
  CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(raw) - sum(kept) - sum(ob) - sum(nf) AS BIGINT) AS duplicates, CAST(sum(ob) AS BIGINT) AS outside_boundary, CAST(sum(nf) AS BIGINT) AS outside_footprint FROM c)
SELECT CASE WHEN cells_saturated > 0 THEN 'incomplete' ELSE 'complete' END AS status, CASE WHEN cells_saturated > 0 THEN 'cells saturated' ELSE '' END AS reasons, * FROM t""")
def collect_manifest(spark, sf_dir):
    got = collect.collect(b.grid_pages(spark, sf_dir), BOX, settings=_COLLECT)
    return got.manifest().select("status", F.array_join("reasons", ";").alias("reasons"), "cells_total", "cells_subdivided", "cells_saturated", "requests", "raw", "kept", "duplicates", "outside_boundary", "outside_footprint")


_OVERLAPS = f"""WITH RECURSIVE {PLACES}, {_recorded_sql(1)},
shown AS (SELECT c_custkey, key, lat, lon, i + u AS i, j + v AS j FROM o1, (SELECT unnest([0, 1]) AS u), (SELECT unnest([0, 1]) AS v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY (c_custkey * 31 + i * 97) % 1009, c_custkey) - 1 AS n FROM shown),
paged AS (SELECT printf('%.6f,%.6f', g.lat, g.lon) AS cell_key, n // 20 AS page, key, (r.i * 7 + r.j * 3) % 11 = 0 AND n // 20 = 1 AS refused,
                 r.lat BETWEEN 36.0 AND 36.4 AND r.lon BETWEEN -87.0 AND -86.6 AND {_HAVERSINE.format(lat1='r.lat', lon1='r.lon', lat2='g.lat', lon2='g.lon')} <= 2.5 * sqrt(2) * 1000 * 1.5 AS good
          FROM ranked r JOIN g1 g USING (i, j) WHERE n < 120 AND g.lat < 36.4 AND g.lon < -86.6),
turns AS (SELECT row_number() OVER (ORDER BY cell_key, page) AS pos, cell_key, page, count(*) AS n, bool_or(refused) AS refused, coalesce(list(DISTINCT key) FILTER (WHERE good AND NOT refused), []) AS ks FROM paged GROUP BY cell_key, page),
walk AS (
  SELECT 0::BIGINT AS pos, '' AS cell_key, false AS stopped, false AS reads, []::VARCHAR[] AS fresh, []::VARCHAR[] AS seen
  UNION ALL
  SELECT pos, cell_key, skips OR n < 20 OR refused OR len(new) = 0, NOT skips, CASE WHEN skips THEN [] ELSE new END, CASE WHEN skips THEN seen ELSE list_concat(seen, new) END
  FROM (SELECT t.*, w.seen, w.cell_key = t.cell_key AND w.stopped AS skips, list_filter(t.ks, lambda k: NOT list_contains(w.seen, k)) AS new FROM walk w JOIN turns t ON t.pos = w.pos + 1)),
cells AS (SELECT printf('%.6f,%.6f', lat, lon) AS cell_key FROM g1 WHERE lat < 36.4 AND lon < -86.6)"""


@query(f"""{_OVERLAPS} SELECT cell_key, count(pos) FILTER (WHERE NOT refused) AS requests, coalesce(CAST(sum(n) FILTER (WHERE NOT refused) AS BIGINT), 0) AS raw, coalesce(CAST(sum(len(fresh)) AS BIGINT), 0) AS kept, coalesce(bool_or(refused), false) AS failed
FROM cells LEFT JOIN (SELECT w.*, t.n, t.refused FROM walk w JOIN turns t USING (pos) WHERE reads) USING (cell_key) GROUP BY cell_key""")
def collect_across(spark, sf_dir):
    """A level of cells that overlap, some of them refused: a page without a key that is new to all cells before ends its cell."""
    got = collect.collect(b.overlapping_pages(spark, sf_dir), BOX, settings=collect.Settings(max_results=1_000_000, max_depth=0))
    return got.cells.select("cell_key", "requests", "raw", "kept", "failed")


@query(f"""{_OVERLAPS}, r AS (SELECT w.*, t.n, t.refused FROM walk w JOIN turns t USING (pos) WHERE reads), s AS (SELECT cell_key, bool_or(refused) AS failed, coalesce(sum(n) FILTER (WHERE NOT refused), 0) >= 120 AS saturated FROM r GROUP BY cell_key),
t AS (SELECT count(*) FILTER (WHERE failed) AS cells_failed, count(*) FILTER (WHERE saturated) AS cells_saturated FROM s)
SELECT (SELECT count(*) FROM cells) AS cells_total, cells_failed, (SELECT count(*) FROM cells) - (SELECT count(*) FROM (SELECT cell_key FROM r GROUP BY cell_key HAVING bool_and(refused))) AS cells_completed, cells_saturated,
       concat_ws(';', CASE WHEN cells_failed > 0 THEN 'cells failed' END, CASE WHEN cells_saturated > 0 THEN 'cells saturated' END) AS reasons FROM t""")
def collect_failures(spark, sf_dir):
    """The manifest of a collection in which recorded pages were refused."""
    got = collect.collect(b.overlapping_pages(spark, sf_dir), BOX, settings=collect.Settings(max_results=1_000_000, max_depth=0))
    return got.manifest().select("cells_total", "cells_failed", "cells_completed", "cells_saturated", F.array_join("reasons", ";").alias("reasons"))


@query(f"{_LEVELS} SELECT (SELECT count(*) FROM k0) + (SELECT count(*) FROM k1) AS retained, CAST((SELECT sum(raw) FROM c0) + coalesce((SELECT sum(raw) FROM c1), 0) AS BIGINT) AS raw, CAST((SELECT sum(requests) FROM c0) + coalesce((SELECT sum(requests) FROM c1), 0) AS BIGINT) AS requests, 1 AS run")
def manifest(spark, sf_dir):
    """A collection into a folder, by the runner; its manifest as written."""
    row = Places({"grid_pages": b.grid_pages(spark, sf_dir)}).collect(shared.folder(spark, "collection"), "shops", BOX, settings=_COLLECT)
    return row.select("retained", "raw", "requests", "run")


@query(f"""WITH e AS (SELECT user_id, min(ts) AS first_ts, min(event_id) AS n FROM events GROUP BY user_id) SELECT user_id AS key, count(*) AS n FROM e GROUP BY user_id""")
def stream_dedup(spark, sf_dir):
    """Events as a stream, deduplicated by user, run to the end of what is there."""
    return _streamed(spark, sf_dir, lambda s: streaming.first_seen(s.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts")), "key", "ts", "31 days"), "append").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2")
def stream_counts(spark, sf_dir):
    rows = _streamed(spark, sf_dir, lambda s: streaming.windowed_counts(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ("event_type",)), "append")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("SELECT user_id AS key, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS times, 1 AS news FROM events GROUP BY user_id")
def stream_state(spark, sf_dir):
    """Events as a stream of several batches with a state for each user: its first event, how often it was seen, once new."""
    with state.rocksdb(spark):
        rows = _streamed(spark, sf_dir, lambda s: state.sightings(s.withColumnRenamed("user_id", "key"), "key", ("ts", "event_id")), "append", batches=3)
    last = F.max_by(F.struct("event_id", "times"), "times")
    return rows.groupBy("key").agg(last.alias("last"), F.count_if("is_new").cast("int").alias("news")).select("key", "last.event_id", "last.times", "news")


def _streamed(spark: SparkSession, sf_dir: str, transform: Callable[[DataFrame], DataFrame], mode: str, batches: int = 1) -> DataFrame:
    """Run a stream over the events table, in `batches` batches at least, and read back what it wrote."""
    path = shared.folder(spark, "stream")
    events = table(spark, sf_dir, "events")
    files = spark.sparkContext.defaultParallelism  # of each batch: all cores write and read it
    (events if batches == 1 else events.repartition(batches * files)).write.parquet(f"{path}/in")
    source = spark.readStream.schema(events.schema)
    source = (source if batches == 1 else source.option("maxFilesPerTrigger", files)).parquet(f"{path}/in")
    out = transform(source)
    out.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


# Enrichment and contacts


@query("""SELECT c_custkey AS place_id, CASE WHEN s_name IS NOT NULL AND s_suppkey % 3 <> 0 THEN s_name ELSE c_name END AS name, CASE WHEN s_acctbal IS NOT NULL AND s_acctbal <> 0 THEN CAST(s_acctbal AS DOUBLE) ELSE CAST(c_acctbal AS DOUBLE) END AS balance, c_mktsegment AS category
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def enrich_merge(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place_id"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("double").alias("balance"), F.col("c_mktsegment").alias("category"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place_id"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).otherwise("").alias("name"), F.col("s_acctbal").cast("double").alias("balance"))
    return enrich.merge_details(left, right)


@query("SELECT p_partkey, lower(replace(p_type, '-', ' ')) LIKE '%steel%' OR lower(p_name) LIKE '%steel%' OR lower(p_type) LIKE '%brush%' OR lower(p_name) LIKE '%brush%' OR lower(p_type) LIKE '%copper%' OR lower(p_name) LIKE '%copper%' AS matches FROM part")
def relevance_match(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", keys.matches_query(F.lit("Steels brush-coppers of"), F.col("p_name"), F.array("p_type")).alias("matches"))


_BUDGET = f"""WITH {SITES}, r AS (SELECT s.place_id, s.website, p.category, p.name, s.c_custkey % 500 AS reviews FROM sites s JOIN places p USING (place_id)),
q AS (SELECT place_id, row_number() OVER (ORDER BY CASE WHEN lower(name || ' ' || category) LIKE '%building%' THEN 0 ELSE 1 END, -reviews, lower(name), place_id) AS contact_rank FROM r WHERE website <> '')"""


def _with_status(spark, sf_dir):
    rows = sites(spark, sf_dir).join(places(spark, sf_dir).select("place_id", "name", "category"), "place_id")
    rows = rows.select("place_id", "website", "name", F.array("category").alias("categories"), (F.col("c_custkey") % 500).alias("review_count"))
    return enrich.contact_status(rows, "buildings", 50, 10)


@query(f"{_BUDGET} SELECT place_id, contact_rank FROM q WHERE contact_rank <= 40")
def contact_budget_topk(spark, sf_dir):
    return _with_status(spark, sf_dir).filter("contact_rank IS NOT NULL").select("place_id", "contact_rank")


@query(f"{_BUDGET} SELECT CASE WHEN website = '' THEN 'not_eligible_no_website' WHEN contact_rank <= 40 THEN 'pending' ELSE 'not_attempted_limit' END AS contact_status, count(*) AS n FROM r LEFT JOIN q USING (place_id) GROUP BY 1")
def contact_status(spark, sf_dir):
    return _with_status(spark, sf_dir).groupBy("contact_status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SITES} SELECT place_id, 'info@shop' || k || '.com,sales+x@shop' || k || '.com,a' || k || '@gmail.com' || CASE WHEN website = '' THEN ',b@other' || k || '.org' ELSE '' END AS emails FROM (SELECT *, CAST(c_custkey AS VARCHAR) AS k FROM sites)""")
def emails_extract(spark, sf_dir):
    # A link with a subject isn't an address as a whole, so the plain text gives it.
    return sites(spark, sf_dir).select("place_id", F.array_join(contacts.emails(F.col("html"), F.col("website")), ",").alias("emails"))


_ADDRESS = "CASE c_custkey % 6 WHEN 0 THEN 'a' || c_custkey || '@shop.com' WHEN 1 THEN 'example@shop.com' WHEN 2 THEN 'x@mail.sentry.io' WHEN 3 THEN 'pic' || c_custkey || '@2x.png' WHEN 4 THEN 'abcdef0123456789abcdef012345@shop.com' ELSE 'x@notexample.com' END"


@query(f"SELECT c_custkey, {_ADDRESS} AS email, c_custkey % 6 IN (1, 2, 3, 4) AS junk FROM customer")
def emails_junk(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("email", F.expr(_ADDRESS))
    return rows.select("c_custkey", "email", contacts.is_junk_email(F.col("email")).alias("junk"))


@query(f"WITH {SITES} SELECT place_id, CAST(c_custkey % 4 = 2 OR c_custkey % 3 = 0 OR c_custkey % 3 = 1 AS BOOLEAN) AS fits FROM sites")
def email_site_match(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    email = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("a@mail.shop"), k, F.lit(".com"))).when(F.col("c_custkey") % 3 == 1, F.lit("a@gmail.com")).otherwise(F.lit("a@elsewhere.net"))
    return sites(spark, sf_dir).select("place_id", contacts.email_fits_site(email, F.col("website")).alias("fits"))


@query("SELECT c_custkey, 'c' || c_custkey || '@shop.co' AS email FROM customer")
def cfemail_decode(spark, sf_dir):
    key = F.col("c_custkey").cast("int").bitwiseAND(127)
    plain = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@shop.co"))
    letters = F.transform(F.split(plain, ""), lambda x: F.lpad(F.hex(F.ascii(x).bitwiseXOR(key)), 2, "0"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lpad(F.hex(key), 2, "0"), F.array_join(letters, "")).alias("code"))
    return rows.select("c_custkey", contacts.decode_cfemail(F.col("code")).alias("email"))


@query(f"WITH {SITES} SELECT place_id, 'facebook=https://www.facebook.com/shop' || c_custkey || ';twitter=https://x.com/shop' || c_custkey AS socials FROM sites")
def socials_extract(spark, sf_dir):
    entries = F.array_sort(F.transform(F.map_entries(contacts.social_links(F.col("html"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return sites(spark, sf_dir).select("place_id", F.array_join(entries, ";").alias("socials"))


@query("SELECT page_id, 'https://wa.me/' || page_id || '?text=hi' AS whatsapp, 'https://www.instagram.com/p' || page_id AS instagram FROM pages")
def social_clean_url(spark, sf_dir):
    k = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select("page_id", contacts.clean_social(F.concat(F.lit("https://wa.me/"), k, F.lit("/?text=hi#x"))).alias("whatsapp"), contacts.clean_social(F.concat(F.lit("https://www.instagram.com/p"), k, F.lit("/?utm=1);"))).alias("instagram"))


@query(f"""WITH {SITES}, w AS (SELECT place_id, CASE WHEN website = '' THEN '' WHEN website LIKE 'http%' THEN website ELSE 'https://' || website END AS base FROM sites)
SELECT place_id, rtrim(base, '/') || '/contact-us,' || rtrim(base, '/') || '/about/team' AS pages FROM w WHERE base <> ''""")
def contact_pages(spark, sf_dir):
    base = contacts.normal_url(F.col("website"))
    return sites(spark, sf_dir).filter("website != ''").select("place_id", F.array_join(contacts.contact_pages(F.col("html"), base, 2), ",").alias("pages"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www[.]', '') AS host, regexp_replace(regexp_replace(lower(url), '^(https?://)?(www[.])?', ''), '/+$', '') AS bare FROM pages")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", contacts.host(contacts.normal_url(F.col("url"))).alias("host"), contacts.bare_url(F.col("url")).alias("bare"))


@query("SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href=[\"'']([^\"'']+)[\"'']', 1)) AS h FROM pages) GROUP BY page_id")
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(contacts.HREF), F.lit(1))).alias("h")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SITES} SELECT place_id, true AS literal, c_custkey % 2 = 0 AS tokens, false AS invented, true AS link FROM sites")
def grounding(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    tokens = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("menu@shop"), k, F.lit(".net"))).otherwise(F.lit("zzz@qqq.net"))
    page = F.col("html")
    return sites(spark, sf_dir).select("place_id", contacts.email_grounded(F.concat(F.lit("A"), k, F.lit("@Gmail.com")), page).alias("literal"), contacts.email_grounded(tokens, page).alias("tokens"), contacts.email_grounded(F.lit("nobody@nowhere.zz"), page).alias("invented"), contacts.url_grounded(F.concat(F.lit("https://www.x.com/shop"), k, F.lit("/")), page).alias("link"))


@query("SELECT c_custkey, CAST(least(24, greatest(4, (greatest(1, c_custkey) + 39) // 40)) AS INTEGER) AS concurrency, CASE WHEN c_custkey <= 50 THEN 12.0 WHEN c_custkey <= 500 THEN 9.0 WHEN c_custkey <= 2000 THEN 7.0 ELSE 5.0 END::DOUBLE AS timeout, CASE WHEN c_custkey <= 500 THEN 3 WHEN c_custkey <= 2000 THEN 2 ELSE 1 END AS max_pages FROM customer")
def auto_params(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", metrics.batch_parameters(F.col("c_custkey")).alias("p")).select("c_custkey", "p.*")


_PROVIDERS = "f AS (SELECT p_partkey AS url, unnest(range(3)) AS provider_rank, p_size FROM part), g AS (SELECT *, (p_size + provider_rank) % 4 = 0 AS ok FROM f)"


@query(f"WITH {_PROVIDERS} SELECT url, CAST(coalesce(min(provider_rank) FILTER (WHERE ok), max(provider_rank)) AS INTEGER) AS provider_rank, bool_or(ok) AS ok FROM g GROUP BY url")
def provider_fallback(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("url"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("provider_rank"), "p_size")
    return enrich.first_ok(rows.withColumn("ok", (F.col("p_size") + F.col("provider_rank")) % 4 == 0)).select("url", "provider_rank", "ok")


# Reports


@query("""SELECT event_type, count(*) AS requests, count(*) - count(*) FILTER (WHERE value > 80) AS successful, count(*) FILTER (WHERE value > 80) AS failed, count(DISTINCT user_id) AS unique,
round(100.0 * (count(*) - count(*) FILTER (WHERE value > 80)) / count(*), 6) AS success_rate, round(count(DISTINCT user_id) * 60.0 / (epoch(max(ts)) - epoch(min(ts))), 6) AS per_minute FROM events GROUP BY event_type""")
def run_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = metrics.run_stats(e, F.col("value") > 80, F.col("user_id"), F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, ("event_type",))
    return rows.withColumn("success_rate", F.round("success_rate", 6)).withColumn("per_minute", F.round("per_minute", 6))


@query("SELECT CASE WHEN user_id % 5 = 0 THEN 'rate_limited' WHEN user_id % 5 = 1 THEN 'parse' WHEN user_id % 5 IN (2, 3) THEN 'network' ELSE 'other' END AS error_class, count(*) AS n FROM events GROUP BY 1")
def error_classes(spark, sf_dir):
    names = F.array(*map(F.lit, ("RateLimitError", "ParseError", "ConnectTimeout", "NetworkError", "ValueError")))
    rows = table(spark, sf_dir, "events").select(metrics.error_class(F.get(names, (F.col("user_id") % 5).cast("int"))).alias("error_class"))
    return rows.groupBy("error_class").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_custkey, concat_ws(';', CASE WHEN n > 14 THEN 'result cap reached' END, CASE WHEN f > 8 THEN 'cells failed' END, CASE WHEN p > 5 THEN 'cells saturated' END, CASE WHEN d + (CASE WHEN f > 8 THEN f ELSE 0 END) < n THEN 'cells unprocessed' END) AS reasons,
NOT (n > 14) AND NOT (f > 8) AND NOT (p > 5) AND NOT (d + (CASE WHEN f > 8 THEN f ELSE 0 END) < n) AS complete
FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'P') AS p, count(*) FILTER (WHERE o_totalprice > 20000) AS d FROM orders GROUP BY o_custkey)""")
def completeness_reasons(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("cells_total"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.count_if(F.col("o_totalprice") > 20000).alias("cells_completed"))
    o = o.withColumn("cap_reached", F.col("cells_total") > 14).withColumn("cells_failed", F.when(F.col("f") > 8, F.col("f")).otherwise(0)).withColumn("cells_saturated", F.when(F.col("p") > 5, F.col("p")).otherwise(0))
    return metrics.completeness(o).select("o_custkey", F.array_join("reasons", ";").alias("reasons"), "complete")


_RUNS = "runs AS (SELECT o_orderstatus AS city, o_orderpriority AS run, o_custkey AS key, o_totalprice > 250000 AS relevant FROM orders)"


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("city"), F.col("o_orderpriority").alias("run"), F.col("o_custkey").alias("key"), (F.col("o_totalprice") > 250000).alias("relevant"))


@query(f"WITH {_RUNS} SELECT city, count(DISTINCT key) AS floor, count(DISTINCT key) FILTER (WHERE relevant) AS relevant_floor FROM runs GROUP BY city")
def recall_floor(spark, sf_dir):
    return metrics.recall(_runs(spark, sf_dir)).select("city", "floor", "relevant_floor").distinct()


@query(f"""WITH {_RUNS}, f AS (SELECT city, count(DISTINCT key) AS floor, count(DISTINCT key) FILTER (WHERE relevant) AS rf FROM runs GROUP BY city)
SELECT city, run, count(DISTINCT key) AS retained, count(DISTINCT key) FILTER (WHERE relevant) AS relevant, round(count(DISTINCT key) / floor, 6) AS recall, round(CASE WHEN rf > 0 THEN count(DISTINCT key) FILTER (WHERE relevant) / rf ELSE 0 END, 6) AS relevant_recall FROM runs JOIN f USING (city) GROUP BY city, run, floor, rf""")
def recall_by_run(spark, sf_dir):
    return metrics.recall(_runs(spark, sf_dir)).select("city", "run", "retained", "relevant", F.round("recall", 6).alias("recall"), F.round("relevant_recall", 6).alias("relevant_recall"))


@query(f"""WITH {_RUNS}, p AS (SELECT run AS policy, count(DISTINCT key) AS retained, count(*) AS requests FROM runs GROUP BY run), b AS (SELECT retained / requests AS base FROM p WHERE policy = '1-URGENT')
SELECT policy, retained, requests, round(retained / requests, 6) AS unique_per_request, round(retained / requests / base, 6) AS vs_baseline FROM p, b""")
def policy_summary(spark, sf_dir):
    rows = _runs(spark, sf_dir).groupBy(F.col("run").alias("policy")).agg(F.countDistinct("key").alias("retained"), F.count(F.lit(1)).alias("requests"))
    return metrics.policy_summary(rows, "1-URGENT").select("policy", "retained", "requests", F.round("unique_per_request", 6).alias("unique_per_request"), F.round("vs_baseline", 6).alias("vs_baseline"))


@query(f"""WITH {_RUNS}, one AS (SELECT city, run, key, bool_or(relevant) AS r FROM runs GROUP BY ALL), f AS (SELECT city, count(DISTINCT key) AS floor FROM one GROUP BY city),
m AS (SELECT city, run, count(*) AS requests, count(*) - count(DISTINCT key) AS duplicates, count(*) FILTER (WHERE key % 3 = 0) AS outside FROM runs WHERE run <> '3-MEDIUM' GROUP BY city, run)
SELECT city, run, count(*) AS retained, round(count(*) / any_value(floor), 6) AS recall, any_value(requests) AS requests, any_value(duplicates) AS duplicates, round(count(*) / any_value(requests), 6) AS unique_per_request, round(any_value(outside) / any_value(requests), 6) AS outside_share
FROM one JOIN f USING (city) LEFT JOIN m USING (city, run) GROUP BY city, run""")
def run_report(spark, sf_dir):
    """Runs with what their manifests say; one policy has none."""
    runs = _runs(spark, sf_dir)
    n = F.count(F.lit(1))
    told = runs.filter("run <> '3-MEDIUM'").groupBy("city", "run").agg(n.alias("discovery_requests"), (n - F.countDistinct("key")).alias("duplicates"), F.count_if(F.col("key") % 3 == 0).alias("outside_boundary"), n.alias("raw_occurrences"))
    return reports.run_report(runs, told).select("city", "run", "retained", F.round("recall", 6).alias("recall"), "requests", "duplicates", F.round("unique_per_request", 6).alias("unique_per_request"), F.round("outside_share", 6).alias("outside_share"))


@query(f"WITH {occurrences_sql()}, k AS (SELECT key, cell, row_number() OVER (PARTITION BY key ORDER BY cell, page, rank) AS rn FROM occ) SELECT key % 7 AS part, count(*) AS places, count(DISTINCT cell) AS cells FROM k WHERE rn = 1 GROUP BY 1")
def cells_touched(spark, sf_dir):
    first = discover.first_wins(occurrences(spark, sf_dir)).withColumn("part", F.col("key") % 7)
    return reports.cells_touched(first, "part", cell="cell")


@query(f"WITH {SITES} SELECT p.city, count(*) AS sites, count(*) FILTER (WHERE s.c_custkey % 3 <> 0) AS found, count(*) FILTER (WHERE p.category ILIKE '%build%') AS relevant FROM sites s JOIN places p USING (place_id) GROUP BY p.city")
def found_sites(spark, sf_dir):
    """Sites of which every third has an empty page; and how many places are of a category."""
    rows = sites(spark, sf_dir).join(places(spark, sf_dir).select("place_id", "city", "category"), "place_id")
    html = F.when(F.col("c_custkey") % 3 != 0, F.col("html")).otherwise("")
    rows = rows.select("city", reports.category_holds(F.array("category"), "Build").alias("relevant"), contacts.emails(html).alias("emails"), contacts.social_links(html).alias("social_links"))
    return reports.found_sites(rows, "city").join(rows.groupBy("city").agg(F.count_if("relevant").alias("relevant")), "city")


@query("""WITH l AS (SELECT max(epoch(ts)) AS now FROM events) SELECT event_type, count(*) FILTER (WHERE (now - epoch(ts)) / 3600.0 <= 48) AS fresh, count(*) FILTER (WHERE now - epoch(ts) > 900) AS stale, round(max((now - epoch(ts)) / 3600.0), 4) AS oldest FROM events, l GROUP BY event_type""")
def freshness(spark, sf_dir):
    """How old each kind of event is, seen from the last one."""
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    now = e.agg(F.max("at")).scalar()
    return e.groupBy("event_type").agg(F.count_if(reports.is_fresh(F.col("at"), now, 48)).alias("fresh"), F.count_if(reports.is_stale(F.col("at"), now)).alias("stale"), F.round(F.max(reports.age_hours(F.col("at"), now)), 4).alias("oldest"))


@query("""SELECT c_custkey, 'q=' || replace(url_encode(c_mktsegment || ' & co ~*' || c_custkey), '%20', '+') || '&hl=en' || CASE WHEN c_custkey % 2 = 0 THEN '&center=36.5%2C-' || c_custkey ELSE '' END AS search,
       'feature_id=0x' || c_custkey || '&sort=newest&hl=de' || CASE WHEN c_custkey % 3 = 0 THEN '&page_token=' || c_custkey ELSE '' END AS reviews FROM customer""")
def request_params(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    even = F.col("c_custkey") % 2 == 0
    search = requests.search_params(F.concat("c_mktsegment", F.lit(" & co ~*"), k), F.when(even, F.lit("36.5")), F.when(even, F.concat(F.lit("-"), k)))
    reviews = requests.review_params(F.concat(F.lit("0x"), k), F.when(F.col("c_custkey") % 3 == 0, k).otherwise(""), "newest", "de")
    return table(spark, sf_dir, "customer").select("c_custkey", requests.query_string(search).alias("search"), requests.query_string(reviews).alias("reviews"))


@query("SELECT DISTINCT o_custkey AS key FROM orders WHERE o_totalprice > 300000 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice <= 100000)")
def footprint_leak(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "key")
    return metrics.footprint_leak(o.filter("o_totalprice > 300000"), o.filter("o_totalprice <= 100000"))


@query("""WITH c AS (SELECT l.toxic, l.quality, d.n_chars FROM labels l JOIN documents d USING (doc_id)), t AS (SELECT count(*) FILTER (WHERE n_chars < 1500 AND toxic = 1) AS tp, count(*) FILTER (WHERE n_chars < 1500 AND toxic = 0) AS fp, count(*) FILTER (WHERE n_chars >= 1500 AND toxic = 1) AS fn FROM c)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM t""")
def extractor_prf(spark, sf_dir):
    cases = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    none = F.array().cast("array<string>")
    cases = cases.select(F.when(F.col("n_chars") < 1500, F.array(F.lit("toxic"))).otherwise(none).alias("got"), F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(none).alias("expected"))
    return metrics.evaluate_sets(cases, "got", "expected").select("tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("SELECT event_type AS name, round(score, 6) AS score, latency_ms, row_number() OVER (ORDER BY score DESC, latency_ms, event_type) AS rank FROM (SELECT event_type, count(*) FILTER (WHERE value < 50) / count(*) AS score, count(*) AS latency_ms FROM events GROUP BY event_type)")
def rank_promote(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg((F.count_if(F.col("value") < 50) / F.count(F.lit(1))).alias("score"), F.count(F.lit(1)).alias("latency_ms"))
    return metrics.ranked(rows).select("name", F.round("score", 6).alias("score"), "latency_ms", "rank")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, n, min(value) AS p90, greatest(3.0, least(12.0, min(value) * 1.5)) AS timeout FROM r WHERE rn >= CAST(floor(n * 0.9) AS BIGINT) GROUP BY event_type, n""")
def adaptive_timeout_p90(spark, sf_dir):
    return metrics.adaptive_timeout(table(spark, sf_dir, "events"), "value", ("event_type",), 12.0)


@query("""SELECT user_id, list_reduce(list(struct_pack(d := 0.0::DOUBLE, s := 0, b := value > 95) ORDER BY ts, event_id), lambda a, x: struct_pack(
  d := CASE WHEN x.b THEN least(8.0, round(a.d * 2.0, 4)) WHEN a.s + 1 >= 5 THEN greatest(0.4, round(a.d - 0.1, 4)) ELSE a.d END,
  s := CASE WHEN x.b OR a.s + 1 >= 5 THEN 0 ELSE a.s + 1 END, b := x.b), struct_pack(d := 1.5::DOUBLE, s := 0, b := false)).d AS delay FROM events GROUP BY user_id""")
def aimd_delay(spark, sf_dir):
    """The delay of each user's request log, folded in time order."""
    return folds.aimd(table(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), F.col("value") > 95)


@query("""WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS log, ts, event_id, value > 70 AS blocked, CASE WHEN value > 90 THEN (event_id % 13) * 0.53 END::DOUBLE AS wait FROM events)
SELECT log, list_reduce(list(struct_pack(d := 0.0::DOUBLE, s := 0, b := blocked, w := wait) ORDER BY ts, event_id), lambda a, x: struct_pack(
  d := CASE WHEN x.b THEN least(8.0, round(greatest(a.d * 2.0, coalesce(x.w, 0.0)), 4)) WHEN a.s + 1 >= 3 THEN greatest(0.4, round(a.d - 0.1, 4)) ELSE a.d END,
  s := CASE WHEN x.b OR a.s + 1 >= 3 THEN 0 ELSE a.s + 1 END, b := x.b, w := x.w), struct_pack(d := 1.5::DOUBLE, s := 0, b := false, w := 0.0::DOUBLE)).d AS delay FROM e GROUP BY log""")
def aimd_scan(spark, sf_dir):
    """Logs of which one has a third of all events, waits that a block asks for included, composed over many tasks."""
    log = table(spark, sf_dir, "events").withColumn("log", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")))
    wait = F.when(F.col("value") > 90, F.col("event_id") % 13 * 0.53)
    return folds.aimd(log, "log", ("ts", "event_id"), F.col("value") > 70, wait, folds.Control(needed=3))

# Positional JSON


def _entries(spark, sf_dir):
    return parse.place_entries(responses(spark, sf_dir).select("page", decode.decoded(F.col("raw")).alias("response")))


@query(f"WITH {PLACES} SELECT c_custkey // 20 AS page, count(*) AS n FROM places GROUP BY 1")
def parse_envelope(spark, sf_dir):
    return _entries(spark, sf_dir).groupBy("page").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PLACES} SELECT c_custkey // 20 AS page, name, CASE WHEN c_custkey % 25 <> 0 THEN place_id END AS place_id, '0x' || c_custkey AS hex_id, CAST(NULL AS VARCHAR) AS ftid, 'D' || c_custkey AS data_id, CAST(a AS DOUBLE) AS latitude, CAST(b AS DOUBLE) AS longitude, category || ' street' AS address, CAST(NULL AS VARCHAR) AS phone, 'https://shop' || c_custkey || '.com' AS website FROM places")
def parse_core_json(spark, sf_dir):
    return parse.parse_core(_entries(spark, sf_dir), keep=("page",))


@query(f"WITH {PLACES} SELECT name, round(c_custkey % 50 / 10.0, 1) AS rating, c_custkey % 300 AS review_count, category AS categories FROM places")
def parse_full_places(spark, sf_dir):
    return parse.parse_places(_entries(spark, sf_dir)).select("name", F.round("rating", 1).alias("rating"), "review_count", F.array_join("categories", ",").alias("categories"))


@query(f"WITH {PLACES} SELECT c_custkey // 20 AS page, count(*) AS total, count(*) FILTER (WHERE c_custkey % 25 <> 0) AS with_place_id, count(*) FILTER (WHERE c_custkey % 25 <> 0) >= 0.9 * count(*) AS healthy FROM places GROUP BY 1")
def parse_health(spark, sf_dir):
    places_ = parse.parse_core(_entries(spark, sf_dir), keep=("page",))
    return quality.health(places_, ("page",)).select("page", "total", "with_place_id", "healthy")


@query(f"WITH {PLACES} SELECT c_custkey // 20 AS page, CASE WHEN c_custkey // 20 % 3 = 0 THEN 'low name coverage;low place_id coverage;low coords coverage' ELSE '' END AS problems FROM places GROUP BY 1, 2")
def drift_detect(spark, sf_dir):
    """Every third page has another layout than the parser knows."""
    moved = parse.place_entries(b.moved_responses(spark, sf_dir).filter("page % 3 = 0")).select("page", "pd")
    entries = _entries(spark, sf_dir).filter("page % 3 <> 0").select("page", "pd").unionByName(moved)
    return quality.health(parse.parse_core(entries, keep=("page",)), ("page",)).select("page", F.array_join("problems", ";").alias("problems"))


@query(f"""WITH {PLACES} SELECT 'name' AS field, '3,0,1,0,0,2' AS path, count(*) AS votes FROM places
UNION ALL SELECT 'longitude', '3,0,1,0,1,0,0', count(*) FROM places UNION ALL SELECT 'place_id', '2', count(*) FROM places""")
def deep_paths(spark, sf_dir):
    """Fields that stand six and seven lists deep, found from labels: one entry a place."""
    known = places(spark, sf_dir)
    text = F.concat(F.lit('[null,{"skipped":[1]},"'), F.col("place_id"), F.lit('",[[null,[[[0,false,"'), F.col("name"), F.lit('"],[['), (F.col("b") + 5000.5).cast("string"), F.lit("]]]]]]]"))
    entries = known.select(F.col("c_custkey").alias("entry"), F.parse_json(text).alias("pd"))
    values = [F.struct(F.lit(n).alias("field"), F.col(n).alias("value"), F.lit(None).cast("double").alias("number")) for n in ("name", "place_id")]
    values.append(F.struct(F.lit("longitude").alias("field"), F.lit(None).cast("string").alias("value"), (F.col("b") + 5000.5).alias("number")))
    labels = known.select(F.col("c_custkey").alias("label"), F.explode(F.array(*values)).alias("x")).select("label", "x.*")
    return quality.rederive(entries, labels).select("field", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"), "votes")


_FIELDS = {"name": "name", "place_id": "place_id", "hex_id": "'0x' || c_custkey", "address": "category || ' street'", "website": "'https://shop' || c_custkey || '.com'"}


@query(f"""WITH {PLACES}, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 25 <> 0) AS ids, count(*) FILTER (WHERE a <> c_custkey % 50 / 10.0 AND a <> c_custkey % 300) AS lats FROM places)
SELECT unnest(['name', 'place_id', 'hex_id', 'latitude', 'address', 'website']) AS field, unnest(['11', '78', '10', '9,2', '18', '7,0']) AS path, unnest([n, ids, n, lats, n, n]) AS votes FROM n""")
def schema_rederive(spark, sf_dir):
    """Every place is a label and every recorded page is read."""
    known = places(spark, sf_dir)
    values = [F.struct(F.lit(n).alias("field"), F.expr(v).alias("value"), F.lit(None).cast("double").alias("number")) for n, v in _FIELDS.items()]
    values.append(F.struct(F.lit("latitude").alias("field"), F.lit(None).cast("string").alias("value"), F.col("a").cast("double").alias("number")))
    labels = known.select(F.col("c_custkey").alias("label"), F.explode(F.array(*values)).alias("x")).select("label", "x.*")
    entries = _entries(spark, sf_dir).withColumn("entry", F.col("page") * 100 + F.col("pos"))
    return quality.rederive(entries, labels).select("field", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"), "votes")


@query(f"WITH {PLACES} SELECT place_id, name, a + 0.25::DOUBLE AS latitude, b + 0.75::DOUBLE AS longitude, true AS healed FROM places")
def heal_layout(spark, sf_dir):
    """A changed layout: paths found from labels, adopted because the new parse is healthy."""
    known = places(spark, sf_dir)
    values = [F.struct(F.lit(n).alias("field"), F.col(n).alias("value"), F.lit(None).cast("double").alias("number")) for n in ("name", "place_id")]
    values += [F.struct(F.lit(n).alias("field"), F.lit(None).cast("string").alias("value"), v.alias("number")) for n, v in (("latitude", F.col("a") + 0.25), ("longitude", F.col("b") + 0.75))]
    labels = known.select(F.col("c_custkey").alias("label"), F.explode(F.array(*values)).alias("x")).select("label", "x.*")
    rows, _, healed = quality.heal(b.moved_responses(spark, sf_dir), labels)
    return rows.select("place_id", "name", "latitude", "longitude", F.lit(healed).alias("healed"))


@query(f"WITH {PLACES} SELECT CAST(count(*) AS BIGINT) AS correct, CAST(count(*) + count(*) FILTER (WHERE c_custkey % 25 = 0) AS BIGINT) AS total FROM places WHERE c_custkey % 25 <> 0 OR true HAVING count(*) < 0 UNION ALL SELECT 2 * count(*) - count(*) FILTER (WHERE c_custkey % 25 = 0), 2 * count(*) FROM places")
def parse_accuracy(spark, sf_dir):
    got = parse.parse_core(_entries(spark, sf_dir)).select("data_id", F.explode(F.array(F.struct(F.lit("name").alias("f"), F.col("name").alias("got")), F.struct(F.lit("place_id").alias("f"), F.col("place_id").alias("got")))).alias("x")).select("data_id", "x.*")
    want = places(spark, sf_dir).select(F.concat(F.lit("D"), F.col("c_custkey").cast("string")).alias("data_id"), F.explode(F.array(F.struct(F.lit("name").alias("f"), F.col("name").alias("expected")), F.struct(F.lit("place_id").alias("f"), F.col("place_id").alias("expected")))).alias("x")).select("data_id", "x.*")
    return metrics.parse_accuracy(got.join(want, ["data_id", "f"])).select("correct", "total")


def _slot_json(slots: dict[int, str], size: int) -> str:
    return "[" + ",".join(slots.get(i, "null") for i in range(size)) + "]"


def _flat(m: Column, sep: str) -> Column:
    """A map as text, sorted by key."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string") if sep == "" else F.array_join(e["value"], sep)))), ";")


_HOURS = _slot_json({4: '[1,null,"$$",["http://r"],null,null,null,@RATING,"@COUNT"]', 116: "2", 175: '[null,null,null,[@ONES,0,null,"2",10]]', 203: '[[["Mon",1,null,[["9-12"],["13-@CLOSE"]]],["Tue",2,null,[["9-@DAY"]]],["Mon",1,null,[["20-22"]]]]]', 100: '[null,[["Service",[["Delivery",true],["Pickup",0]]],["Credit cards",["@CARD","MC"]]]]'}, 204)


@query("SELECT c_custkey, 'Mon:9-12|13-' || c_custkey || '|20-22;Tue:9-' || c_custkey % 9 AS hours, round(c_custkey % 50 / 10.0, 1)::DOUBLE AS rating, c_custkey + 1 AS review_count, '1:' || (c_custkey % 8 + 1) || ';4:2;5:10' AS histogram, c_mktsegment || ',MC' AS cards FROM customer")
def parse_hours_rating(spark, sf_dir):
    pd = F.col("pd")
    k = F.col("c_custkey")
    filled = F.lit(_HOURS)
    for name, value in (("CLOSE", k), ("DAY", k % 9), ("RATING", F.round(k % 50 / 10.0, 1)), ("COUNT", k + 1), ("ONES", k % 8 + 1), ("CARD", F.col("c_mktsegment"))):
        filled = F.replace(filled, F.lit(f"@{name}"), value.cast("string"))
    rows = b.customers(spark, sf_dir).select("c_custkey", F.parse_json(filled).alias("pd"))
    rating, about = parse.rating(pd), parse.about(pd)

    return rows.select("c_custkey", _flat(parse.hours(pd), "|").alias("hours"), F.round(rating["rating"], 1).alias("rating"), rating["review_count"].alias("review_count"), _flat(rating["reviews_per_rating"], "").alias("histogram"), F.array_join(about["credit_cards"], ",").alias("cards"))


def _review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, response): every turn as a recorded page of one review."""
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    quoted = F.regexp_replace(F.to_json(F.struct("text")), r'^\{"text":(.*)\}$', "$1")
    entry = F.concat(F.lit('["'), F.col("turn").cast("string"), F.lit('",[null,null,null,null,[null,null,null,null,null,["'), F.col("role"), F.lit('"]]],[[5],null,null,null,null,null,null,null,null,null,null,null,null,null,null,[['), quoted, F.lit("]]]]"))
    return c.select("conv_id", "turn", F.parse_json(F.concat(F.lit("[null,[null,\"t\"],["), entry, F.lit("]]"))).alias("response"))


@query("SELECT conv_id, turn, role AS author_name, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 3")
def reviews_topn(spark, sf_dir):
    """Review pages as recorded, parsed and cut to the first three of each place."""
    rows = _review_pages(spark, sf_dir)
    parsed = parse.parse_reviews(rows, keep=("conv_id",)).select("conv_id", F.col("review_id").cast("long").alias("turn"), "author_name", "text")
    return parsed.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).filter("rn <= 3").drop("rn")


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'blocked' WHEN p_size % 5 = 1 THEN 'sign_in' WHEN p_size % 5 = 2 THEN 'html' ELSE 'json' END AS kind, CASE WHEN p_size % 5 >= 3 THEN CAST(p_partkey AS VARCHAR) END AS id FROM part")
def decode_envelope(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    raws = [F.lit("<html>Too Many Requests</html>"), F.lit("<html><body>Sign in or Log in</body></html>"), F.lit("<html><body>Welcome</body></html>"), F.concat(F.lit(")]}'\n["), k, F.lit("]")), F.concat(F.lit('{"c":0,"d":")]}\'\\n['), k, F.lit(']"}/*""*/'))]
    raw = F.get(F.array(*raws), (F.col("p_size") % 5).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", decode.kind(raw).alias("kind"), F.try_variant_get(decode.decoded(raw), "$[0]", "string").alias("id"))


@query("SELECT page_id, lower(html) LIKE '%captcha%' OR lower(html) LIKE '%access denied%' OR lower(html) LIKE '%error 403%' OR lower(html) LIKE '%error 429%' OR lower(html) LIKE '%too many requests%' OR lower(html) LIKE '%our systems have detected unusual traffic%' OR lower(html) LIKE '%sorry, that page can not be found%' AS blocked FROM pages")
def blocked_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", decode.is_blocked(F.col("html")).alias("blocked"))


_PB = "'!1m3!2s' || lower(c_mktsegment) || '!3i' || c_custkey || '!4b' || CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '0' END || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '!7i20' END"


def _pb():
    return pb.encode([pb.message(1, [pb.field(2, "s", F.lower("c_mktsegment")), pb.field(3, "i", F.col("c_custkey")), pb.field(4, "b", F.col("c_custkey") % 2 == 0)]), pb.field(7, "i", F.when(F.col("c_custkey") % 3 != 0, F.lit(20)))])


@query(f"SELECT c_custkey, {_PB} AS pb FROM customer")
def pb_encode(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", _pb().alias("pb"))


@query("""SELECT c_custkey, '1m=3;2s' || lower(c_mktsegment) || '=;3i=' || c_custkey || ';4b=' || CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '0' END || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ';7i=20' END AS fields FROM customer""")
def pb_decode(spark, sf_dir):
    fields = F.transform(pb.decode(_pb()), lambda f: F.concat(f["field"].cast("string"), f["type"], F.lit("="), f["value"]))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(fields, ";").alias("fields"))


@query("""SELECT c_custkey, '!1s{query}!2d' || CASE WHEN c_custkey % 4 = 0 THEN '-' || c_custkey ELSE '{lng}' END || '!7i' || c_custkey % 7 AS template,
       '!1s' || c_name || '!2d' || CASE WHEN c_custkey % 4 = 0 THEN '-' || c_custkey ELSE '' || c_nationkey END || '!7i' || c_custkey % 7 AS rendered FROM customer""")
def pb_template(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    lng = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("-"), k))  # every fourth has no longitude to put in
    made = pb.template(F.concat(F.lit("!1s"), k, F.lit("!2d-"), k, F.lit("!7i"), (F.col("c_custkey") % 7).cast("string")), query=k, lng=lng)
    return table(spark, sf_dir, "customer").select("c_custkey", made.alias("template"), pb.render(made, query=F.col("c_name"), lng=F.col("c_nationkey")).alias("rendered"))


@query(f"""WITH {SITES} SELECT p.name, s.place_id, 'info@shop' || s.c_custkey || '.com; sales+x@shop' || s.c_custkey || '.com; a' || s.c_custkey || '@gmail.com; b@other' || s.c_custkey || '.org' AS emails, 'facebook: https://www.facebook.com/shop' || s.c_custkey || '; twitter: https://x.com/shop' || s.c_custkey AS socials FROM sites s JOIN places p USING (place_id)""")
def csv_projection(spark, sf_dir):
    rows = sites(spark, sf_dir).join(places(spark, sf_dir).select("place_id", "name"), "place_id").select("place_id", "name", contacts.emails(F.col("html")).alias("emails"), contacts.social_links(F.col("html")).alias("social_links"))
    return recorded.csv_rows(rows).select("name", "place_id", "emails", "socials")


_RATING = "concat_ws(',', CASE WHEN c_custkey % 50 <> 0 THEN '\"rating\":' || CAST((c_custkey % 50) / 10.0 AS DOUBLE) END, CASE WHEN c_custkey % 300 <> 0 THEN '\"review_count\":' || c_custkey % 300 END)"
_WHERE = "concat_ws(',', CASE WHEN a <> 0 THEN '\"latitude\":' || CAST(a AS DOUBLE) END, CASE WHEN b <> 0 THEN '\"longitude\":' || CAST(b AS DOUBLE) END)"


@query(f"""WITH {PLACES} SELECT '{{"name":"' || name || '"' || CASE WHEN c_custkey % 25 <> 0 THEN ',"place_id":"' || place_id || '"' ELSE '' END
 || ',"hex_id":"0x' || c_custkey || '","data_id":"D' || c_custkey || '","cid":"0x' || c_custkey || '","contact":{{"website":"https://shop' || c_custkey || '.com"'
 || CASE WHEN c_custkey % 25 <> 0 THEN ',"google_maps_url":"{parse.PLACE_URL}' || place_id || '"' ELSE '' END || '}},"address":{{"full":"' || category || ' street"}}'
 || CASE WHEN {_RATING} <> '' THEN ',"rating":{{' || {_RATING} || '}}' ELSE '' END || CASE WHEN {_WHERE} <> '' THEN ',"location":{{' || {_WHERE} || '}}' ELSE '' END
 || ',"business":{{"categories":["' || category || '"]}}}}' AS record FROM places""")
def grouped_json(spark, sf_dir):
    return parse.grouped(parse.parse_places(_entries(spark, sf_dir))).select(F.to_json("record", {"ignoreNullFields": "true"}).alias("record"))


# Details, lookups, areas, providers and sinks


_PEAK = "CASE WHEN c_custkey % 7 > 0 THEN '1:3;4:' || c_custkey % 7 || ';5:10' ELSE '1:3;5:10' END"


@query(f"""WITH {PLACES} SELECT place_id, k || ' Main St' AS street, 'Nashville' AS city, '37-' || k AS postal_code, 'PLUS' || k AS plus_code, 'http://menu/' || k AS menu, 'Owner ' || k AS owner, 'http://book/' || k AS booking, 'ref' || k || '=http://p/' || k AS photo,
'http://t/' || k AS thumbnail, 'http://sv/' || k AS street_view_url, CAST(2 AS INTEGER) AS images, 'Mon:9-12|13-' || k || '|20-22;Tue:9-17' AS hours, {_PEAK} AS histogram, '555-' || k AS phone, 'Delivery,Pickup' AS options, category || ',Shop' AS categories
FROM (SELECT *, CAST(c_custkey AS VARCHAR) AS k FROM places)""")
def details_fields(spark, sf_dir):
    """Addresses, media, links, hours and ratings of every recorded details response."""
    rows = parse.parse_details(b.details(spark, sf_dir))
    options = F.flatten(F.transform("about", lambda a: F.transform(a["options"], lambda o: o["name"])))
    return rows.select("place_id", "street", "city", "postal_code", "plus_code", F.col("menu.link").alias("menu"), F.col("owner.name").alias("owner"), F.col("reservations")[0]["link"].alias("booking"), F.concat_ws("=", F.col("photos")[0]["reference"], F.col("photos")[0]["url"]).alias("photo"), "thumbnail", "street_view_url", F.size("images").alias("images"), _flat(F.col("hours"), "|").alias("hours"), _flat(F.col("reviews_per_rating"), "").alias("histogram"), "phone", F.array_join(options, ",").alias("options"), F.array_join("categories", ",").alias("categories"))


@query(f"""WITH {PLACES} SELECT CASE WHEN c_custkey % 25 <> 0 THEN place_id END AS place_id, CASE WHEN c_custkey % 25 <> 0 AND c_custkey % 3 <> 0 THEN 'Shop ' || c_custkey || ' Inc' ELSE name END AS name, CASE WHEN c_custkey % 25 <> 0 THEN c_custkey || ' Main St' END AS street,
CASE WHEN c_custkey % 25 <> 0 THEN c_custkey || ' Main St, Nashville' ELSE category || ' street' END AS address, CASE WHEN c_custkey % 25 <> 0 THEN category || ',Shop' ELSE category END AS categories, CASE WHEN c_custkey % 25 <> 0 THEN 2 ELSE 0 END AS images, CASE WHEN c_custkey % 25 <> 0 THEN 'Mon:9-12|13-' || c_custkey || '|20-22;Tue:9-17' ELSE '' END AS hours FROM places""")
def enrich_details(spark, sf_dir):
    """Parsed search results with parsed details, all columns, maps and lists included."""
    rows = Places({"details": b.details(spark, sf_dir)}).enrich(parse.parse_places(_entries(spark, sf_dir)))
    return rows.select("place_id", "name", "street", "address", F.array_join("categories", ",").alias("categories"), F.greatest(F.size(F.coalesce("images", F.array().cast(dict(rows.dtypes)["images"]))), F.lit(0)).alias("images"), F.coalesce(_flat(F.col("hours"), "|"), F.lit("")).alias("hours"))


@query(f"WITH {PLACES} SELECT 'id' AS by, place_id, '0x' || c_custkey AS hex_id FROM places WHERE c_custkey = 7 UNION ALL SELECT 'hex', place_id, '0x' || c_custkey FROM places WHERE c_custkey = 11")
def place_lookup(spark, sf_dir):
    """A place by id and one by hexadecimal id."""
    api = Places({"details": b.details(spark, sf_dir)})
    found = api.get("P000000007").select(F.lit("id").alias("by"), "place_id", "hex_id")
    return found.union(api.get_by_hex_id("0x11").select(F.lit("hex"), "place_id", "hex_id"))


@query(f"WITH {PLACES} SELECT name, CAST(c_custkey % 20 AS INTEGER) AS pos, count(*) OVER () AS total_results, CASE WHEN count(*) OVER () >= 12 THEN 32 END AS next_offset FROM places WHERE c_custkey // 20 = 1 QUALIFY c_custkey % 20 < 12")
def search_page(spark, sf_dir):
    """The second page of a search, cut to twelve results."""
    pages = responses(spark, sf_dir).select(F.lit("shops").alias("query"), (F.col("page") * 20).alias("offset"), decode.decoded(F.col("raw")).alias("response"))
    return Places({"responses": pages}).search("shops", 20, 12).select("name", "pos", "total_results", "next_offset")


_AREA = "SELECT c_custkey AS k, c_name, 35.9 + (c_custkey * 31 % 500) / 1000.0 AS s, -87.1 + (c_custkey * 17 % 500) / 1000.0 AS w FROM customer"


@query(f"SELECT 'area ' || k AS query, c_name || ', TN' AS display_name, round(s, 6) AS min_lat, round(w, 6) AS min_lon, round(s + 0.02, 6) AS max_lat, round(w + 0.02, 6) AS max_lon, 'node:' || k % 900 AS provider_id FROM ({_AREA})")
def locations_resolve(spark, sf_dir):
    rows = locations.resolve(b.geocoded(spark, sf_dir))
    return rows.select("query", "display_name", *(F.round(F.col("box")[c], 6).alias(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")), "provider_id")


@query(f"""WITH h AS (SELECT *, greatest(s, 36.0) AS a, greatest(w, -87.0) AS o, least(s + 0.02, 36.4) AS n, least(w + 0.02, -86.6) AS e FROM ({_AREA}) WHERE k % 7 <> 0),
v AS (SELECT *, s + 0.01 BETWEEN 36.0 AND 36.4 AND w + 0.01 BETWEEN -87.0 AND -86.6 AS own FROM h WHERE n > a AND e > o), u AS (SELECT *, row_number() OVER (PARTITION BY k % 900 ORDER BY k) AS rn FROM v)
SELECT c_name AS name, CAST(k % 900 AS VARCHAR) AS osm_id, round(a, 6) AS min_lat, round(CASE WHEN own THEN s + 0.01 ELSE (a + n) / 2 END, 6) AS lat FROM u WHERE rn = 1""")
def locations_subareas(spark, sf_dir):
    rows = locations.subareas(b.geocoded(spark, sf_dir), BOX, most=1_000_000)
    return rows.select("name", "osm_id", F.round("box.min_lat", 6).alias("min_lat"), F.round("lat", 6).alias("lat"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'text ' || p_partkey WHEN 1 THEN '<b>' || p_partkey || '</b>' WHEN 2 THEN 'mark ' || p_partkey ELSE '' END AS text, CASE WHEN p_size % 4 < 3 THEN 'http://f/' || p_partkey ELSE '' END AS final_url,
CASE p_size % 4 WHEN 3 THEN 'E' || p_partkey || ' too many' ELSE '' END AS error, CASE WHEN p_size % 4 = 3 THEN 'E' || p_partkey || ' too many' WHEN p_size % 3 = 0 THEN 'HTTP 503' ELSE '' END AS status_error FROM part""")
def provider_payloads(spark, sf_dir):
    k, size = F.col("p_partkey").cast("string"), F.col("p_size") % 4

    def of(template: str) -> Column:
        return F.replace(F.lit(template), F.lit("#"), k)

    tiny = F.when(size == 0, of('{"results":[{"text":"text #","final_url":"http://f/#"}]}')).otherwise(of('{"results":[{"text":"","html":"<b>#</b>","final_url":"http://f/#"}]}'))
    fire = F.when(size == 2, of('{"data":{"html":"","markdown":"mark #","metadata":{"sourceURL":"http://f/#"}}}')).otherwise(of('{"error":{"code":"E#","message":"too many"}}'))
    rows = table(spark, sf_dir, "part").withColumn("body", F.when(size < 2, tiny).otherwise(fire))
    got = F.when(size < 2, enrich.provider_payload(F.col("body"), "tinyfish")).otherwise(enrich.provider_payload(F.col("body"), "firecrawl"))
    status = F.when(F.col("p_size") % 3 == 0, 503).otherwise(200)
    return rows.withColumn("got", got).select("p_partkey", "got.text", "got.final_url", "got.error", enrich.provider_error(F.col("body"), status).alias("status_error"))


@query(f"WITH {PLACES} SELECT c_custkey, name, CASE WHEN c_custkey % 2 = 0 THEN lat ELSE lat + 0.5 END AS latitude, CASE WHEN c_custkey % 2 = 1 THEN category END AS address FROM places")
def guess_layout(spark, sf_dir):
    """Entries without a known layout, lists and objects."""
    lat, lon = F.col("lat").cast("string"), F.col("lon").cast("string")
    listed = F.concat(F.lit('[17,"0xab12","ab",'), F.to_json(F.struct("name")).substr(9, 1000))
    listed = F.concat(F.regexp_replace(listed, r"\}$", ""), F.lit(",[null,null,"), lat, F.lit(","), lon, F.lit("]]"))
    named = F.to_json(F.struct("name", (F.col("lat") + 0.5).alias("lat"), F.col("lon").alias("lng"), F.col("category").alias("vicinity")))
    rows = places(spark, sf_dir).withColumn("item", F.parse_json(F.when(F.col("c_custkey") % 2 == 0, listed).otherwise(named)))
    return parse.guess_places(rows, keep=("c_custkey",)).select("c_custkey", "name", "latitude", "address")


_RADIUS = "(1 + c_custkey % 9)"


@query(f"""WITH {PLACES} SELECT c_custkey, round(lat - {_RADIUS} / 111.32, 6) AS south, round(lon + {_RADIUS} / (111.32 * cos(radians(lat))), 6) AS east, round(2 * {_RADIUS}, 6) AS km, round(lat, 6) AS split_lat, CAST(least(15 + c_custkey % 9, 19) AS INTEGER) AS zoom, 2.0 AS ratio, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lat + 1 END AS max_lat FROM places""")
def box_geometry(spark, sf_dir):
    """Boxes around points, their extent and quarters, zoom by depth, view by zoom, and boxes from text."""
    k = F.col("c_custkey") % 9
    box = geo.box_around(F.col("lat"), F.col("lon"), (k + 1).cast("double"))
    text = F.when(F.col("c_custkey") % 3 == 0, "1,2,x,4").otherwise(F.concat_ws(",", "lat", "lon", F.col("lat") + 1, F.col("lon") + 1))
    return places(spark, sf_dir).withColumn("box", box).select("c_custkey", F.round("box.min_lat", 6).alias("south"), F.round("box.max_lon", 6).alias("east"), F.round(geo.box_km(F.col("box")), 6).alias("km"), F.round(geo.quarters(F.col("box"))[0]["max_lat"], 6).alias("split_lat"), geo.zoom_at(k).cast("int").alias("zoom"), (geo.view_metres(F.lit(14)) / geo.view_metres(F.lit(15))).alias("ratio"), geo.box_from_text(text)["max_lat"].alias("max_lat"))


@query(f"WITH {PLACES}, c AS ({_GRID}) SELECT 'g' || i || '-' || j AS key FROM c WHERE NOT EXISTS (SELECT 1 FROM places p WHERE {_HAVERSINE.format(lat1='c.lat', lon1='c.lon', lat2='p.lat', lon2='p.lon')} <= 1000)")
def gap_fill(spark, sf_dir):
    """A place recorded in every cell; those of cells that no known place covers are new."""
    cells = grid.generate_cells(spark, BOX, 2.0)
    pages = cells.select(F.concat(F.lit("gap:"), geo.cell_key(F.col("lat"), F.col("lon"))).alias("cell_key"), F.lit(0).alias("page"), F.lit(0).alias("rank"), F.concat(F.lit("g"), "i", F.lit("-"), "j").alias("key"), "lat", "lon")
    return collect.gap_fill(pages, places(spark, sf_dir).withColumnRenamed("place_id", "key"), BOX, 2.0).select("key")


@query(f"WITH {SITES} SELECT 'https://shop' || k || '.com' AS site, 'info@shop' || k || '.com,sales+x@shop' || k || '.com,a' || k || '@gmail.com,late' || k || '@gmail.com' AS emails, 'https://www.facebook.com/shop' || k AS facebook, 'second' AS late_source FROM (SELECT *, CAST(c_custkey AS VARCHAR) AS k FROM sites)")
def site_contacts(spark, sf_dir):
    """Two recorded pages of each site; the first that shows an address or a platform wins."""
    k = F.col("c_custkey").cast("string")
    first = sites(spark, sf_dir).select(F.concat(F.lit("https://shop"), k, F.lit(".com")).alias("site"), "c_custkey", F.lit(0).alias("page_order"), F.lit("first").alias("url"), "html")
    second = first.select("site", "c_custkey", F.lit(1).alias("page_order"), F.lit("second").alias("url"), F.concat(F.lit("info@shop"), k, F.lit(".com late"), k, F.lit('@gmail.com <a href="https://www.facebook.com/other">f</a>')).alias("html"))
    rows = enrich.site_contacts(first.unionByName(second))
    late = F.map_filter("sources", lambda key, _: key.startswith("late"))
    return rows.select("site", F.array_join("emails", ",").alias("emails"), F.col("socials")["facebook"].alias("facebook"), F.map_values(late)[0].alias("late_source"))


def _model(text: str, url: str) -> dict:
    """Stands for a user's model: what looks like an address, and one that no page holds."""
    return {"emails": [*re.findall(r"[a-z0-9]+@[a-z0-9]+[.]org", text), "Nobody@nowhere.zz"], "socials": {"x": "https://x.com/shop", "none": "https://none.example/a"}}


@query(f"WITH {SITES} SELECT place_id, 'b@other' || c_custkey || '.org' AS emails, 'x' AS socials FROM sites")
def contacts_by_model(spark, sf_dir):
    rows = enrich.extract_with_model(sites(spark, sf_dir).select("place_id", F.col("html").alias("text"), F.col("website").alias("url")), _model)
    return rows.select("place_id", F.array_join("emails", ",").alias("emails"), F.array_join(F.map_keys("socials"), ",").alias("socials"))


@query(f"""WITH {PLACES} SELECT name, place_id, round(lat, 6) AS lat, category, city, CASE WHEN city % 2 = 0 THEN 2 ELSE 3 END AS commit FROM places""")
def collection_sink(spark, sf_dir):
    """Places written as JSON lines with a manifest in one commit each: a first one that the second replaces, then a third."""
    recorded.register(spark)
    out = shared.folder(spark, "sink")
    rows = places(spark, sf_dir).select("name", "place_id", F.round("lat", 6).alias("lat"), "category", "city")
    for commit, mode, part in ((1, "append", rows), (2, "overwrite", rows.filter("city % 2 = 0")), (3, "append", rows.filter("city % 2 = 1"))):
        part.withColumn("commit", F.lit(commit)).write.format("collection").mode(mode).option("query", "shops").save(out)
    return sink.read(spark, out)


@query(f"WITH {PLACES} SELECT name, CASE WHEN c_custkey % 25 <> 0 THEN place_id END AS place_id, round(c_custkey % 50 / 10.0, 1) AS rating, c_custkey % 300 AS reviews, 'https://shop' || c_custkey || '.com' AS website, category || ' street' AS address, CAST(a AS DOUBLE) AS lat FROM places")
def csv_file(spark, sf_dir):
    """All parsed places through the CSV sink and back."""
    path = shared.folder(spark, "csv")
    recorded.write_csv(parse.parse_places(_entries(spark, sf_dir)), path)
    rows = spark.read.option("header", "true").csv(path)
    return rows.select("name", "place_id", F.col("rating").cast("double").alias("rating"), F.col("reviews").cast("long").alias("reviews"), "website", "address", F.col("lat").cast("double").alias("lat"))


@query(f"WITH {PLACES} SELECT name || ' | ' || CAST(c_custkey % 50 / 10.0 AS DOUBLE) || ' | ' || category AS value FROM places")
def text_lines(spark, sf_dir):
    return recorded.text_rows(parse.parse_places(_entries(spark, sf_dir)))


@query(f"""WITH {PLACES}, r AS (SELECT c_custkey, c_custkey % 700 AS key, CASE WHEN NOT (lat BETWEEN 36.05 AND 36.35 AND lon BETWEEN -86.95 AND -86.65) THEN 'outside_boundary' WHEN {_HAVERSINE.format(lat1='lat', lon1='lon', lat2='36.2', lon2='-86.8')} > 20 / 2.0 * sqrt(2) * 1000 THEN 'outside_footprint' END AS why FROM places),
d AS (SELECT *, row_number() OVER (PARTITION BY key, why IS NULL ORDER BY c_custkey) AS rn FROM r) SELECT c_custkey AS rank, coalesce(why, 'duplicate') AS reason FROM d WHERE why IS NOT NULL OR rn > 1""")
def reject_reasons(spark, sf_dir):
    """What the discovery counters count as dropped, row by row."""
    rows = places(spark, sf_dir).select(F.lit(0).alias("cell"), F.lit(0).alias("page"), F.col("c_custkey").alias("rank"), (F.col("c_custkey") % 700).alias("key"), "lat", "lon")
    lat, lon = F.col("lat"), F.col("lon")
    near = geo.haversine(lat, lon, F.lit(36.2), F.lit(-86.8)) <= geo.accept_radius(F.lit(20.0), 1.0)
    return discover.rejects(rows, geo.in_box(lat, lon, (36.05, -86.95, 36.35, -86.65)), near).select("rank", "reason")


@query(f"""WITH {occurrences_sql(150, 40)}, {_NEW}, q AS (SELECT *, new < 5 AS poor, sum(CASE WHEN new < 5 THEN 0 ELSE 1 END) OVER (PARTITION BY cell ORDER BY page) AS run FROM p)
SELECT cell, max(n) AS streak FROM (SELECT cell, run, count(*) FILTER (WHERE poor) AS n FROM q GROUP BY cell, run) GROUP BY cell""")
def exhaustion(spark, sf_dir):
    return discover.exhaustion(occurrences(spark, sf_dir, 150, 40))


@query(f"{_BUDGET} SELECT place_id, (contact_rank - 1) // 5 AS batch FROM q WHERE contact_rank <= 40")
def contact_batches(spark, sf_dir):
    return enrich.contact_batches(_with_status(spark, sf_dir)).select("place_id", "batch")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS DOUBLE) END AS retry_after FROM events")
def retry_after(spark, sf_dir):
    k = F.col("event_id")
    header = F.when(k % 3 == 0, F.concat(F.lit(" "), k.cast("string"))).when(k % 3 == 1, F.lit("Wed, 21 Oct 2015 07:28:00 GMT"))
    return table(spark, sf_dir, "events").select("event_id", metrics.retry_after(header).alias("retry_after"))


@query("SELECT event_id FROM events WHERE value > 95 ORDER BY event_id LIMIT 5")
def first_errors(spark, sf_dir):
    return metrics.first_errors(table(spark, sf_dir, "events"), F.col("value") > 95, "event_id").select("event_id")


@query("SELECT CAST(turn AS VARCHAR) AS review_id, role AS author_name, text FROM conversations WHERE conv_id = 1 ORDER BY turn LIMIT 2")
def reviews_of_place(spark, sf_dir):
    """The first two reviews of one place."""
    pages = _review_pages(spark, sf_dir).select(F.col("conv_id").cast("string").alias("hex_id"), F.col("turn").alias("page"), "response")
    return Places({"reviews": pages}).reviews("1", max_reviews=2).select("review_id", "author_name", "text")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '[' || c_custkey || ',\"a\"]' ELSE '' END AS state, '{\"name\":\"' || c_name || '\"}' AS linked, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS blocks FROM customer")
def embedded_json(spark, sf_dir):
    """JSON inside pages: initial state in every second one, linked data, and a block that doesn't parse."""
    k = F.col("c_custkey").cast("string")
    state = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("<script>window.APP_INITIALIZATION_STATE=["), k, F.lit(',"a"];</script>'))).otherwise("")
    html = F.concat(F.lit("<html>"), state, F.lit('<script type="application/ld+json">{"name":"'), F.col("c_name"), F.lit('"}</script><script>self.__AP = {broken};</script></html>'))
    rows = table(spark, sf_dir, "customer").select("c_custkey", decode.embedded_json(html).alias("found"))
    first = F.when(F.size("found") == 2, F.col("found")[0]).otherwise("")
    return rows.select("c_custkey", first.alias("state"), F.element_at("found", -1).alias("linked"), F.size("found").alias("blocks"))


@query("SELECT name, score FROM (SELECT event_type AS name, round(avg(value), 6) AS score FROM events GROUP BY event_type UNION ALL SELECT 'all', round(avg(value), 6) FROM events) ORDER BY score DESC, name LIMIT 1")
def promote_best(spark, sf_dir):
    """Candidates' scores put into one frame, and the one to promote."""
    e = table(spark, sf_dir, "events")
    each = e.groupBy(F.col("event_type").alias("name")).agg(F.round(F.avg("value"), 6).alias("score"), F.lit(1).alias("latency_ms"))
    whole = metrics.compare({"all": e.agg(F.round(F.avg("value"), 6).alias("score"), F.lit(1).alias("latency_ms"))})
    return metrics.promote(each.unionByName(whole)).select("name", "score")


# The engine's own relational operators, over the same tables


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


def _totals(groups) -> DataFrame:
    return groups.agg(F.count(F.lit(1)).alias("n")).select(F.coalesce(F.col("city").cast("string"), F.lit("*")).alias("city"), F.coalesce("category", F.lit("*")).alias("category"), "n")


@query("SELECT coalesce(city, '*') AS city, coalesce(category, '*') AS category, count(*) AS n FROM (SELECT CAST(c_nationkey AS VARCHAR) AS city, c_mktsegment AS category FROM customer) GROUP BY ROLLUP (city, category)")
def coverage_rollup(spark, sf_dir):
    return _totals(places(spark, sf_dir).rollup("city", "category"))


@query("SELECT coalesce(city, '*') AS city, coalesce(category, '*') AS category, count(*) AS n FROM (SELECT CAST(c_nationkey AS VARCHAR) AS city, c_mktsegment AS category FROM customer) GROUP BY CUBE (city, category)")
def coverage_cube(spark, sf_dir):
    return _totals(places(spark, sf_dir).cube("city", "category"))


@query("SELECT r_name, count(DISTINCT c_custkey) AS places, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def region_totals(spark, sf_dir):
    """Orders are counted by customer before they meet the dimensions."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    where = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(where, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("r_name").agg(F.count(F.lit(1)).alias("places"), F.sum("n").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_orders(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT user_id, session, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN gap IS NULL OR gap > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)) GROUP BY user_id, session")
def sessions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf_dir, "events").withColumn("s", seconds).withColumn("gap", F.col("s") - F.lag("s").over(w))
    new = F.when(F.col("gap").isNull() | (F.col("gap") > 3600), 1).otherwise(0)
    return e.withColumn("session", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))
