"""Tilings: fixed grids, zoom levels, adaptive quadtrees and the cells that no place covers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeflow.functions import geo
from placeflow.operators import shared

Box = tuple[float, float, float, float]
SIZES = (0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 10.0, 15.0, 20.0, 50.0, 100.0)


def steps(box: Box, cell_km: float) -> tuple[float, float]:
    """Degrees of latitude and longitude of a cell."""
    cell_km = cell_km if cell_km > 0 else 1.0
    narrow = max(math.cos(math.radians((box[0] + box[2]) / 2)), 1e-6)
    return cell_km / geo.KM_PER_DEGREE, cell_km / (geo.KM_PER_DEGREE * narrow)


def _centres(low: float, high: float, step: float) -> int:
    """How many centres, half a step in and a step apart, lie below `high`."""
    n = max(0, math.ceil((high - low) / step - 0.5))
    while n and low + (n - 0.5) * step >= high:
        n -= 1
    while low + (n + 0.5) * step < high:
        n += 1
    return n


def generate_cells(spark: SparkSession, box: Box, cell_km: float = 1.0) -> DataFrame:
    """(i, j, lat, lon) of the cell centres; the box's centre if no cell fits. Rows are made by the executors."""
    dlat, dlon = steps(box, cell_km)
    n, m = _centres(box[0], box[2], dlat), _centres(box[1], box[3], dlon)
    if not n or not m:
        return spark.range(1).select(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit((box[0] + box[2]) / 2).alias("lat"), F.lit((box[1] + box[3]) / 2).alias("lon"))
    i, j = F.floor(F.col("id") / m).cast("long"), F.pmod("id", F.lit(m)).cast("long")
    return spark.range(n * m).select(i.alias("i"), j.alias("j"), (F.lit(box[0]) + (i + 0.5) * dlat).alias("lat"), (F.lit(box[1]) + (j + 0.5) * dlon).alias("lon"))


def estimate_cells(box: Box, cell_km: float) -> int:
    dlat, dlon = steps(box, cell_km)
    return math.ceil((box[2] - box[0]) / dlat) * math.ceil((box[3] - box[1]) / dlon)


def estimates(spark: SparkSession, box: Box, target: int = 100) -> DataFrame:
    """(km, cells, chosen) of each size of the ladder; the smallest with at most `target` cells is chosen."""
    height, width = box[2] - box[0], box[3] - box[1]
    narrow = F.greatest(F.cos(F.radians(F.lit((box[0] + box[2]) / 2))), F.lit(1e-6))
    km = F.col("km")
    cells = F.ceil(F.lit(height) / (km / F.lit(geo.KM_PER_DEGREE))) * F.ceil(F.lit(width) / (km / (F.lit(geo.KM_PER_DEGREE) * narrow)))
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, SIZES))).alias("km")).withColumn("cells", cells.cast("long"))
    return rows.withColumn("chosen", km.eqNullSafe(rows.filter(F.col("cells") <= target).agg(F.min("km")).scalar()))


def choose_cell_size(box: Box, target: int = 100) -> float:
    """The smallest size of the ladder with at most `target` cells; beyond it, the last size scaled up."""
    for size in SIZES:
        if estimate_cells(box, size) <= target:
            return size
    size = math.ceil(100 * math.sqrt(estimate_cells(box, 100.0) / target) * 10) / 10
    while estimate_cells(box, size) > target:
        size = round(size * 1.02, 1)
    return size


def zoom_level_cells(spark: SparkSession, box: Box, low_km: float = 1.0, high_km: float = 10.0, levels: int = 3) -> DataFrame:
    """(level, cell_km, i, j, lat, lon): grids of log-spaced sizes, fine to coarse; a centre (to six decimals) counts once, at its first level."""
    rows = None
    for level in range(levels):
        share = level / (levels - 1) if levels > 1 else 0.0
        size = math.exp(math.log(low_km) + share * (math.log(high_km) - math.log(low_km)))
        cells = generate_cells(spark, box, size).select(F.lit(level).alias("level"), F.lit(size).alias("cell_km"), "i", "j", "lat", "lon")
        rows = cells if rows is None else rows.unionByName(cells)
    first = Window.partitionBy(F.round("lat", 6), F.round("lon", 6)).orderBy("level", "i", "j")
    return rows.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")


# The same for boxes of a table: column `box` with min_lat, min_lon, max_lat, max_lon.


def boxes_of(places: DataFrame, *by: str) -> DataFrame:
    """(by..., box): the box around each group's places; places without coordinates have no part in it."""
    sides = (F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"))
    rows = places.dropna(subset=["lat", "lon"]).groupBy(*by).agg(*sides)
    return rows.select(*by, F.struct("min_lat", "min_lon", "max_lat", "max_lon").alias("box"))


def _steps_of(box: Column, km: Column) -> tuple[Column, Column]:
    narrow = F.greatest(F.cos(F.radians((box["min_lat"] + box["max_lat"]) / 2)), F.lit(1e-6))
    return km / F.lit(geo.KM_PER_DEGREE), km / (F.lit(geo.KM_PER_DEGREE) * narrow)


def _centres_of(low: Column, high: Column, step: Column) -> Column:
    """`_centres` as a column."""
    n = F.greatest(F.ceil((high - low) / step - 0.5), F.lit(0))
    return F.when((n > 0) & (low + (n - 0.5) * step >= high), n - 1).when(low + (n + 0.5) * step < high, n + 1).otherwise(n).cast("long")


def cells_of(boxes: DataFrame, km: Column) -> DataFrame:
    """The boxes' rows with i, j, lat, lon: a row for each cell centre; the box's centre where no cell fits. Boxes are dealt
    out before they are filled."""
    box, (dlat, dlon) = F.col("box"), _steps_of(F.col("box"), km)
    rows, columns = _centres_of(box["min_lat"], box["max_lat"], dlat), _centres_of(box["min_lon"], box["max_lon"], dlon)
    none = (rows == 0) | (columns == 0)
    own = boxes.withColumn("_none", none).withColumn("_n", F.when(none, 1).otherwise(rows * columns)).withColumn("_m", F.when(none, 1).otherwise(columns))
    own = own.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long") - 1)))
    own = own.withColumn("i", F.floor(F.col("_k") / F.col("_m")).cast("long")).withColumn("j", F.pmod("_k", "_m").cast("long"))
    lat = F.when(F.col("_none"), (box["min_lat"] + box["max_lat"]) / 2).otherwise(box["min_lat"] + (F.col("i") + 0.5) * dlat)
    lon = F.when(F.col("_none"), (box["min_lon"] + box["max_lon"]) / 2).otherwise(box["min_lon"] + (F.col("j") + 0.5) * dlon)
    return own.withColumn("lat", lat).withColumn("lon", lon).drop("_none", "_n", "_m", "_k")


def zoom_cells_of(boxes: DataFrame, by: tuple[str, ...], low_km: float = 1.0, high_km: float = 10.0, levels: int = 3) -> DataFrame:
    """`cells_of` on log-spaced sizes, fine to coarse, with `level` and `cell_km`; a centre of a box (to six decimals) counts
    once, at its first level."""
    share = [level / (levels - 1) if levels > 1 else 0.0 for level in range(levels)]
    sizes = F.array(*(F.struct(F.lit(k).alias("level"), F.lit(math.exp(math.log(low_km) + x * (math.log(high_km) - math.log(low_km)))).alias("cell_km")) for k, x in enumerate(share)))
    cells = cells_of(boxes.withColumn("_s", F.explode(sizes)).select("*", "_s.*").drop("_s"), F.col("cell_km"))
    first = Window.partitionBy(*by, F.round("lat", 6), F.round("lon", 6)).orderBy("level", "i", "j")
    return cells.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")


def estimates_of(boxes: DataFrame, target: int = 100) -> DataFrame:
    """The boxes' rows with km, cells and chosen: each size of the ladder; the smallest of at most `target` cells is chosen."""
    box = F.col("box")

    def cells(km: Column) -> Column:
        dlat, dlon = _steps_of(box, km)
        return (F.ceil((box["max_lat"] - box["min_lat"]) / dlat) * F.ceil((box["max_lon"] - box["min_lon"]) / dlon)).cast("long")

    sizes = F.array(*map(F.lit, SIZES))
    smallest = F.array_min(F.filter(sizes, lambda km: cells(km) <= target))
    rows = boxes.withColumn("_smallest", smallest).withColumn("km", F.explode(sizes)).withColumn("cells", cells(F.col("km")))
    return rows.withColumn("chosen", F.col("km").eqNullSafe(F.col("_smallest"))).drop("_smallest")


def assign_cells(places: DataFrame, box: Box, cell_km: float) -> DataFrame:
    """Each place with the indices of its cell; arithmetic, no join."""
    dlat, dlon = steps(box, cell_km)
    return places.withColumn("i", F.floor((F.col("lat") - box[0]) / dlat).cast("long")).withColumn("j", F.floor((F.col("lon") - box[1]) / dlon).cast("long"))


def quadtree(points: DataFrame, row: Column, col: Column, bits: int = 12, depth: int = 6, saturation: int = 120, root_km: float = 44.5, min_km: float = 0.2) -> DataFrame:
    """(depth, row, col, n, splits) of every cell that is searched: all its ancestors split.

    `row` and `col` are integers of `bits` bits. Points are counted at the deepest level once and
    summed upwards, so one shuffle of the points serves all levels. A cell splits at `saturation`
    points unless it is at `depth` or its half would be under `min_km`.
    """
    counts = points.select(F.shiftright(row, bits - depth).alias("row"), F.shiftright(col, bits - depth).alias("col")).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
    levels = counts.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"), "row", "col", "n")
    at = F.lit(depth) - F.col("depth")
    cells = levels.select("depth", F.call_function("shiftright", "row", at.cast("int")).alias("row"), F.call_function("shiftright", "col", at.cast("int")).alias("col"), "n").groupBy("depth", "row", "col").agg(F.sum("n").alias("n"))
    fits = F.lit(root_km) / F.pow(F.lit(2.0), F.col("depth") + 1) >= min_km
    cells = cells.withColumn("splits", (F.col("n") >= saturation) & (F.col("depth") < depth) & fits)
    # Counts grow towards the root, so a cell's ancestors all split exactly if its parent does.
    parents = cells.filter("splits").select((F.col("depth") + 1).alias("depth"), F.col("row").alias("up_row"), F.col("col").alias("up_col"))
    below = cells.withColumn("up_row", F.shiftright("row", 1)).withColumn("up_col", F.shiftright("col", 1))
    return cells.filter("depth = 0").unionByName(below.filter("depth > 0").join(parents, ["depth", "up_row", "up_col"], "left_semi").drop("up_row", "up_col"))


@dataclass
class Searched:
    """What an adaptive search found: the places of its leaf cells, a key once, and all cells that it searched."""

    places: DataFrame
    cells: DataFrame

    def report(self) -> DataFrame:
        """One row: cells searched, split, saturated (split ones too) and leaf ones, the greatest depth, unique places."""
        own = self.cells.agg(F.count(F.lit(1)).alias("cells_searched"), F.count_if("splits").alias("cells_subdivided"), F.count_if("saturated").alias("saturated_cells"), F.count_if(~F.col("splits")).alias("leaf_cells"), F.max("depth").alias("max_depth"))
        return own.withColumn("unique_places", F.lit(self.places.count()))


def search_table(search: Callable[[float, float, float, float], Iterable[tuple]], schema: str):
    """A table function of (lat, lon, zoom, cell_km) from a user's search; rows get their `rank` in front."""

    class Search:
        def eval(self, lat, lon, zoom, km):
            for rank, row in enumerate(search(lat, lon, zoom, km)):
                yield (rank, *row)

    return F.udtf(Search, returnType=f"rank int, {schema}")


def adaptive_search(spark: SparkSession, box: Box, search: Callable[[float, float, float, float], Iterable[tuple]], schema: str, key: str = "place_id", saturation: int = 120, min_km: float = 0.2, base_zoom: int = 15, max_zoom: int = 19, max_depth: int = 6) -> Searched:
    """A quadtree over a user's search: `search(lat, lon, zoom, cell_km)` gives a cell's places as tuples of `schema`.

    Each level is one job: cells meet the search laterally, each in a task of its own, and what it gave is written. A cell with
    `saturation` places or more is split unless it is at `max_depth` or its half would be under `min_km`; then, as in
    any other leaf, its places stay. Of a key the first stays, by depth, cell and rank; places without a key all stay. The search
    runs on the executors, once a cell unless a task is lost.
    """
    table, path = search_table(search, schema), shared.folder(spark, "adaptive")
    parts = [F.lit(float(v)).alias(n) for v, n in zip(box, ("min_lat", "min_lon", "max_lat", "max_lon"), strict=True)]
    frontier = spark.range(1).select(F.lit(0).alias("depth"), F.lit("").alias("cell"), F.struct(*parts).alias("box"))
    found, cells = None, None
    for depth in range(max_depth + 1):
        level = frontier.withColumn("lat", (F.col("box.min_lat") + F.col("box.max_lat")) / 2).withColumn("lon", (F.col("box.min_lon") + F.col("box.max_lon")) / 2)
        level = level.withColumn("km", geo.box_km(F.col("box"))).withColumn("zoom", geo.zoom_at(F.col("depth"), base_zoom, max_zoom).cast("double"))
        level = shared.kept(level, f"{path}/cells-{depth}")
        dealt = level.repartition(max(1, min(level.count(), 10_000)), "cell").select("depth", "cell", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "zoom", "km")
        rows = dealt.lateralJoin(table(F.col("_lat").outer(), F.col("_lon").outer(), F.col("zoom").outer(), F.col("km").outer())).drop("_lat", "_lon", "zoom", "km")
        rows = shared.kept(rows, f"{path}/found-{depth}")
        counts = level.join(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell", "left").na.fill(0, ["n"])
        full = F.col("n") >= saturation
        counted = shared.kept(counts.withColumn("saturated", full).withColumn("splits", full & (F.col("depth") < max_depth) & (F.col("km") / 2 >= min_km)), f"{path}/counted-{depth}")
        leaf = rows.join(counted.filter("NOT splits").select("cell"), "cell", "left_semi")
        found, cells = (leaf, counted) if found is None else (found.unionByName(leaf), cells.unionByName(counted))
        split = counted.filter("splits").select((F.col("depth") + 1).alias("depth"), "cell", F.posexplode(geo.quarters(F.col("box"))).alias("i", "box"))
        frontier = split.select("depth", F.concat("cell", F.col("i").cast("string")).alias("cell"), "box")
        if frontier.isEmpty():
            break
    first = Window.partitionBy(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\0"), "cell", F.lit(" "), F.col("rank").cast("string")))).orderBy("depth", "cell", "rank")
    return Searched(found.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn"), cells)


#: Bands of the occupancy index in a radius.
FINE = 4


def occupied_bands(places: DataFrame, step_lat: float, step_lon: float) -> DataFrame:
    """(row, col): the bands of the grid of these steps that hold a place: as many as the area has, however many places there
    are, and combined where places are read."""
    return places.select(F.floor(F.col("lat") / step_lat).cast("long").alias("row"), F.floor(F.col("lon") / step_lon).cast("long").alias("col")).dropna().distinct()


def uncovered_cells(cells: DataFrame, places: DataFrame, radius_km: float, box: Box) -> DataFrame:
    """The cells with no place within `radius_km` of their centre.

    Places are first reduced to the fine bands that hold one. Bands that lie within the radius of a centre cover its cell
    at once, those beyond it can't; only for cells with an occupied band across the circle and none inside it are the places of
    those bands looked at, by an equi-join on the band.
    """
    band_lat = radius_km / geo.KM_PER_DEGREE
    narrow = max(min(math.cos(math.radians(box[0])), math.cos(math.radians(box[2]))) * 0.99, 1e-6)
    step_lat, step_lon = band_lat / FINE, band_lat / narrow / FINE
    metres = radius_km * 1000
    lat, lon = F.col("lat"), F.col("lon")

    def reach(value: Column, step: float) -> Column:
        own = F.floor(value / step).cast("long")
        return F.explode(F.sequence(own - FINE - 1, own + FINE + 1))

    # Degrees as metres on a plane: longitudes shrink at most to `low` and at least to `high` within reach of a centre.
    degree = math.radians(1) * geo.EARTH_METRES
    high = F.cos(F.radians(F.greatest(F.abs(lat) - 2 * band_lat, F.lit(0.0))))
    low = F.cos(F.radians(F.least(F.abs(lat) + 2 * band_lat, F.lit(90.0))))
    south, west = F.col("row") * step_lat, F.col("col") * step_lon

    def square(y: Column, x: Column, shrink: Column) -> Column:
        return F.pow(y * degree, 2) + F.pow(x * degree * shrink, 2)

    nearest = square(F.greatest(south - lat, lat - south - step_lat, F.lit(0.0)), F.greatest(west - lon, lon - west - step_lon, F.lit(0.0)), low)
    farthest = square(F.greatest(F.abs(lat - south), F.abs(lat - south - step_lat)), F.greatest(F.abs(lon - west), F.abs(lon - west - step_lon)), high)
    occupied = occupied_bands(places, step_lat, step_lon)
    bands = cells.select("lat", "lon").withColumn("row", reach(lat, step_lat)).withColumn("col", reach(lon, step_lon))
    bands = bands.filter(nearest <= (metres * 1.01) ** 2).join(occupied, ["row", "col"])  # a margin for the sphere on either side
    sure = F.max(farthest <= (metres * 0.99) ** 2).over(Window.partitionBy("lat", "lon"))
    met = bands.withColumn("_sure", sure)
    open_ = met.filter("NOT _sure").select("row", "col", "lat", "lon")
    spots = places.select(F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")).dropna()
    spots = spots.withColumn("row", F.floor(F.col("p_lat") / step_lat).cast("long")).withColumn("col", F.floor(F.col("p_lon") / step_lon).cast("long"))
    hit = open_.join(spots, ["row", "col"]).filter(geo.haversine(lat, lon, F.col("p_lat"), F.col("p_lon")) <= metres).select("lat", "lon")
    covered = met.filter("_sure").select("lat", "lon").union(hit)
    return cells.join(covered, ["lat", "lon"], "left_anti").select(cells.columns)


def fence_with_fallback(cells: DataFrame, inside: Column) -> DataFrame:
    """The cells inside the fence, or all of them if none is."""
    inside = F.coalesce(inside, F.lit(False))
    any_in = cells.agg(F.coalesce(F.bool_or(inside), F.lit(False)).alias("any_in"))  # one row
    return cells.filter(inside | ~any_in.scalar())
