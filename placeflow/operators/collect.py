"""Collection over recorded pages, level by level.

A level: the frontier of cells meets the recorded pages of its cells, pages are cut at the paging rule, results pass
fence and footprint, the first row of each new key stays, and cells that are saturated and productive are split into
four for the next level. A parent's results stay. The loop runs at most `max_depth` + 1 times whatever the data, and
each level is written and read back. A recorded page may be a refusal: a row with `error` set ends its cell there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from placeflow.functions import geo
from placeflow.operators import discover, grid, metrics, shared

#: Columns of recorded pages: cell_key, page, rank, key, lat, lon and whatever else describes a place.
PAGES = ("cell_key", "page", "rank", "key", "lat", "lon")


@dataclass
class Settings:
    cell_km: float = 5.0
    base_zoom: int = 16
    max_zoom: int = 19
    max_depth: int = 1
    min_cell_km: float = 0.25
    page_cap: int = 6
    full_page: int = 20
    area_cap: int = 120
    max_results: int = 500
    buffer: float = 1.5
    #: New means new to all cells of the level that come before, as if they were read in turn; else to the cell's own pages.
    across_cells: bool = True


@dataclass
class Collected:
    places: DataFrame
    cells: DataFrame
    settings: Settings = field(default_factory=Settings)

    def counters(self) -> DataFrame:
        """One row of totals; raw = retained + duplicates + both outsides. A cell that was refused counts as failed, and as
        completed too if it had shown anything before."""
        c = self.cells
        sums = [F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in ("requests", "raw", "kept", "outside_boundary", "outside_footprint")]
        return c.agg(F.count(F.lit(1)).alias("cells_total"), *sums, F.count_if("splits").alias("cells_subdivided"), F.count_if(F.col("saturated") & ~F.col("splits")).alias("cells_saturated"), F.count_if("failed").alias("cells_failed"), F.count_if(~F.col("failed") | (F.col("raw") > 0)).alias("cells_completed"), F.max("depth").alias("max_depth")).withColumn("duplicates", F.col("raw") - F.col("kept") - F.col("outside_boundary") - F.col("outside_footprint"))

    def manifest(self) -> DataFrame:
        """One row: status, reasons and counters."""
        rows = self.counters().withColumn("cap_reached", F.col("kept") >= self.settings.max_results)
        return metrics.completeness(rows).withColumn("status", F.when(F.col("complete"), "complete").otherwise("incomplete"))


def seeds(spark: SparkSession, box: grid.Box, inside: Column | None, settings: Settings) -> DataFrame:
    """The first frontier: fenced cells of the grid, or all if the fence holds none."""
    cells = grid.generate_cells(spark, box, settings.cell_km)
    if inside is not None:
        cells = grid.fence_with_fallback(cells, inside)
    dlat, dlon = grid.steps(box, settings.cell_km)
    return cells.select("lat", "lon", F.lit(dlat).alias("dlat"), F.lit(dlon).alias("dlon"), F.lit(settings.cell_km).alias("cell_km"), F.lit(0).alias("depth"), F.lit(settings.base_zoom).alias("zoom"))


def _children(cells: DataFrame) -> DataFrame:
    signs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(o).alias("o")) for a in (-1, 1) for o in (-1, 1)))
    rows = cells.withColumn("s", F.explode(signs))
    return rows.select((F.col("lat") + F.col("s.a") * F.col("dlat") / 4).alias("lat"), (F.col("lon") + F.col("s.o") * F.col("dlon") / 4).alias("lon"), (F.col("dlat") / 2).alias("dlat"), (F.col("dlon") / 2).alias("dlon"), (F.col("cell_km") / 2).alias("cell_km"), (F.col("depth") + 1).alias("depth"), (F.col("zoom") + 1).alias("zoom"))


def collect(pages: DataFrame, box: grid.Box, inside: Column | None = None, settings: Settings | None = None, completed: DataFrame | None = None, seen: DataFrame | None = None, observer: Callable[[dict], None] | None = None) -> Collected:
    """Places of an area from its recorded pages.

    `inside` is a condition on lat and lon (default: the box). `completed` names cell_keys that an earlier
    run finished, `seen` its keys. A cell is read to its first page that keeps nothing new, to its first short page or
    to a refused one; new are keys that neither an earlier run nor an earlier level nor an earlier page has shown, of
    the cell itself or, with `across_cells`, of the level's cells before it. The order of "first" is depth, then
    cell_key, page and rank. A refusal isn't a request and shows nothing; a cell refused before it showed anything isn't
    split. `observer` gets each finished level's depth, cells and kept places, counted as the level is written.
    """
    spark, settings = pages.sparkSession, settings or Settings()
    inside = inside if inside is not None else geo.in_box(F.col("lat"), F.col("lon"), box)
    path = shared.folder(spark, "collect")
    pages = pages.filter(F.col("page") < settings.page_cap)
    if "error" not in pages.columns:
        pages = pages.withColumn("error", F.lit(None).cast("string"))
    frontier, places, cells = seeds(spark, box, inside, settings), None, None
    for depth in range(settings.max_depth + 1):
        level = frontier.withColumn("cell_key", geo.cell_key(F.col("lat"), F.col("lon"))).withColumnsRenamed({"lat": "cell_lat", "lon": "cell_lon"})
        if completed is not None:
            level = discover.resume(level, completed)
        level = shared.kept(level, f"{path}/frontier-{depth}")
        rows = pages.join(level, "cell_key").withColumn("cell", F.col("cell_key"))
        fits = geo.haversine(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon")) <= geo.accept_radius(F.col("cell_km"), settings.buffer)
        rows = rows.withColumn("in_fence", F.coalesce(inside, F.lit(False))).withColumn("good", F.col("error").isNull() & F.col("in_fence") & F.coalesce(fits, F.lit(False)))
        known = None if places is None else places.select("key")
        if seen is not None:
            known = seen.select("key") if known is None else known.union(seen.select("key"))
        good = rows.filter("good")
        if known is not None:
            good = good.join(known.distinct(), "key", "left_anti")
        refused = F.bool_or(F.col("error").isNotNull())
        sizes = rows.groupBy("cell", "page").agg((refused | (F.count(F.lit(1)) < settings.full_page)).alias("ends"))
        if settings.across_cells:
            stop = discover.stops_across(sizes, good.select("cell", "page", "key"), lambda df, name: shared.kept(df, f"{path}/stops-{depth}/{name}"))  # noqa: B023
        else:
            novel = discover.page_novelty(good, "key").select("cell", "page", "new")
            stop = sizes.join(novel, ["cell", "page"], "left").groupBy("cell").agg(F.min(F.when(F.col("ends") | (F.coalesce("new", F.lit(0)) == 0), F.col("page"))).alias("stop"))
        read = shared.kept(rows.join(stop, "cell").filter(F.col("stop").isNull() | (F.col("page") <= F.col("stop"))).drop("stop"), f"{path}/read-{depth}")
        fresh = read.filter("good")
        if known is not None:
            fresh = fresh.join(known.distinct(), "key", "left_anti")
        fresh = shared.kept(discover.first_wins(fresh, "key", ("cell", "page", "rank")).drop("error"), f"{path}/places-{depth}")
        answered = F.col("error").isNull()
        full = read.groupBy("cell_key", "page").agg(refused.alias("refused"), F.count_if(answered).alias("n"), F.count_if(answered & ~F.col("in_fence")).alias("b"), F.count_if(answered & F.col("in_fence") & ~F.col("good")).alias("f"))
        stats = full.groupBy("cell_key").agg(F.count_if(~F.col("refused")).alias("requests"), F.sum("n").alias("raw"), F.sum("b").alias("outside_boundary"), F.sum("f").alias("outside_footprint"), F.count_if(F.col("n") >= settings.full_page).alias("full_pages"), F.bool_or("refused").alias("failed"))
        kept = fresh.groupBy("cell_key").agg(F.count(F.lit(1)).alias("kept"))
        done = level.join(stats, "cell_key", "left").join(kept, "cell_key", "left").na.fill(0, ["requests", "raw", "outside_boundary", "outside_footprint", "full_pages", "kept"]).na.fill(False, ["failed"])
        saturated, splits = discover.split_decision(settings.full_page, settings.area_cap, settings.page_cap, settings.max_depth, settings.min_cell_km, settings.max_zoom)
        counted = Observation()
        done = done.withColumn("saturated", saturated).withColumn("splits", splits)
        done = done.observe(counted, F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"), F.count_if("splits").alias("splits"), F.count_if("failed").alias("failed"))
        done = shared.kept(done, f"{path}/cells-{depth}")
        level_counts = counted.get
        if observer is not None:
            observer({"depth": depth, **level_counts})
        places = fresh if places is None else places.unionByName(fresh)
        cells = done if cells is None else cells.unionByName(done)
        frontier = _children(done.filter("splits").withColumnsRenamed({"cell_lat": "lat", "cell_lon": "lon"}))
        found = level_counts["kept"] + (0 if depth == 0 else found)
        if not level_counts["splits"] or found >= settings.max_results:
            break
    capped = discover.global_cap(places.withColumn("cell", F.struct("depth", "cell_key")), settings.max_results).drop("cell")
    return Collected(capped, cells, settings)


def gap_fill(pages: DataFrame, found: DataFrame, box: grid.Box, cell_km: float = 2.0, streak: int = 12) -> DataFrame:
    """New places of the cells that no found place covers, in grid order until `streak` cells in a row keep nothing.
    Pages of a gap have the cell_key gap:<key>; two are read at most."""
    gaps = grid.uncovered_cells(grid.generate_cells(pages.sparkSession, box, cell_km), found, cell_km / 2, box)
    keyed = gaps.withColumn("cell_key", F.concat(F.lit("gap:"), geo.cell_key(F.col("lat"), F.col("lon")))).select("i", "j", "cell_key", F.col("lat").alias("cell_lat"), F.col("lon").alias("cell_lon"))
    rows = pages.filter("page < 2").join(keyed, "cell_key").join(found.select("key").distinct(), "key", "left_anti")
    near = geo.haversine(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon")) <= geo.accept_radius(F.lit(cell_km))
    fresh = discover.first_wins(rows.filter(near).withColumn("cell", F.struct("i", "j")), "key")
    per_cell = keyed.join(fresh.groupBy("cell_key").agg(F.count(F.lit(1)).alias("kept")), "cell_key", "left").na.fill(0, ["kept"])
    width = grid._centres(box[1], box[3], grid.steps(box, cell_km)[1])
    dense = dense_ranks(per_cell, F.col("i") * width + F.col("j"))
    tried = discover.empty_streak(dense, most=streak)
    return fresh.join(tried.select("cell_key"), "cell_key", "left_semi").drop("cell")


def dense_ranks(cells: DataFrame, order: Column, block: int = 4096) -> DataFrame:
    """With `seq`, the cells' rank in `order`, from counts by block: no window over all rows."""
    own = cells.withColumn("_o", order).withColumn("_g", F.floor(F.col("_o") / block))
    counts = own.groupBy("_g").agg(F.count(F.lit(1)).alias("_c")).withColumn("_h", F.floor(F.col("_g") / block))
    inner = counts.withColumn("_b", F.sum("_c").over(Window.partitionBy("_h").orderBy("_g")) - F.col("_c"))
    outer = counts.groupBy("_h").agg(F.sum("_c").alias("_c")).withColumn("_a", F.sum("_c").over(Window.orderBy("_h")) - F.col("_c"))
    before = inner.join(outer.select("_h", "_a"), "_h").select("_g", (F.col("_a") + F.col("_b")).alias("_before"))
    return own.join(before, "_g").withColumn("seq", F.col("_before") + F.row_number().over(Window.partitionBy("_g").orderBy("_o")) - 1).drop("_o", "_g", "_before")
