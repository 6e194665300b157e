"""Discovery over recorded pages: first-wins deduplication, provenance, paging rules and resumption.

Every "first" follows the total order (cell, page, rank).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

ORDER = ("cell", "page", "rank")


def first_wins(rows: DataFrame, key: str = "key", order: tuple[str, ...] = ORDER) -> DataFrame:
    """The first row of each key."""
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter("_rn = 1").drop("_rn")


def provenance(rows: DataFrame, key: str = "key") -> DataFrame:
    """(key, first cell, the distinct cells in order of first sight). Pre-aggregated by (key, cell)."""
    cells = rows.groupBy(key, "cell").agg(F.min(F.struct("page", "rank")).alias("at"))
    return cells.groupBy(key).agg(F.array_sort(F.collect_list("cell")).alias("cells")).withColumn("first_cell", F.col("cells")[0])


def page_novelty(rows: DataFrame, key: str = "key", scope: tuple[str, ...] = ("cell",)) -> DataFrame:
    """(cell, page, n, new): rows of each page and how many show a key for the first time in the scope."""
    first = rows.groupBy(*scope, key).agg(F.min(F.struct("page", "rank")).alias("f")) if "cell" in scope else rows.groupBy(key).agg(F.min(F.struct("cell", "page", "rank")).alias("f"))
    new = first.select(*(scope if "cell" in scope else ["f.cell"]), F.col("f.page").alias("page")).groupBy("cell", "page").agg(F.count(F.lit(1)).alias("new"))
    sizes = rows.groupBy("cell", "page").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(new, ["cell", "page"], "left").select("cell", "page", "n", F.coalesce("new", F.lit(0)).cast("long").alias("new"))


def page_stops(rows: DataFrame, key: str = "key", full_page: int | None = None, page_cap: int = 6) -> DataFrame:
    """(cell, stop_page): the last page a cell is read to. It stops at its first page without a new key, with
    `full_page` also at its first shorter page; else at the cap (null: it never met a stop rule)."""
    stops = F.col("new") == 0
    if full_page is not None:
        stops = stops | (F.col("n") < full_page)
    return page_novelty(rows.filter(F.col("page") < page_cap), key).groupBy("cell").agg(F.min(F.when(stops, F.col("page"))).alias("stop_page"), F.max("page").alias("last_page"))


def stops_across(pages: DataFrame, shown: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(cell, stop): the page that ends each cell where cells are read one after the other, in the order of `cell`, and a
    page without a key that is new to all of them ends its cell. A null stop: the cell is read to its last page.

    `pages` is (cell, page, ends): whether a page ends its cell whatever it shows. `shown` is (cell, page, key): what
    may count as new. `keep(frame, name)` writes a frame and reads it back.

    What a cell leaves new depends on how far earlier cells are read, and that on cells before them: a fixpoint. Given all
    stops, the first reader of each key follows, and from those the stops again, until none changes. The first k cells
    are right after k rounds, so it ends, and it takes as many rounds as the longest chain of cells that change each other.
    Keys that a single cell shows are counted once and take no part.
    """
    first = keep(shown.groupBy("cell", "key").agg(F.min("page").alias("page")), "shown")
    several = first.groupBy("key").agg(F.count(F.lit(1)).alias("cells")).filter("cells > 1").select("key")
    several = keep(several, "several")
    shared = keep(first.join(several, "key", "left_semi"), "shared")
    alone = first.join(several, "key", "left_anti").groupBy("cell", "page").agg(F.count(F.lit(1)).alias("alone"))
    pages = keep(pages.join(alone, ["cell", "page"], "left").na.fill(0, ["alone"]), "pages")

    def stops(fresh: DataFrame) -> DataFrame:
        ends = F.col("ends") | (F.col("alone") + F.coalesce("fresh", F.lit(0)) == 0)
        return pages.join(fresh, ["cell", "page"], "left").groupBy("cell").agg(F.min(F.when(ends, F.col("page"))).alias("stop"))

    now = keep(stops(shared.groupBy("cell", "page").agg(F.count(F.lit(1)).alias("fresh"))), "stops-0")
    changed, turn = 1, 0
    while changed:
        turn += 1
        read = shared.join(now, "cell").filter(F.col("stop").isNull() | (F.col("page") <= F.col("stop")))
        reader = keep(read.groupBy("key").agg(F.min("cell").alias("reader")), f"readers-{turn}")  # of known size when it is joined
        new = shared.join(reader, "key", "left").filter(F.col("reader").isNull() | (F.col("cell") <= F.col("reader")))
        after = stops(new.groupBy("cell", "page").agg(F.count(F.lit(1)).alias("fresh"))).join(now.withColumnRenamed("stop", "was"), "cell")
        seen = Observation()
        after = after.observe(seen, F.count_if(~F.col("stop").eqNullSafe(F.col("was"))).alias("changed"))
        now = keep(after.drop("was"), f"stops-{turn}")
        changed = seen.get["changed"]
    return now


def paginate(rows: DataFrame, key: str = "key", full_page: int | None = None, page_cap: int = 6) -> DataFrame:
    """The rows of the pages up to each cell's stop, a key once a cell."""
    stops = page_stops(rows, key, full_page, page_cap)
    read = rows.filter(F.col("page") < page_cap).join(stops, "cell").filter(F.col("stop_page").isNull() | (F.col("page") <= F.col("stop_page"))).drop("stop_page", "last_page")
    ranked = read.withColumn("_rn", F.row_number().over(Window.partitionBy("cell", key).orderBy("page", "rank")))
    return ranked.filter("_rn = 1").drop("_rn")


def cell_results(rows: DataFrame, in_fence: Column, in_footprint: Column, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(kept rows, counters): null coordinates and rows outside the fence, then outside the cell's footprint, then
    repeated keys are dropped, each row with exactly one reason; raw = kept + duplicates + both outsides."""
    marked = rows.withColumn("_reason", F.when(~F.coalesce(in_fence, F.lit(False)), "outside_boundary").when(~F.coalesce(in_footprint, F.lit(False)), "outside_footprint"))
    passed = marked.filter(F.col("_reason").isNull())
    kept = first_wins(passed.drop("_reason"), key)
    counts = marked.agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("_reason") == "outside_boundary").alias("outside_boundary"), F.count_if(F.col("_reason") == "outside_footprint").alias("outside_footprint"), F.countDistinct(F.when(F.col("_reason").isNull(), F.col(key))).alias("kept"))
    return kept, counts.withColumn("duplicates", F.col("raw") - F.col("outside_boundary") - F.col("outside_footprint") - F.col("kept"))


def rejects(rows: DataFrame, in_fence: Column, in_footprint: Column, key: str = "key") -> DataFrame:
    """The rows that `cell_results` drops, each with its `reason`."""
    reason = F.when(~F.coalesce(in_fence, F.lit(False)), "outside_boundary").when(~F.coalesce(in_footprint, F.lit(False)), "outside_footprint")
    marked = rows.withColumn("reason", reason)
    rank = F.row_number().over(Window.partitionBy(key, F.col("reason").isNull()).orderBy(*ORDER))
    repeated = marked.withColumn("_rn", rank).withColumn("reason", F.coalesce("reason", F.when(F.col("_rn") > 1, "duplicate")))
    return repeated.filter("reason IS NOT NULL").drop("_rn")


def exhaustion(rows: DataFrame, key: str = "key", least: int = 5) -> DataFrame:
    """(cell, streak): the longest run of neighbouring pages with fewer than `least` new keys; a counter only."""
    poor = page_novelty(rows, key).withColumn("_poor", F.col("new") < least)
    own = Window.partitionBy("cell").orderBy("page")
    runs = poor.withColumn("_run", F.sum(F.when(F.col("_poor"), 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("cell", "_run").agg(F.count_if("_poor").alias("n")).groupBy("cell").agg(F.max("n").alias("streak"))


def split_decision(full_page: int = 20, area_cap: int = 120, page_cap: int = 6, max_depth: int = 4, min_cell_km: float = 0.25, max_zoom: int = 19) -> tuple[Column, Column]:
    """(saturated, splits) over columns raw, full_pages, kept, depth, cell_km, zoom of a searched cell."""
    saturated = (F.col("raw") >= area_cap) | (F.col("full_pages") >= page_cap)
    splits = saturated & (F.col("kept") >= max(8, page_cap * 4)) & (F.col("depth") < max_depth) & (F.col("cell_km") / 2 >= min_cell_km) & (F.col("zoom") < max_zoom)
    return saturated, splits


def global_cap(rows: DataFrame, most: int, key: str = "key") -> DataFrame:
    """The first `most` distinct keys in total order: a top-k, so each task sends `most` rows at most."""
    return first_wins(rows, key).orderBy(*ORDER).limit(most)


def empty_streak(cells: DataFrame, kept: str = "kept", seq: str = "seq", most: int = 12, block: int = 4096) -> DataFrame:
    """The cells that are tried before `most` in a row keep nothing, with that cell as the last.

    The stop is the first cell whose `most` predecessors, itself included, are all empty. Blocks of the
    sequence overlap by `most` - 1 cells, so the window runs in many tasks.
    """
    own = F.floor(F.col(seq) / block)
    spread = cells.select(seq, kept).withColumn("_block", F.explode(F.array_distinct(F.array(own, F.floor((F.col(seq) + most - 1) / block)))))
    run = Window.partitionBy("_block").orderBy(seq).rowsBetween(-(most - 1), 0)
    streak = spread.withColumn("_n", F.count(F.lit(1)).over(run)).withColumn("_kept", F.sum(kept).over(run))
    stop = streak.filter((F.col("_n") == most) & (F.col("_kept") == 0)).agg(F.min(seq).alias("_stop"))  # one row
    return cells.filter(F.coalesce(F.col(seq) <= stop.scalar(), F.lit(True)))


def resume(planned: DataFrame, completed: DataFrame, key: str = "cell_key") -> DataFrame:
    """The planned cells that no checkpoint names."""
    return planned.join(completed.select(key).distinct(), key, "left_anti")


def merge_passes(passes: list[DataFrame], key: str = "key", order: tuple[str, ...] = ORDER) -> DataFrame:
    """The union of the passes; of each key the row of the earliest pass, then the first in it."""
    rows = None
    for n, one in enumerate(passes):
        one = one.withColumn("pass", F.lit(n))
        rows = one if rows is None else rows.unionByName(one)
    return first_wins(rows, key, ("pass", *order))


def snapshot_precedence(snapshot: DataFrame, lines: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Of each key the snapshot's last record, at the place of its first; for keys it lacks the first line."""
    last = Window.partitionBy(key)
    snap = snapshot.withColumn("_last", F.max(seq).over(last)).withColumn("position", F.min(seq).over(last)).filter(F.col(seq) == F.col("_last")).drop("_last").withColumn("origin", F.lit("snapshot"))
    line = first_wins(lines, key, (seq,)).join(snapshot.select(key).distinct(), key, "left_anti").withColumn("position", F.col(seq)).withColumn("origin", F.lit("lines"))
    return snap.unionByName(line)


def diversity_pass(rows: DataFrame, seen: DataFrame, key: str = "key", full_page: int = 20, page_cap: int = 2) -> tuple[DataFrame, DataFrame]:
    """(new rows, (cell, duplicates)): sub-area pages up to the first short page or one without a new key; keys that
    earlier passes kept are counted and leave no trace on the survivor."""
    read = paginate(rows, key, full_page, page_cap)
    fresh = first_wins(read.join(seen.select(key).distinct(), key, "left_anti"), key)
    again = read.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(fresh.groupBy("cell").agg(F.count(F.lit(1)).alias("kept")), "cell", "left")
    return fresh, again.select("cell", (F.col("n") - F.coalesce("kept", F.lit(0))).alias("duplicates"))
