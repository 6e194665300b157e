"""The user's entry points over recorded tables; everything is a DataFrame and nothing is fetched.

`Places` holds named tables: responses (query, offset, VARIANT response), details (VARIANT response),
reviews (hex_id, page, VARIANT response), pages (site, page_order, url, html), locations (query, body),
grid_pages (the columns of operators.collect.PAGES) and subarea_pages (those with cell for cell_key).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from placeflow.errors import ConfigurationError, NotFoundError
from placeflow.functions import geo
from placeflow.operators import collect, discover, enrich, grid, locations, metrics, parse, quality, shared

#: Order of reviews: fixed codes.
SORTS = {"most_relevant": 0, "newest": 1, "highest_rating": 2, "lowest_rating": 3}


class Places:
    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables = dict(tables)

    def search(self, query: str, offset: int = 0, max_results: int = 20, strict: bool = False) -> DataFrame:
        """A page of places in order, with total_results and next_offset; the first page is validated."""
        own = self.tables["responses"].filter((F.col("query") == query) & (F.col("offset") == offset))
        rows = parse.parse_places(parse.place_entries(own), keep=("pos",))
        if strict and offset == 0:
            quality.validate(rows, strict=True)
        total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))  # a page has twenty entries
        count = min(max_results, 20)
        rows = rows.withColumn("total_results", total).filter(F.col("pos") < max_results)
        return rows.withColumn("next_offset", F.when(F.col("total_results") >= count, F.lit(offset + count)))

    def nearby(self, query: str = "", max_results: int = 20) -> DataFrame:
        return self.search(query or "*", max_results=max_results)

    def grid_search(self, box: grid.Box, inside: Column | None = None, settings: collect.Settings | None = None) -> collect.Collected:
        return collect.collect(self.tables["grid_pages"], box, inside, settings)

    def collect(self, out: str, query: str, box: grid.Box, inside: Column | None = None, settings: collect.Settings | None = None, resume: bool = False, enrich_places: bool = False, max_contacts: int = 0, observer: Callable[[dict], None] | None = None) -> DataFrame:
        """Collect an area into the folder `out` (places, cells, manifest); the manifest, one row.

        The phases: cells level by level, sub-areas (table subarea_pages) for keys that those lack, cells that no place
        covers (pages whose cell_key begins with gap:), then details (`enrich_places`) and contacts within
        `max_contacts`. An existing collection is refused without `resume`, and with it if it was for another query. A
        resumed run skips finished cells (not those refused before they showed anything) and known keys; its manifest counts all runs.

        Each run writes folders of its own and then its line of the manifest, which readers go by: what a broken run
        left is never read, and the next one overwrites it.
        """
        spark = self.tables["grid_pages"].sparkSession
        before = self.manifest(spark, out)
        if before is not None and not resume:
            raise ConfigurationError(f"{out} holds a collection; resume it or choose another folder")
        if before is not None and before["query"] != query:
            raise ConfigurationError(f"{out} was collected for {before['query']!r}")
        run, done, seen, passes = 1, None, None, []
        if before is not None:
            run = before["run"] + 1
            seen, cells = self.collected(spark, out, "places"), self.collected(spark, out, "cells")
            done, seen = cells.filter("NOT splits AND (NOT failed OR raw > 0)").select("cell_key"), seen.select("key")
        got = collect.collect(self.tables["grid_pages"].filter("cell_key NOT LIKE 'gap:%'"), box, inside, settings, done, seen, observer)
        passes.append(got.places.withColumn("pass", F.lit("cells")))
        known = passes[0].select("key") if seen is None else passes[0].select("key").union(seen)
        if "subarea_pages" in self.tables:
            fresh, _ = discover.diversity_pass(self.tables["subarea_pages"], known, full_page=got.settings.full_page)
            fresh = fresh.filter(inside if inside is not None else geo.in_box(F.col("lat"), F.col("lon"), box))
            passes.append(shared.kept(fresh.withColumn("pass", F.lit("subareas")).drop("cell"), shared.folder(spark, "subareas")))
            known = known.union(passes[-1].select("key"))
        located = passes[0].select("key", "lat", "lon") if len(passes) == 1 else passes[0].select("key", "lat", "lon").union(passes[1].select("key", "lat", "lon"))
        gaps = self.tables["grid_pages"].filter("cell_key LIKE 'gap:%'")
        if not gaps.isEmpty():
            fresh = collect.gap_fill(gaps, located, box, got.settings.cell_km).join(known.distinct(), "key", "left_anti")
            passes.append(fresh.withColumn("pass", F.lit("gaps")))
        places = passes[0]
        for one in passes[1:]:
            places = places.unionByName(one, allowMissingColumns=True)
        if enrich_places:
            places = self.enrich(places)
        if max_contacts:
            places = self.contacts(places, query, max_contacts)
        places.write.mode("overwrite").parquet(f"{out}/places/run={run}")
        got.cells.write.mode("overwrite").parquet(f"{out}/cells/run={run}")
        everything = collect.Collected(self.collected(spark, out, "places", run), self.collected(spark, out, "cells", run), got.settings)
        row = everything.manifest().withColumn("query", F.lit(query)).withColumn("schema_version", F.lit(1)).withColumn("run", F.lit(run))
        totals = [F.count(F.lit(1)).alias("retained")]
        if "contact_status" in everything.places.columns:
            totals += [F.count_if(F.col("contact_status").isin("completed", "failed")).alias("contact_attempted"), F.count_if(F.col("contact_status") == "not_attempted_limit").alias("skipped_limit")]
        row = row.join(F.broadcast(everything.places.agg(*totals).withColumn("run", F.lit(run))), "run")  # one row
        row.write.mode("overwrite").json(f"{out}/manifest/run={run}")
        return spark.read.schema(row.schema).json(f"{out}/manifest").filter(F.col("run") == run)

    @staticmethod
    def manifest(spark: SparkSession, out: str) -> Row | None:
        """The last line of a collection's manifest (query, run); None where there is no collection."""
        try:
            return spark.read.schema("query string, run int").json(f"{out}/manifest").orderBy(F.desc("run")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    @classmethod
    def collected(cls, spark: SparkSession, out: str, table: str = "places", last: int | None = None) -> DataFrame:
        """The rows of all runs that the manifest names (or of those up to `last`)."""
        last = cls.manifest(spark, out)["run"] if last is None else last
        return spark.read.option("mergeSchema", "true").parquet(f"{out}/{table}").filter(F.col("run") <= last)

    def locate(self, location: str) -> Row:
        """The recorded area of that name; NotFoundError if there is none."""
        row = locations.resolve(self.tables["locations"].filter(F.col("query") == location)).first()
        if row is None:
            raise NotFoundError(f"no area {location!r}", location=location)
        return row

    def get(self, place_id: str) -> DataFrame:
        """The details of a place; no row if none is recorded."""
        return parse.parse_details(self.tables["details"]).filter(F.col("place_id") == place_id)

    def one(self, place_id: str) -> Row:
        """The details of a place; NotFoundError if none is recorded."""
        row = self.get(place_id).first()
        if row is None:
            raise NotFoundError(f"no place {place_id!r}", place_id=place_id)
        return row

    def get_by_hex_id(self, hex_id: str) -> DataFrame:
        return parse.parse_details(self.tables["details"]).filter(F.col("hex_id") == hex_id)

    def reviews(self, hex_id: str, sort_by: str = "most_relevant", max_reviews: int = 50) -> DataFrame:
        """Reviews in page order, `max_reviews` at most; an unknown order counts as the first."""
        own = self.tables["reviews"].filter(F.col("hex_id") == hex_id)
        if "sort" in own.columns:
            own = own.filter(F.col("sort") == SORTS.get(sort_by, 0))
        return parse.parse_reviews(own, keep=("page",)).orderBy("page", "pos").limit(max_reviews)

    def enrich(self, places: DataFrame) -> DataFrame:
        return enrich.merge_details(places, parse.parse_details(self.tables["details"]))

    def contacts(self, places: DataFrame, query: str = "", max_contacts: int = 100) -> DataFrame:
        """Places with contact_status and, for those within the budget, emails and links found on their recorded pages."""
        marked = enrich.contact_status(places, query, max_contacts)
        found = enrich.site_contacts(self.tables["pages"])
        rows = marked.drop("emails", "social_links", "sources").join(found, marked["website"] == found["site"], "left").drop("site")
        pending = F.col("contact_status") == "pending"
        done = F.when(pending & F.col("sources").isNotNull(), "completed").when(pending, "failed").otherwise(F.col("contact_status"))
        return rows.withColumn("emails", F.when(pending, F.col("emails"))).withColumn("social_links", F.when(pending, F.col("socials"))).withColumn("contact_status", done).drop("socials")

    def stats(self, requests: DataFrame) -> DataFrame:
        return metrics.run_stats(requests, F.col("failed"), F.col("key"), F.col("seconds"))
