"""Reports over what collections found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeflow.operators import metrics


def found_sites(contacts: DataFrame, *by: str, emails: str = "emails", links: str = "social_links") -> DataFrame:
    """(by..., sites, found): how many sites were looked at and how many gave an address or a link. Lists or maps."""
    some = (F.coalesce(F.size(emails), F.lit(0)) > 0) | (F.coalesce(F.size(links), F.lit(0)) > 0)
    return contacts.groupBy(*by).agg(F.count(F.lit(1)).alias("sites"), F.count_if(some).alias("found"))


def cells_touched(places: DataFrame, *by: str, cell: str = "cell_key") -> DataFrame:
    """(by..., places, cells): how many places stayed and how many cells they came from."""
    per_cell = places.groupBy(*by, cell).agg(F.count(F.lit(1)).alias("n"))
    return per_cell.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("places"), F.count(cell).alias("cells"))


def category_holds(categories: Column, part: str) -> Column:
    """Whether a category has `part` in it, in any case; false without categories or `part`."""
    return F.lit(bool(part)) & F.coalesce(F.exists(categories, lambda c: F.coalesce(F.lower(c).contains(part.lower()), F.lit(False))), F.lit(False))


def age_hours(captured_at: Column, now: Column) -> Column:
    """Hours between two times in seconds."""
    return (now - captured_at) / 3600.0


def is_fresh(captured_at: Column, now: Column, max_age_hours: float = 6.0) -> Column:
    return F.coalesce(age_hours(captured_at, now) <= max_age_hours, F.lit(False))


def is_stale(started_at: Column, now: Column, seconds: float = 900.0) -> Column:
    """Whether a session is old enough to be renewed."""
    return F.coalesce(now - started_at > seconds, F.lit(False))


def run_report(runs: DataFrame, manifests: DataFrame, group: str = "city", run: str = "run", key: str = "key", relevant: str = "relevant") -> DataFrame:
    """`metrics.recall` of each run with what its manifest says: requests, duplicates, outside, raw, and from them
    unique_per_request and outside_share (null where the manifest lacks them; runs without one keep their recall).

    `manifests` is (group, run, discovery_requests, duplicates, outside_boundary, raw_occurrences), a row a run."""
    told = manifests.select(group, run, F.col("discovery_requests").alias("requests"), "duplicates", F.col("outside_boundary").alias("outside"), F.col("raw_occurrences").alias("raw"))
    rows = metrics.recall(runs, group, run, key, relevant).join(told, [group, run], "left")
    per_request = F.when(F.col("requests") > 0, F.col("retained") / F.col("requests"))
    return rows.withColumn("unique_per_request", per_request).withColumn("outside_share", F.when(F.col("raw") > 0, F.col("outside") / F.col("raw")))


def runs_of(collections: DataFrame, manifests: DataFrame) -> DataFrame:
    """Records (file, ...) with the manifest of their run: <name>.jsonl goes with <name>.manifest.json; a left join."""
    named = collections.withColumn("run", F.regexp_replace("file", r"\.jsonl$", ""))
    told = manifests.withColumn("run", F.regexp_replace("file", r"\.manifest\.json$", "")).drop("file")
    return named.join(told, "run", "left")


#: The columns of a review in a list for people, and what stands where one is missing.
REVIEW = {"author": ("author_name", "Anonymous"), "rating": ("rating", 0), "text": ("text", ""), "timestamp": ("timestamp", "")}


def review_rows(reviews: DataFrame) -> DataFrame:
    """(author, rating, text, timestamp)."""
    return reviews.select(*(F.coalesce(F.col(source), F.lit(none)).alias(name) if source in reviews.columns else F.lit(none).alias(name) for name, (source, none) in REVIEW.items()))
