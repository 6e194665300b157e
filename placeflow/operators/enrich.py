"""Enrichment: details merged into places, contacts within a budget, provider fallback."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeflow.functions import contacts
from placeflow.functions.keys import matches_query


def _truthy(name: str, kind: str, column: Column) -> Column:
    if kind == "string":
        return F.nullif(column, F.lit(""))
    if kind.startswith(("array", "map")):
        return F.when(F.size(column) > 0, column)
    return F.nullif(column, F.lit(0).cast(kind)) if kind in ("int", "bigint", "double") else column


def merge_details(places: DataFrame, details: DataFrame, key: str = "place_id") -> DataFrame:
    """Each place with the details' value of every shared column where that isn't empty or zero; details of unknown
    places are left out, and of several details of a place the one whose JSON comes first counts."""
    shared = [c for c in places.columns if c in details.columns and c != key]
    kinds = dict(details.dtypes)
    row = F.struct(*(F.col(c) for c in shared))  # maps have no order, their JSON has
    one = details.groupBy(key).agg(F.min_by(row, F.to_json(row)).alias("_d"))
    rows = places.join(one, key, "left")
    picked = {c: F.coalesce(_truthy(c, kinds[c], F.col("_d")[c]), F.col(c)).alias(c) for c in shared}
    return rows.select(*(picked.get(c, F.col(c)) for c in places.columns))


def first_ok(fetches: DataFrame, url: str = "url", ok: str = "ok", order: str = "provider_rank") -> DataFrame:
    """Of each URL the first successful provider's fetch, or the last failure."""
    w = Window.partitionBy(url).orderBy(F.desc(ok), F.when(F.col(ok), F.col(order)).otherwise(-F.col(order)))
    return fetches.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def provider_payload(payload: Column, provider: str) -> Column:
    """struct<text, final_url, title, error> of a provider's JSON answer."""
    paths = {"tinyfish": (("$.results[0].text", "$.results[0].html"), "$.results[0].final_url", "$.results[0].title"), "firecrawl": (("$.data.html", "$.data.rawHtml", "$.data.markdown"), "$.data.metadata.sourceURL", "$.data.metadata.title")}[provider]
    text = F.coalesce(*(F.nullif(F.get_json_object(payload, p), F.lit("")) for p in paths[0]), F.lit(""))
    return F.struct(text.alias("text"), F.coalesce(F.get_json_object(payload, paths[1]), F.lit("")).alias("final_url"), F.coalesce(F.get_json_object(payload, paths[2]), F.lit("")).alias("title"), provider_error(payload, F.lit(None).cast("int")).alias("error"))


def provider_error(payload: Column, status: Column) -> Column:
    code, message = F.get_json_object(payload, "$.error.code"), F.get_json_object(payload, "$.error.message")
    plain = F.get_json_object(payload, "$.error")
    return F.when(code.isNotNull() | message.isNotNull(), F.trim(F.concat_ws(" ", code, message))).when(plain.isNotNull() & ~plain.startswith("{"), plain).when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string"))).otherwise("")


def contact_status(places: DataFrame, query: str, budget: int, attempted: int = 0) -> DataFrame:
    """With `contact_rank` and `contact_status`: sites in order of relevance, reviews, name and key; the first
    `budget` - `attempted` are pending, the rest are beyond the limit, and places without a site aren't eligible.

    The last rank within the budget comes from a top-k, not from a sort of all places.
    """
    left = max(0, budget - attempted)
    site = F.coalesce(F.trim(F.col("website")), F.lit("")) != ""
    order = F.struct((~matches_query(F.lit(query), F.col("name"), F.col("categories"))).cast("int").alias("a"), (-F.col("review_count")).alias("b"), F.lower(F.col("name")).alias("c"), F.col("place_id").alias("d"))
    rows = places.withColumn("_order", F.when(site, order))
    top = rows.filter(site).select("place_id", "_order").orderBy("_order").limit(left)
    numbered = top.select("place_id", F.row_number().over(Window.orderBy("_order")).cast("long").alias("contact_rank"))  # at most `left` rows
    out = rows.drop("_order").join(numbered, "place_id", "left")
    return out.withColumn("contact_status", F.when(~site, "not_eligible_no_website").when(F.col("contact_rank").isNull(), "not_attempted_limit").otherwise("pending"))


def contact_batches(marked: DataFrame, size: int = 5) -> DataFrame:
    """The pending places of `contact_status` with `batch`, the number of the checkpoint that they are done by."""
    return marked.filter("contact_status = 'pending'").withColumn("batch", F.floor((F.col("contact_rank") - 1) / size).cast("long"))


def site_contacts(pages: DataFrame, site: str = "site", order: str = "page_order") -> DataFrame:
    """(site, emails, socials, sources) from the pages of each site: the first page that shows an address or platform wins."""
    found = pages.select(site, order, "url", contacts.emails(F.col("html"), F.col(site)).alias("emails"), F.map_entries(contacts.social_links(F.col("html"))).alias("socials"))
    one = found.select(site, order, "url", F.posexplode(F.concat(F.transform("emails", lambda e: F.struct(F.lit("email").alias("kind"), e.alias("key"), e.alias("value"))), F.transform("socials", lambda s: F.struct(F.lit("social").alias("kind"), s["key"].alias("key"), s["value"].alias("value"))))).alias("pos", "c"))
    first = one.groupBy(site, "c.kind", "c.key").agg(F.min(F.struct(order, "pos", "url", "c.value")).alias("f"))
    rows = first.groupBy(site).agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "email", F.struct("f", "key")))).alias("e"), F.map_from_entries(F.collect_list(F.when(F.col("kind") == "social", F.struct("key", "f.value")))).alias("socials"), F.map_from_entries(F.collect_list(F.struct("key", "f.url"))).alias("sources"))
    return rows.select(site, F.transform("e", lambda x: x["key"]).alias("emails"), "socials", "sources")


def extract_with_model(pages: DataFrame, fn: Callable[[str, str], dict], gap: Column | None = None) -> DataFrame:
    """Pages with a user function's contacts, run (Arrow batches) only where `gap` holds, kept only where the page
    backs them; a failing call gives no contacts."""

    def call(texts: pd.Series, urls: pd.Series) -> pd.DataFrame:
        rows = []
        for text, url in zip(texts, urls, strict=True):
            try:
                got = fn(text or "", url or "") or {}
            except Exception:  # noqa: BLE001  one page's failure is its own
                got = {}
            rows.append({"emails": [str(e).lower() for e in got.get("emails") or []], "socials": dict(got.get("socials") or {})})
        return pd.DataFrame(rows, columns=["emails", "socials"])

    call.__annotations__ = {"texts": pd.Series, "urls": pd.Series, "return": pd.DataFrame}  # Spark reads types, not their names
    call = F.pandas_udf(call, "struct<emails:array<string>,socials:map<string,string>>")
    asked = pages.filter(gap) if gap is not None else pages
    rows = asked.withColumn("_m", call("text", "url"))
    emails = F.array_distinct(F.filter("_m.emails", lambda e: contacts.email_grounded(e, F.col("text"))))
    socials = F.map_filter("_m.socials", lambda k, v: contacts.url_grounded(v, F.col("text")))
    return rows.withColumn("emails", emails).withColumn("socials", socials).drop("_m")
