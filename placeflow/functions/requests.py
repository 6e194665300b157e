"""Request parameters as maps of texts, for lineage of recorded answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _named(pairs: dict[str, Column]) -> Column:
    """The map of the names whose value isn't null, in order."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _place(lat: Column | None, lon: Column | None) -> Column:
    """`lat,lon`, or null unless both are there."""
    if lat is None or lon is None:
        return F.lit(None).cast("string")
    return F.concat(lat.cast("string"), F.lit(","), lon.cast("string"))


def search_params(query: Column, lat: Column | None = None, lon: Column | None = None, language: str = "en", **more: Column) -> Column:
    return _named({"q": query, "hl": F.lit(language), "center": _place(lat, lon), **more})


def review_params(feature_id: Column, page_token: Column | None = None, sort_by: str = "relevant", language: str = "en") -> Column:
    token = F.lit(None) if page_token is None else F.nullif(page_token, F.lit(""))
    return _named({"feature_id": feature_id, "sort": F.lit(sort_by), "hl": F.lit(language), "page_token": token})


def photo_params(reference: Column, max_width: int = 800, max_height: int = 800) -> Column:
    return _named({"photo_reference": reference, "max_width": F.lit(max_width), "max_height": F.lit(max_height)})


def autocomplete_params(text: Column, lat: Column | None = None, lon: Column | None = None, radius: Column | None = None, language: str = "en") -> Column:
    return _named({"input": text, "hl": F.lit(language), "location": _place(lat, lon), "radius": F.lit(None) if radius is None else radius.cast("long")})


def _quoted(text: Column) -> Column:
    """Form-encoded: letters, digits and _.-~ as they are, a blank as +."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_string(params: Column) -> Column:
    """The map as name=value pairs joined by &, in its order."""
    return F.array_join(F.transform(F.map_entries(params), lambda e: F.concat(_quoted(e["key"]), F.lit("="), _quoted(e["value"]))), "&")
