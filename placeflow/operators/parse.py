"""Positional JSON to typed records, over VARIANT columns.

A response is decoded once and read by path; a path that isn't there gives null. Texts are taken from
strings and numbers (lists and booleans become JSON text). Empty texts are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeflow.functions.keys import filled

# Where a field stands in a place's list.
CORE_PATHS: dict[str, list[int]] = {
    "name": [11], "place_id": [78], "hex_id": [10], "ftid": [89], "data_id": [0],
    "latitude": [9, 2], "longitude": [9, 3], "address": [18], "phone": [178, 0, 0], "website": [7, 0],
}
NUMBERS = ("latitude", "longitude")
PLACE_URL = "https://www.google.com/maps/place/?q=place_id:"
MORE_TEXT = {"neighborhood": [14], "timezone": [30], "status": [34], "author_photo": [157], "search_token": [1]}
ADDRESS_PARTS = ("borough", "street", None, "city", "postal_code", "state", "country")


def path(indices: list[int]) -> str:
    return "$" + "".join(f"[{i}]" for i in indices)


def text_at(v: Column, indices: list[int]) -> Column:
    return filled(F.try_variant_get(v, path(indices), "string"))


def number_at(v: Column, indices: list[int]) -> Column:
    return F.try_variant_get(v, path(indices), "double")


def items_at(v: Column, indices: list[int]) -> Column:
    """The list there as array<variant>; null if there is none."""
    return F.try_variant_get(v, path(indices), "array<variant>")


def kind_at(v: Column, indices: list[int]) -> Column:
    """The SQL type of what stands there, as text; null where nothing does."""
    return F.schema_of_variant(F.try_variant_get(v, path(indices), "variant"))


def is_text(v: Column, indices: list[int]) -> Column:
    return F.coalesce(kind_at(v, indices) == "STRING", F.lit(False))


def is_number(v: Column, indices: list[int]) -> Column:
    return F.coalesce(kind_at(v, indices).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.lit(False))


def place_entries(responses: DataFrame, response: str = "response") -> DataFrame:
    """One row for each place of a decoded search response (column VARIANT), with `pd`, its list, and `pos`.

    The older envelope, [0][1] with places at [14] after a first entry of metadata, wins if it has any
    place. Else places are the second items of the first top-level list that holds any list of over 18
    items with texts at 11 and 18.
    """
    v = F.col(response)
    old = F.filter(F.transform(F.slice(items_at(v, [0, 1]), 2, 1_000_000), lambda e: F.try_variant_get(e, "$[14]", "variant")), lambda p: F.try_variant_get(p, "$", "array<variant>").isNotNull())

    def fits(p: Column) -> Column:
        return (F.size(F.try_variant_get(p, "$", "array<variant>")) > 18) & is_text(p, [11]) & is_text(p, [18])

    lists = F.transform(F.coalesce(items_at(v, []), F.array().cast("array<variant>")), lambda c: F.filter(F.transform(F.coalesce(F.try_variant_get(c, "$", "array<variant>"), F.array().cast("array<variant>")), lambda e: F.try_variant_get(e, "$[1]", "variant")), lambda p: F.coalesce(fits(p), F.lit(False))))
    new = F.try_element_at(F.filter(lists, lambda x: F.size(x) > 0), F.lit(1))
    chosen = F.when(F.size(old) > 0, old).otherwise(new)
    rest = [c for c in responses.columns if c != response]
    return responses.select(*rest, F.posexplode(chosen).alias("pos", "pd"))


def core_fields(pd: Column, paths: dict[str, list[int]] | None = None) -> dict[str, Column]:
    """The ten core fields by a map of paths: texts only from non-empty strings, numbers only from numbers."""
    out = {}
    for name, indices in (paths or CORE_PATHS).items():
        if name in NUMBERS:
            out[name] = F.when(is_number(pd, indices), number_at(pd, indices))
        else:
            out[name] = F.when(is_text(pd, indices), text_at(pd, indices))
    return out


def parse_core(entries: DataFrame, paths: dict[str, list[int]] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    return entries.select(*keep, *(c.alias(n) for n, c in core_fields(F.col("pd"), paths).items()))


def rating(pd: Column) -> dict[str, Column]:
    """Nothing at all without a non-empty rating list; price level and histogram depend on it too."""
    has = F.coalesce(F.size(items_at(pd, [4])) > 0, F.lit(False))
    stars = F.filter(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(i.cast("string").alias("key"), F.floor(F.try_variant_get(items_at(pd, [175, 3])[i - 1], "$", "double")).cast("long").alias("value"))), lambda e: e["value"] > 0)

    def only(c: Column) -> Column:
        return F.when(has, c)

    return {
        "rating": only(number_at(pd, [4, 7])), "review_count": F.coalesce(only(number_at(pd, [4, 8]).cast("long")), F.lit(0).cast("long")),
        "price_range": only(text_at(pd, [4, 2])), "reviews_link": only(text_at(pd, [4, 3, 0])), "price_level": only(F.try_variant_get(pd, "$[116]", "int")),
        "reviews_per_rating": only(F.map_from_entries(F.when(items_at(pd, [175, 3]).isNotNull(), stars).otherwise(F.slice(stars, 1, 0)))),
    }


def address(pd: Column) -> dict[str, Column]:
    """The structured parts override street and city of the older pair only where they aren't empty."""
    out = {name: text_at(pd, [183, 1, i]) for i, name in enumerate(ADDRESS_PARTS) if name}
    out["street"] = F.coalesce(out["street"], text_at(pd, [2, 0]))
    out["city"] = F.coalesce(out["city"], text_at(pd, [2, 1]))
    return out


def hours(pd: Column) -> Column:
    """Map from day to its opening times; the older list under "raw" only if the newer one isn't there."""
    days = items_at(pd, [203, 0])
    rows = F.transform(days, lambda d: F.struct(filled(F.try_variant_get(d, "$[0]", "string")).alias("day"), F.filter(F.transform(F.coalesce(F.try_variant_get(d, "$[3]", "array<variant>"), F.array().cast("array<variant>")), lambda b: filled(F.try_variant_get(b, "$[0]", "string"))), lambda t: t.isNotNull()).alias("times")))
    rows = F.filter(rows, lambda r: r["day"].isNotNull() & (F.size(r["times"]) > 0))
    names = F.array_distinct(F.transform(rows, lambda r: r["day"]))
    new = F.map_from_arrays(names, F.transform(names, lambda n: F.flatten(F.transform(F.filter(rows, lambda r: r["day"] == n), lambda r: r["times"]))))
    raw = F.filter(F.transform(items_at(pd, [34]), lambda h: filled(F.try_variant_get(h, "$", "string"))), lambda t: t.isNotNull())
    return F.when(days.isNotNull(), new).when(F.size(items_at(pd, [34])) > 0, F.create_map(F.lit("raw"), raw))


def texts(pd: Column, indices: list[int], strings_only: bool = False) -> Column:
    items = items_at(pd, indices)
    if strings_only:
        items = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
    return F.filter(F.transform(items, lambda x: filled(F.try_variant_get(x, "$", "string"))), lambda t: t.isNotNull())


def _pairs(pd: Column, indices: list[int], first: str, second: str) -> Column:
    items = F.filter(items_at(pd, indices), lambda x: F.size(F.try_variant_get(x, "$", "array<variant>")) > 1)
    return F.transform(items, lambda x: F.struct(F.coalesce(F.try_variant_get(x, "$[0]", "string"), F.lit("")).alias(first), F.coalesce(F.try_variant_get(x, "$[1]", "string"), F.lit("")).alias(second)))


def media(pd: Column) -> dict[str, Column]:
    none = F.array().cast("array<variant>")
    blocks = F.transform(items_at(pd, [171]), lambda b: F.transform(F.coalesce(F.try_variant_get(b, "$[3]", "array<variant>"), none), lambda p: F.struct(F.coalesce(F.try_variant_get(b, "$[2]", "string"), F.lit("")).alias("title"), F.try_variant_get(p, "$[6][0]", "string").alias("url"))))
    images = F.filter(F.flatten(blocks), lambda i: i["url"].startswith("http"))
    views = F.filter(images, lambda i: F.lower(i["title"]).contains("street view"))
    thumbs = F.filter(F.transform(items_at(pd, [72, 0]), lambda t: F.try_variant_get(t, "$[6][0]", "string")), lambda u: u.startswith("http"))
    return {"photos": _pairs(pd, [36], "reference", "url"), "images": images, "street_view_url": F.try_element_at(views, F.lit(-1))["url"], "thumbnail": F.try_element_at(thumbs, F.lit(1))}


def about(pd: Column) -> dict[str, Column]:
    none = F.array().cast("array<variant>")
    sections = F.filter(items_at(pd, [100, 1]), lambda s: F.try_variant_get(s, "$[1]", "array<variant>").isNotNull())
    cards = F.filter(sections, lambda s: F.try_variant_get(s, "$[0]", "string") == "Credit cards")
    others = F.filter(sections, lambda s: ~(F.coalesce(F.try_variant_get(s, "$[0]", "string"), F.lit("")) == "Credit cards"))

    def options(s: Column) -> Column:
        own = F.filter(F.coalesce(F.try_variant_get(s, "$[1]", "array<variant>"), none), lambda o: F.size(F.try_variant_get(o, "$", "array<variant>")) > 1)
        return F.transform(own, lambda o: F.struct(F.coalesce(F.try_variant_get(o, "$[0]", "string"), F.lit("")).alias("name"), F.coalesce(F.try_variant_get(o, "$[1]", "boolean"), F.try_variant_get(o, "$[1]", "double") != 0, F.lit(False)).alias("enabled")))

    named = F.transform(others, lambda s: F.struct(F.coalesce(F.try_variant_get(s, "$[0]", "string"), F.lit("")).alias("name"), options(s).alias("options")))
    return {"credit_cards": F.transform(F.try_variant_get(F.try_element_at(cards, F.lit(-1)), "$[1]", "array<variant>"), lambda c: F.try_variant_get(c, "$", "string")), "about": F.filter(named, lambda a: F.size(a["options"]) > 0)}


def _shared(pd: Column) -> dict[str, Column]:
    core = {n: text_at(pd, p) for n, p in CORE_PATHS.items() if n not in NUMBERS} | {n: number_at(pd, p) for n, p in CORE_PATHS.items() if n in NUMBERS}
    return core | {"cid": text_at(pd, [10]), "google_maps_url": F.concat(F.lit(PLACE_URL), text_at(pd, [78])), "description": text_at(pd, [32, 1, 1]), "categories": texts(pd, [13]), "quick_amenities": texts(pd, [88], strings_only=True), "hours": hours(pd)} | address(pd) | rating(pd) | media(pd) | about(pd)


def parse_places(entries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All fields of the entries that `place_entries` gives."""
    pd = F.col("pd")
    fields = _shared(pd) | {n: text_at(pd, p) for n, p in MORE_TEXT.items()} | {"is_ad": F.coalesce(F.try_variant_get(pd, "$[6]", "boolean"), F.try_variant_get(pd, "$[6]", "int") != 0, F.lit(False))}
    return entries.select(*keep, *(c.alias(n) for n, c in fields.items()))


def parse_details(responses: DataFrame, response: str = "response", keep: tuple[str, ...] = ()) -> DataFrame:
    """The place at [6] of a details response; no website, status, ad mark or search token, but plus code, links, menu and owner."""
    v = F.col(response)
    rows = responses.filter(F.try_variant_get(v, "$[6]", "array<variant>").isNotNull()).withColumn("pd", F.try_variant_get(v, "$[6]", "variant"))
    pd = F.col("pd")
    fields = {n: c for n, c in _shared(pd).items() if n != "website"} | {n: text_at(pd, p) for n, p in MORE_TEXT.items() if n not in ("status", "search_token")}
    fields |= {"plus_code": text_at(pd, [183, 2, 2, 0]), "reservations": _pairs(pd, [46], "link", "source"), "order_online": _pairs(pd, [75], "link", "source")}
    fields |= {"menu": F.when(F.size(items_at(pd, [38])) > 1, F.struct(text_at(pd, [38, 0]).alias("link"), text_at(pd, [38, 1]).alias("source"))), "owner": F.when(F.size(items_at(pd, [57])) > 2, F.struct(*(text_at(pd, [57, i]).alias(n) for i, n in enumerate(("id", "name", "link")))))}
    return rows.select(*keep, *(c.alias(n) for n, c in fields.items()))


def parse_reviews(responses: DataFrame, response: str = "response", keep: tuple[str, ...] = ()) -> DataFrame:
    """Reviews at [2] with their position, and the next page's token at [1][1]."""
    v = F.col(response)
    rows = responses.select(*keep, text_at(v, [1, 1]).alias("next_token"), F.posexplode(items_at(v, [2])).alias("pos", "r")).filter(F.try_variant_get("r", "$", "array<variant>").isNotNull())
    r = F.col("r")
    return rows.select(*keep, "next_token", "pos", F.coalesce(text_at(r, [0]), F.lit("")).alias("review_id"), F.coalesce(text_at(r, [1, 4, 5, 0]), F.lit("Anonymous")).alias("author_name"), F.lit("").alias("author_photo"), F.coalesce(F.try_variant_get(r, "$[2][0][0]", "int"), F.lit(0)).alias("rating"), F.coalesce(text_at(r, [2, 15, 0, 0]), F.lit("")).alias("text"), F.coalesce(text_at(r, [3]), F.lit("")).alias("timestamp"))


def guess_places(items: DataFrame, item: str = "item", keep: tuple[str, ...] = ()) -> DataFrame:
    """Name, coordinates and rating guessed from an entry without a known layout: a name is the first text of 4 to 199
    characters with a letter that isn't a hexadecimal id; coordinates are the first pair in range."""
    v = F.col(item)
    leaves = F.coalesce(items_at(v, []), F.array().cast("array<variant>"))
    names = F.filter(F.transform(leaves, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))), lambda t: (F.length(t) > 3) & (F.length(t) < 200) & t.rlike(r"\p{L}") & ~t.startswith("0x"))
    pairs = F.transform(leaves, lambda x: F.struct(F.try_variant_get(x, "$[2]", "double").alias("lat"), F.try_variant_get(x, "$[3]", "double").alias("lon")))
    coords = F.filter(pairs, lambda p: p["lat"].between(-90, 90) & p["lon"].between(-180, 180))
    named = F.coalesce(F.try_variant_get(v, "$.title", "string"), F.try_variant_get(v, "$.name", "string"), F.try_element_at(names, F.lit(1)))
    return items.select(*keep, named.alias("name"), F.coalesce(F.try_variant_get(v, "$.lat", "double"), F.try_element_at(coords, F.lit(1))["lat"]).alias("latitude"), F.coalesce(F.try_variant_get(v, "$.lon", "double"), F.try_variant_get(v, "$.lng", "double"), F.try_element_at(coords, F.lit(1))["lon"]).alias("longitude"), F.coalesce(F.try_variant_get(v, "$.vicinity", "string"), F.try_variant_get(v, "$.address", "string")).alias("address"))


def grouped(places: DataFrame) -> DataFrame:
    """Places as one grouped struct a row, `record`; what is empty, zero or false is left out of its JSON."""
    have = set(places.columns)

    def some(name: str) -> Column:
        kind = dict(places.dtypes)[name]
        c = F.col(name)
        if kind == "string":
            return filled(c)
        if kind in ("int", "bigint", "double", "float"):
            return F.nullif(c, F.lit(0).cast(kind))
        if kind.startswith(("array", "map")):
            return F.when(F.size(c) > 0, c)
        return F.when(c, c) if kind == "boolean" else c

    groups = {
        "contact": ("phone", "website", "google_maps_url", "plus_code", "emails", "social_links", "contact_pages", "contact_status"),
        "address": ("borough", "street", "city", "postal_code", "state", "country", "neighborhood", ("address", "full")),
        "rating": ("rating", "review_count", "reviews_per_rating", "reviews_link", "price_range", "price_level"),
        "location": ("latitude", "longitude", "found_in_cells"),
        "business": ("categories", "quick_amenities", "hours", "timezone", "status", "description"),
        "media": ("photos", "images", "thumbnail", "street_view_url", "author_photo"),
        "amenities": ("about", "credit_cards", "reservations", "order_online", "menu", "owner"),
    }
    top = [some(c).alias(c) for c in ("name", "place_id", "hex_id", "ftid", "data_id", "cid") if c in have]
    for group, names in groups.items():
        own = [(n if isinstance(n, tuple) else (n, n)) for n in names]
        own = [(a, b) for a, b in own if a in have]
        if own:
            parts = [some(a).alias(b) for a, b in own]
            top.append(F.when(F.coalesce(*(F.when(some(a).isNotNull(), F.lit(True)) for a, _ in own)), F.struct(*parts)).alias(group))
    if "is_ad" in have:
        top.append(some("is_ad").alias("is_ad"))
    return places.select(F.struct(*top).alias("record"))
