"""Identity of a place."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(column: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(column, F.lit(""))


@cache
def _folds() -> dict[str, str]:
    """Letters that case folding takes further than lower-casing, by Python's rule: sharp s to ss, final sigma to sigma."""
    letters = map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x30000)])
    return {c: c.casefold() for c in letters if c.lower() == c and c.casefold() != c}


def fold(text: Column) -> Column:
    """The text case-folded. Texts without such letters, nearly all, are lower-cased alone."""
    folds = _folds()
    low = F.lower(text)
    known = F.create_map(*(F.lit(x) for pair in folds.items() for x in pair))
    letter = F.concat(F.lit("["), *(F.lit(c) for c in folds), F.lit("]"))
    each = F.transform(F.split(low, ""), lambda c: F.coalesce(F.try_element_at(known, c), c))
    return F.when(F.rlike(low, letter), F.array_join(each, "")).otherwise(low)


def dedup_key(place_id: Column, hex_id: Column, cid: Column, name: Column, address: Column, lat: Column, lon: Column) -> Column:
    """The first identifier that isn't empty, else name, address and coordinates joined by a bar; a missing
    coordinate is the text None. Names and addresses are case-folded."""
    rest = F.concat_ws("|", fold(F.coalesce(name, F.lit(""))), fold(F.coalesce(address, F.lit(""))), F.coalesce(lat.cast("string"), F.lit("None")), F.coalesce(lon.cast("string"), F.lit("None")))
    return F.coalesce(filled(place_id), filled(hex_id), filled(cid), rest)


def matches_query(query: Column, name: Column, categories: Column) -> Column:
    """Any term of the query, three letters or more, or it without a last s, is part of the name or a category."""
    terms = F.filter(F.split(F.regexp_replace(fold(query), "-", " "), "\\s+"), lambda t: F.length(t) >= 3)
    singular = F.filter(F.transform(terms, lambda t: F.when(t.endswith("s"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)), lambda t: F.length(t) >= 3)
    where = F.regexp_replace(fold(F.concat_ws(" ", name, F.array_join(categories, " "))), "-", " ")
    return F.exists(F.array_union(terms, singular), lambda t: where.contains(t))
