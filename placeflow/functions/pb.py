"""The !-separated text form of request parameters: !<field><type><value>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The text before each parameter that a captured request can vary in.
MARKERS = {"query": "!1s", "lat": "!3d", "lng": "!2d", "zoom": "!4f", "offset": "!8i", "count": "!7i"}


def field(number: int, kind: str, value: Column) -> Column:
    """One field, or null for a null value or an empty text. Booleans are 0 or 1, integers lose their fraction."""
    if kind == "s":
        text = F.nullif(value.cast("string"), F.lit(""))
    elif kind == "b":
        text = F.when(value, "1").otherwise("0")
    elif kind in ("i", "e"):
        text = value.cast("long").cast("string")
    else:
        text = value.cast("string")
    return F.when(value.isNotNull(), F.concat(F.lit(f"!{number}{kind}"), text))


def message(number: int, fields: list[Column]) -> Column:
    """A group: its count is that of the fields given, even of those that encode to nothing."""
    return F.concat(F.lit(f"!{number}m{len(fields)}"), F.concat_ws("", *fields))


def encode(fields: list[Column]) -> Column:
    return F.concat_ws("", *fields)


def decode(text: Column) -> Column:
    """array<struct<field, type, value>>. Letters after a number are all its type, so a text value that begins with
    letters is read into the type."""
    tokens = F.regexp_extract_all(text, F.lit(r"!(\d+[a-z]+[^!]*)"), F.lit(1))
    return F.transform(tokens, lambda t: F.struct(F.regexp_extract(t, r"^(\d+)", 1).cast("int").alias("field"), F.regexp_extract(t, r"^\d+([a-z]+)", 1).alias("type"), F.regexp_extract(t, r"^\d+[a-z]+(.*)$", 1).alias("value")))


def template(text: Column, **values: Column) -> Column:
    """The captured text with the first occurrence of each marker and value turned into {name}."""
    for name, value in values.items():
        marker = MARKERS[name]
        found = F.concat(F.lit(marker), value)
        at = F.call_function("instr", text, found)
        text = F.when(value.isNotNull() & (at > 0), F.overlay(text, F.lit(f"{marker}{{{name}}}"), at, F.length(found))).otherwise(text)
    return text


def render(text: Column, **values: Column) -> Column:
    for name, value in values.items():
        text = F.when(value.isNull(), text).otherwise(F.replace(text, F.lit(f"{{{name}}}"), value.cast("string")))
    return text
