"""Response envelopes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a response as refused, as a sign-in page, or as guarded JSON.
GUARDS = (")]}'\n", ")]}'\r\n", "//*/", "while(1);", "for(;;);", "throw 1; < don't be evil' >", ")]}',\n")
BLOCKED = ("our systems have detected unusual traffic", "sorry, that page can not be found", "access denied", "error 403", "error 429", "too many requests", "captcha", "recaptcha", "show captcha")
SIGN_IN = ("sign in", "log in", "signin", "accounts.google.com/servicelogin", "not logged in")
JSON_STARTS = (")]}'", ")]}',", "//*/", "while(1)", "for(;;)", "throw 1;")


def without_guard(text: Column) -> Column:
    """The text after the guard that keeps it from being run as a script."""
    out = text
    for guard in reversed(GUARDS):
        out = F.when(text.startswith(guard), F.substring(text, F.lit(len(guard) + 1), F.length(text))).otherwise(out)
    return out


def is_blocked(text: Column) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*map(F.lit, BLOCKED)), lambda x: low.contains(x))


def needs_sign_in(text: Column) -> Column:
    """An HTML page with two sign-in marks or more."""
    low = F.lower(text)
    marks = F.size(F.filter(F.array(*map(F.lit, SIGN_IN)), lambda x: low.contains(x)))
    return F.substring(low, 1, 200).contains("<html") & (marks >= 2)


def looks_like_json(text: Column) -> Column:
    bare = F.regexp_replace(text, r"^\s+", "")
    return F.exists(F.array(*map(F.lit, JSON_STARTS)), lambda x: bare.startswith(x))


def kind(text: Column) -> Column:
    """blocked, sign_in, html or json."""
    bare = F.trim(text)
    return (
        F.when(is_blocked(text), "blocked").when(needs_sign_in(text), "sign_in")
        .when(bare.startswith("{") | bare.startswith("[") | looks_like_json(text), "json")
        .when(F.substring(F.lower(text), 1, 200).contains("<html"), "html").otherwise("json")
    )


def json_text(text: Column) -> Column:
    """The JSON of a response: unguarded, without the trailing comment, and unwrapped from {"d": "..."}."""
    plain = F.regexp_replace(F.trim(without_guard(text)), r'/\*""\*/$', "")
    inner = F.regexp_replace(without_guard(F.get_json_object(plain, "$.d")), r"^\s+|\s+$", "")
    return F.when(plain.startswith("{") & (inner.startswith("[") | inner.startswith("{")), inner).otherwise(plain)


def decoded(text: Column) -> Column:
    """The response as VARIANT; null for blocked and sign-in pages and for what isn't JSON."""
    return F.when(kind(text) == "json", F.try_parse_json(json_text(text)))


def embedded_json(html: Column) -> Column:
    """JSON texts embedded in a page: initial state (the first only), linked data, application state, then inline
    arrays of places; what doesn't parse is left out."""
    rules = ((r"(?s)window\.APP_INITIALIZATION_STATE\s*=\s*(\[.*?\]);", 1), (r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1), (r"(?s)self\.__AP\s*=\s*(\{.*?\});", 1), (r"(?s)\[\[\[\[\d+.*?\]\]\]\]", 0))
    parts = [F.regexp_extract_all(html, F.lit(p), F.lit(g)) for p, g in rules]
    return F.filter(F.concat(F.slice(parts[0], 1, 1), *parts[1:]), lambda x: F.try_parse_json(x).isNotNull())
