"""Contacts found in HTML, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an address, a link and a placeholder look like.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,24}"
MAILTO = r"""(?i)mailto:([^"'<>?\s]+)"""
CFEMAIL = r'data-cfemail="([0-9a-fA-F]+)"'
HREF = r"""(?i)href=["']([^"']+)["']"""
JUNK_DOMAINS = ("example.com", "example.org", "domain.com", "email.com", "yoursite.com", "sentry.io", "wixpress.com", "sentry-next.wixpress.com", "godaddy.com", "schema.org", "w3.org", "placeholder.com", "yourdomain.com", "mysite.com", "youremail.com")
CONSUMER_DOMAINS = ("gmail.com", "googlemail.com", "yahoo.com", "outlook.com", "hotmail.com", "live.com", "icloud.com", "me.com", "aol.com", "proton.me", "protonmail.com", "zoho.com")
JUNK_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".css", ".js", ".woff", ".woff2", ".ttf", ".mp4", ".pdf", ".webm")
CONTACT_HINTS = ("contact", "kontakt", "contacto", "contatti", "about", "impressum", "reach-us", "reachus", "get-in-touch")
SOCIAL = {
    "linkedin": (r"""https?://(?:[\w\-]+\.)?linkedin\.com/(?:company|in|school|showcase)/[^\s"'<>)]+""", ("/share", "shareArticle")),
    "facebook": (r"""https?://(?:www\.|m\.|web\.)?facebook\.com/[^\s"'<>)]+""", ("sharer", "/share", "/plugins/", "/tr?", "/tr/", "facebook.com/2008", "/dialog/", "/login", "/hashtag/")),
    "instagram": (r"""https?://(?:www\.)?instagram\.com/[^\s"'<>)]+""", ("/p/", "/reel/", "/share", "/embed")),
    "twitter": (r"""https?://(?:www\.)?(?:twitter\.com|x\.com)/[^\s"'<>)]+""", ("/intent/", "/share", "/hashtag/", "/search?", "twitter.com/home")),
    "youtube": (r"""https?://(?:www\.)?youtube\.com/(?:channel/|user/|c/|@)[^\s"'<>)]+""", ("/embed/",)),
    "tiktok": (r"""https?://(?:www\.)?tiktok\.com/@[^\s"'<>)]+""", ()),
    "pinterest": (r"""https?://(?:[\w\-]+\.)?pinterest\.\w{2,6}/[^\s"'<>)]+""", ("/pin/create", "/pin/", "pinterest.com/js/")),
    "whatsapp": (r"""https?://(?:wa\.me|api\.whatsapp\.com/send)[^\s"'<>)]*""", ()),
    "telegram": (r"""https?://(?:t\.me|telegram\.me)/[^\s"'<>)]+""", ("/share",)),
}


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def normal_url(url: Column) -> Column:
    """With a scheme, or empty."""
    url = F.trim(F.coalesce(url, F.lit("")))
    return F.when(url == "", F.lit("")).when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(F.lit("https://"), url))


def host(url: Column) -> Column:
    """Lower-cased host without user, port and a leading www."""
    place = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":[0-9]*$", "")), r"^www\.", "")


def decode_cfemail(code: Column) -> Column:
    """The address hidden in hexadecimal digits: every byte is XORed with the first. Null unless it is an address."""
    valid = code.rlike("^([0-9a-fA-F]{2}){2,}$")
    first = F.conv(F.substring(code, 1, 2), 16, 10).cast("int")
    letters = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.length(code) / 2).cast("int") - 1)), lambda i: F.lpad(F.hex(F.conv(F.substring(code, 2 * i + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(first)), 2, "0"))
    email = F.decode(F.unhex(F.array_join(letters, "")), "utf-8")
    return F.when(valid, F.when(email.rlike(f"^(?:{EMAIL})$"), email))


def normal_email(email: Column) -> Column:
    """Percent-decoded (a plus stays), without white space or dots around it, lower-cased."""
    plain = F.coalesce(F.try_url_decode(F.regexp_replace(email, r"\+", "%2B")), email)
    return F.lower(F.regexp_replace(F.trim(plain), r"^\.+|\.+$", ""))


def is_junk_email(email: Column) -> Column:
    local, domain = F.regexp_extract(email, "^(.*)@", 1), F.substring_index(email, "@", -1)
    ends = "(?:" + "|".join(s.replace(".", r"\.") for s in JUNK_SUFFIXES) + ")$"
    domains = r"(?:^|\.)(?:" + "|".join(d.replace(".", r"\.") for d in JUNK_DOMAINS) + ")$"
    return email.rlike(ends) | (local == "example") | domain.rlike(domains) | local.rlike("^[0-9a-f]{24,}$")


def email_fits_site(email: Column, website: Column) -> Column:
    """A consumer mailbox, or the site's domain, or a domain above or below it; any address fits a site without host."""
    return _fits_host(email, host(normal_url(website)))


def _fits_host(email: Column, site: Column) -> Column:
    domain = F.regexp_replace(F.lower(F.substring_index(email, "@", -1)), r"^www\.", "")
    return domain.isin(*CONSUMER_DOMAINS) | (site == "") | (domain == site) | domain.endswith(F.concat(F.lit("."), site)) | site.endswith(F.concat(F.lit("."), domain))


def emails(html: Column, website: Column | None = None) -> Column:
    """Addresses in order of first sight: mailto links, hidden ones, then plain text; without placeholders."""
    linked = F.filter(F.transform(_all(html, MAILTO, 1), F.trim), lambda e: e.rlike(f"^(?:{EMAIL})$"))
    hidden = F.filter(F.transform(_all(html, CFEMAIL, 1), decode_cfemail), lambda e: e.isNotNull())
    found = F.transform(F.concat(linked, hidden, _all(html, EMAIL, 0)), normal_email)

    def good(e: Column) -> Column:
        return (e != "") & ~is_junk_email(e)

    if website is None:
        return F.array_distinct(F.filter(found, good))
    sites = F.array(host(normal_url(website)))  # bound once, not for each address; a site without host takes any
    return F.array_distinct(F.get(F.transform(sites, lambda s: F.filter(found, lambda e: good(e) & _fits_host(e, s))), F.lit(0)))


def clean_social(url: Column) -> Column:
    """Without trailing punctuation, query and fragment; WhatsApp links keep their query."""
    url = F.regexp_replace(url, r"""[),.;"']+$""", "")
    scheme, place = F.lower(F.regexp_extract(url, r"^([a-zA-Z]+)://", 1)), F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keeps = place.contains("whatsapp") | (place == "wa.me")
    return F.concat(scheme, F.lit("://"), place, path, F.when(keeps & (query != ""), F.concat(F.lit("?"), query)).otherwise(""))


def social_links(html: Column) -> Column:
    """Map from platform to its first profile link that isn't for sharing; platforms without one are left out."""

    def first(pattern: str, rejects: tuple[str, ...]) -> Column:
        links = _all(html, "(?iu)" + pattern, 0)
        if rejects:
            links = F.filter(links, lambda u: ~F.exists(F.array(*(F.lit(r.lower()) for r in rejects)), lambda r: F.lower(u).contains(r)))
        return F.get(F.transform(F.slice(links, 1, 1), clean_social), F.lit(0))  # the link is bound once

    entries = F.array(*(F.struct(F.lit(name).alias("key"), first(*rule).alias("value")) for name, rule in SOCIAL.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def join_url(base: Column, link: Column) -> Column:
    """A link resolved against a page's URL: absolute, //host, /path, ?query and relative forms, dots resolved."""
    scheme, root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1), F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(page, "[^/]*$", "")
    path = F.when(link.startswith("/"), link).when(link.startswith("?"), F.concat(page, link)).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), link))
    tail = F.regexp_extract(path, "([?#].*)$", 1)
    steps = F.split(F.regexp_replace(path, "[?#].*$", ""), "/")
    kept = F.aggregate(F.filter(steps, lambda s: s != "."), F.array().cast("array<string>"), lambda a, s: F.when((s == "..") & (F.size(a) > 1), F.slice(a, F.lit(1), F.size(a) - 1)).when(s == "..", a).otherwise(F.concat(a, F.array(s))))
    return F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link == "", base).otherwise(F.concat(root, F.array_join(kept, "/"), tail))


def contact_pages(html: Column, base: Column, limit: int = 2) -> Column:
    """The first `limit` (one at least) distinct links of the same site whose address hints at contacts."""
    hints = "|".join(CONTACT_HINTS)
    links = F.filter(F.transform(_all(html, HREF, 1), F.trim), lambda h: ~h.rlike("^(mailto:|tel:|javascript:|#)") & F.lower(h).rlike(hints))
    pages = F.transform(links, lambda h: F.regexp_replace(join_url(base, h), "#.*$", ""))
    own = F.filter(pages, lambda p: p.rlike("^https?://") & (_netloc(p) == _netloc(base)) & (p != base))
    return F.slice(F.array_distinct(own), 1, max(1, limit))


def _netloc(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)), r"^www\.", "")


def email_grounded(email: Column, page: Column) -> Column:
    """The address stands in the page, or its local part and its domain's first label both do."""
    e, p = F.lower(F.trim(email)), F.lower(page)
    local, label = F.substring_index(e, "@", 1), F.substring_index(F.substring_index(e, "@", -1), ".", 1)
    return F.coalesce(e.contains("@") & (p.contains(e) | ((local != "") & (label != "") & p.contains(local) & p.contains(label))), F.lit(False))


def bare_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^(https?://)?(www\.)?", ""), "/+$", "")


def url_grounded(url: Column, page: Column) -> Column:
    bare = bare_url(url)
    return F.coalesce((bare != "") & F.lower(page).contains(bare), F.lit(False))
