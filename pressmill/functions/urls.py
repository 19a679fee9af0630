"""Link keys as column expressions. Parts come from patterns, so that malformed links never raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tracking parameters besides utm_*.
TRACKING = ("fbclid", "gclid", "mc_eid", "igshid", "_ga", "mkt_tok")
# Foreign hosts that are dropped, and home hosts besides .ca.
BLOCKED_HOSTS = (
    "theguardian.com",
    "bbc.co.uk",
    "bbc.com",
    "reuters.com",
    "nytimes.com",
    "washingtonpost.com",
    "cnn.com",
    "aljazeera.com",
    "dw.com",
    "france24.com",
    "ft.com",
    "economist.com",
)
HOME_HOSTS = (
    "cbc.ca",
    "globalnews.ca",
    "ctvnews.ca",
    "thestar.com",
    "nationalpost.com",
    "financialpost.com",
    "torontosun.com",
    "vancouversun.com",
    "calgaryherald.com",
    "leaderpost.com",
    "montrealgazette.com",
    "edmontonjournal.com",
    "ottawacitizen.com",
)
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def strip(c: Column) -> Column:
    """Without white space at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def scheme(link: Column) -> Column:
    return F.lower(F.regexp_extract(strip(link), _URL, 1))


def raw_authority(link: Column) -> Column:
    """Host and port as written."""
    return F.regexp_extract(strip(link), _URL, 2)


def authority(link: Column) -> Column:
    return F.lower(raw_authority(link))


def host(link: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(authority(link), "^.*@", ""), ":[0-9]*$", "")


def path(link: Column) -> Column:
    return F.regexp_extract(strip(link), _URL, 3)


def query(link: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(strip(link), _URL, 4), r"^\?", "")


def form_decoded(c: Column) -> Column:
    """A name or value of a query as text: + is a blank, escapes are bytes of UTF-8, a % without two hex digits stays."""
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def form_encoded(c: Column) -> Column:
    """Text as a name or value of a query: blanks as +, letters, digits and _.-~ as they are, the rest as escapes."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def strip_tracking(link: Column) -> Column:
    """Drops the fragment and tracking parameters, lower-cases scheme and host, and writes the other parameters anew from their decoded form."""
    pair = lambda p: F.struct(
        form_decoded(F.substring_index(p, "=", 1)).alias("name"), form_decoded(F.when(p.contains("="), F.substr(p, F.instr(p, "=") + 1)).otherwise("")).alias("value")
    )
    pairs = F.transform(F.filter(F.split(query(link), "&"), lambda p: p != ""), pair)
    own = F.filter(pairs, lambda p: ~F.lower(p["name"]).rlike("^utm_") & ~F.lower(p["name"]).isin(*TRACKING))
    kept = F.array_join(F.transform(own, lambda p: F.concat(form_encoded(p["name"]), F.lit("="), form_encoded(p["value"]))), "&")
    rebuilt = F.concat(scheme(link), F.lit("://"), authority(link), path(link), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(strip(link).rlike(_URL) & (authority(link) != ""), rebuilt).otherwise(strip(link))


def _trimmed(c: Column) -> Column:
    return F.when(c.rlike("^/+$"), F.lit("/")).otherwise(F.regexp_replace(c, "/+$", ""))


def normalize_link(link: Column) -> Column:
    """Key for equal stories on ingest: no tracking, lower case, no closing slashes. The stripped link is worked out once for each row."""
    return F.transform(F.array(F.lower(strip_tracking(link))), _trimmed)[0]


def story_link(link: Column) -> Column:
    """Key for clustering: scheme, host and path alone."""
    p = F.lower(path(link))
    whole = F.concat(scheme(link), F.lit("://"), authority(link), F.when(p == "", F.lit("/")).otherwise(p))
    return F.when(authority(link) != "", whole).otherwise(F.lower(strip(link)))


def image_key(link: Column) -> Column:
    """Key for equal pictures: host and path without closing slashes; the whole address where either is missing."""
    p = F.regexp_replace(F.lower(path(link)), "/+$", "")
    return F.when((authority(link) != "") & (p != ""), F.concat(authority(link), p)).otherwise(F.lower(strip(link)))


def client_link(link: Column) -> Column:
    """The reader's own key: lower case without closing slashes; tracking and fragment stay."""
    return F.regexp_replace(F.lower(strip(link)), "/+$", "")


def _on(h: Column, hosts: tuple[str, ...]) -> Column:
    return h.rlike(r"(^|\.)(" + "|".join(x.replace(".", r"\.") for x in hosts) + ")$")


def is_blocked_host(link: Column) -> Column:
    return _on(host(link), BLOCKED_HOSTS)


def is_home_host(link: Column) -> Column:
    h = host(link)
    return (h != "") & ~_on(h, BLOCKED_HOSTS) & (h.endswith(".ca") | _on(h, HOME_HOSTS))


def is_aggregator(link: Column) -> Column:
    return F.lower(F.coalesce(link, F.lit(""))).contains("news.google.com")


def is_http(link: Column) -> Column:
    return strip(link).rlike("^https?://")


def looks_like_image(link: Column) -> Column:
    """Whether the path ends as pictures do."""
    return F.substring_index(F.lower(F.coalesce(link, F.lit(""))), "?", 1).rlike(r"\.(?:jpg|jpeg|png|gif|webp|svg|bmp)$")


def encoded(c: Column) -> Column:
    """Percent-encoded as for one part of an address: blanks as %20, and ! ' ( ) ~ as they are."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out
