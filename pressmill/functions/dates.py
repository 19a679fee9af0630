"""Published dates as column expressions; every form that doesn't parse is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import strip

# The accepted forms after a leading weekday is dropped.
FORMS = (
    "d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm:ss z",
    "d MMM yyyy HH:mm:ss",
    "MMM d, yyyy HH:mm",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
)


def parse_published(text: Column) -> Column:
    """Timestamp (session time zone UTC) of mail dates, ISO 8601 and plain forms."""
    bare = F.regexp_replace(strip(text), r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+", "")
    iso = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.try_to_timestamp(bare))
    return F.coalesce(iso, *[F.try_to_timestamp(F.substring(bare, 1, 40), F.lit(f)) for f in FORMS])


def display_published(ts: Column) -> Column:
    """'Mar 20, 2026 · 6:40 PM', without the time at midnight."""
    timed = F.date_format(ts, "HH:mm:ss") != "00:00:00"
    return F.when(timed, F.date_format(ts, "MMM d, yyyy '·' h:mm a")).otherwise(F.date_format(ts, "MMM d, yyyy"))


def brief_title(ts: Column) -> Column:
    return F.date_format(ts, "EEEE, MMMM d, yyyy")
