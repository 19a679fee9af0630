"""Titles, fingerprints and deterministic summaries as column expressions."""

from __future__ import annotations

import json
from functools import lru_cache
from html import unescape
from html.entities import html5 as entities

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .urls import strip

SUMMARY_MAX, SUMMARY_MIN, FRONT = 220, 180, 2000
DEFAULT_TITLE = "News update."
# Words that carry no topic.
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "as", "by", "with", "from", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "can", "not", "no", "yes", "it",
    "its", "this", "that", "these", "those", "than", "then", "so", "if", "about", "into", "over", "after", "before", "out", "up", "down", "more",
    "most", "some", "such", "just", "also", "only", "even", "both", "all", "any", "each", "other", "new", "say", "says", "said", "here", "how",
    "what", "when", "where", "why", "who", "which",
)
# Opening phrases without content.
PREFIXES = r"breaking|just in|watch live|live updates?|live:|watch:|exclusive|update:?"


def once(value: Column, body) -> Column:
    """``body`` of a value that is worked out once for each row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def normalize_title(title: Column) -> Column:
    """Key form: lower case, dashes to blanks, punctuation gone, blanks single."""
    dashed = F.regexp_replace(F.lower(strip(title)), "[–—-]", " ")
    return squeeze(F.regexp_replace(dashed, r"(?U)[^\w\s]", ""))


def client_title(title: Column) -> Column:
    """The reader's own key form, which drops all but ASCII letters and digits."""
    dashed = F.regexp_replace(F.lower(strip(title)), "[–—-]", " ")
    return squeeze(F.regexp_replace(dashed, r"[^a-z0-9\s]", ""))


def fingerprint(title: Column, source: Column, published: Column) -> Column:
    """32 hex digits of sha256 over title key, source and published text."""
    raw = F.concat_ws("|", normalize_title(title), F.lower(strip(source)), F.lower(strip(published)))
    return F.substring(F.sha2(raw, 256), 1, 32)


def placeholder(key: Column, n: int = 4) -> Column:
    """Number of the placeholder picture for a key: the first 32 bits of its md5 modulo n."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n).cast("int")


def story_title(title: Column) -> Column:
    """Title for clustering: opening phrases, punctuation and case removed; 'untitled' if nothing is left."""
    bare = F.regexp_replace(strip(F.lower(strip(title))), rf"^(?:(?:{PREFIXES})\s*[:|\-–]?\s*)+", "")
    return once(squeeze(F.regexp_replace(bare, r"(?U)[^\w\s]+", " ")), lambda s: F.when(s == "", F.lit("untitled")).otherwise(s))


def tokens(text: Column) -> Column:
    """Distinct words of more than one letter that carry a topic."""
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS)))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(strip(text), r"(?<=[.!?])(?U)\s+"), strip), lambda s: s != "")


def tidy_tail(text: Column) -> Column:
    """One closing mark: runs of marks become one, and a full stop is added where none is."""
    single = F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(text), r"\.\.\.", "…"), r"[.]{2,}$", "…"), r"[.!?]{2,}$", ".")
    return once(single, lambda s: F.when(s == "", "").when(s.rlike("[.!?…]$"), s).otherwise(F.concat(s, F.lit("."))))


def clamp(text: Column, limit: int = SUMMARY_MAX) -> Column:
    """At most ``limit`` characters, cut at a blank past the middle, with one closing mark."""

    def cut(head: Column) -> Column:
        before = F.regexp_extract(head, r"^(?s)(.*) [^ ]*$", 1)
        return F.concat(F.regexp_replace(F.when(F.length(before) > limit // 2, before).otherwise(head), "[.,; ]+$", ""), F.lit("…"))

    return once(squeeze(text), lambda s: tidy_tail(F.when(F.length(s) <= limit, s).otherwise(once(F.substring(s, 1, limit), cut))))


REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


@lru_cache(maxsize=1)
def _references() -> str:
    """JSON of all named character references, and of the numbers that stand for other characters, without & and ;.

    By first letter, as a map is searched entry by entry.
    """
    known = {name[:-1]: char for name, char in entities.items() if name.endswith(";")} | {f"#{n}": unescape(f"&#{n};") for n in (0, *range(0x80, 0xA0))}
    by_letter: dict[str, dict[str, str]] = {}
    for name in sorted(known, key=lambda x: (len(x), x)):
        by_letter.setdefault(name[0], {})[name] = known[name]
    return json.dumps(by_letter)


def decoded(c: Column) -> Column:
    """Character references decoded, once; unknown ones stay."""
    known = F.from_json(F.lit(_references()), "map<string,map<string,string>>")

    def char(ref: Column) -> Column:
        body = F.substr(ref, F.lit(2), F.length(ref) - 2)
        digits = F.regexp_extract(body, "^#([0-9]+)$", 1)
        number = F.when(digits != "", digits).otherwise(F.conv(F.regexp_extract(body, "^#[xX]([0-9a-fA-F]+)$", 1), 16, 10)).try_cast("int")
        able = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        by_number = F.when(able, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        name = F.when(number.isNotNull(), F.concat(F.lit("#"), number.cast("string"))).otherwise(body)
        listed = F.try_element_at(F.try_element_at(known, F.substring(name, 1, 1)), name)
        return F.when((number > 0) & ~number.between(0x80, 0x9F), F.coalesce(by_number, ref)).otherwise(F.coalesce(listed, by_number, ref))

    def whole(s: Column) -> Column:
        chars = F.transform(F.regexp_extract_all(s, F.lit(REFERENCE), F.lit(0)), char)
        put = lambda found: F.array_join(F.transform(F.split(s, REFERENCE, -1), lambda gap, i: F.concat(gap, F.coalesce(F.get(found, i), F.lit("")))), "")
        return F.when(s.rlike(REFERENCE), once(chars, put)).otherwise(s)

    return once(c, whole)


def plain(markup: Column) -> Column:
    """Text of a fragment of HTML: tags and hidden parts out, references decoded (twice, as feeds encode twice), blanks single."""
    s = F.regexp_replace(F.coalesce(markup, F.lit("")), r"(?is)<(script|style|template)\b.*?</\1\s*>|<!--.*?-->", " ")
    s = F.regexp_replace(s, r"<[^>]*>", " ")
    return squeeze(decoded(decoded(s)))


def looks_like_html(c: Column) -> Column:
    return c.contains("<") & c.contains(">")


def add_summary(df: DataFrame, title: str, excerpt: str, to: str = "made") -> DataFrame:
    """``df`` with struct<summary, summary_source> by the first rule that gives text: excerpt, raw excerpt, title.

    A plain excerpt of 40 characters gives its first two sentences, clamped, or
    the whole clamped where those come out short; one of 15 is clamped. Else a
    raw excerpt of 40 gives two informative sentences or two runs of its words.
    Steps are columns of their own, so that each is worked out once.
    """
    keep = df.columns
    out = df.withColumn("__ex", strip(F.col(excerpt))).withColumn("__body", plain(F.col("__ex")))
    # A summary ends within its first SUMMARY_MAX letters, so what lies beyond FRONT changes none.
    out = out.withColumn("__body", F.substring("__body", 1, FRONT))
    out = out.withColumn("__parts", F.slice(sentences(F.col("__body")), 1, 2))
    out = out.withColumn("__joined", F.when(F.size("__parts") >= 1, F.concat_ws(" ", "__parts")).otherwise(F.col("__body")))
    out = out.withColumn("__lead", clamp(F.col("__joined"))).withColumn("__clamped", clamp(F.col("__body")))
    # The raw excerpt counts only where its text is nearly all markup.
    bare = squeeze(F.regexp_replace("__ex", r"<[^>]+>", " "))
    out = out.withColumn("__text", F.when(F.length("__body") < 15, bare).otherwise(""))
    out = out.withColumn("__chunk", F.substring("__text", 1, 2000))
    out = out.withColumn("__long", F.slice(F.filter(sentences(F.col("__chunk")), lambda s: F.length(s) > 20), 1, 2))
    out = out.withColumn("__words", F.filter(F.split("__chunk", " "), lambda w: w != ""))
    half = F.least(F.floor(F.size("__words") / 2), F.lit(28)).cast("int")
    raw = (
        F.when((F.length("__ex") < 40) | (F.length("__text") < 40), F.lit(""))
        .when(F.size("__long") >= 2, F.concat_ws(" ", "__long"))
        .when(F.size("__words") < 24, F.concat(strip(F.substring("__chunk", 1, 400)), F.lit(".")))
        .otherwise(F.concat_ws(" ", F.slice("__words", F.lit(1), half), F.slice("__words", half + 1, F.lit(28))))
    )
    out = out.withColumn("__raw", clamp(raw))
    kind = F.when(looks_like_html(F.col("__ex")), F.lit("html")).otherwise(F.lit("rss"))
    own_title = F.when(strip(F.col(title)) == "", F.lit(DEFAULT_TITLE)).otherwise(strip(F.col(title)))
    made = lambda t, src: F.struct(t.alias("summary"), src.alias("summary_source"))
    short = (F.length("__lead") < SUMMARY_MIN) & (F.length("__body") > F.length("__lead"))
    out = out.withColumn(
        to,
        F.when(F.length("__body") >= 40, made(F.when(short, F.col("__clamped")).otherwise(F.col("__lead")), kind))
        .when(F.length("__body") >= 15, made(F.col("__clamped"), kind))
        .when(F.col("__raw") != "", made(F.col("__raw"), F.lit("content")))
        .otherwise(made(clamp(own_title), F.lit("title_fallback"))),
    )
    return out.select(*keep, to)


def read_seconds(n_words: Column) -> Column:
    """Reading time at 200 words a minute, from 20 to 180 seconds."""
    return F.greatest(F.lit(20), F.least(F.lit(180), F.bround(n_words / 200.0 * 60.0).cast("int")))


def read_label(seconds: Column) -> Column:
    """'~n sec' below a minute, else '~n min'."""
    minutes = F.greatest(F.lit(1), F.bround(seconds / 60.0).cast("int"))
    return F.when(seconds < 60, F.format_string("~%d sec", seconds)).otherwise(F.format_string("~%d min", minutes))


def hash_hue(text: Column) -> Column:
    """A hue from the 31-multiplier string hash, modulo 2^32."""
    codes = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return (F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c) % 4294967296) % 360).cast("int")
