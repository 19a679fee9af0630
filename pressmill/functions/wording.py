"""Rules that tidy, judge and rebuild summaries, as column expressions.

A summary is cut to three sentences and 55 words, filler at its end goes, and
one that is too thin or repeats its title is rebuilt from the excerpt, else
from the title. ``checked_summary`` chains them, one column a step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text
from .similarity import ratio
from .urls import strip

MOST_SENTENCES, MOST_WORDS = 3, 55
EXCERPT_MIN, RICH_EXCERPT_MIN = 40, 80
# Phrases that ask the reader to go elsewhere.
CALLS = r"(?i)\b(?:continue\s+reading|read\s+more|full\s+story|click\s+here|watch\s+the\s+video|see\s+more)\b[\s.:]*"
# Endings of sentences that say nothing.
VAGUE = (
    r"(?:further|more)\s+updates\s+(?:are\s+)?expected",
    r"more\s+details\s+(?:to\s+come|may\s+follow)",
    r"developing\s+stor(?:y|ies)",
    r"stay\s+tuned",
    r"remains?\s+to\s+be\s+seen",
    r"as\s+more\s+information\s+becomes?\s+available",
    r"watch\s+for\s+updates",
    r"this\s+is\s+a\s+developing",
)
# Wordings of headlines and what replaces them, in order.
SOFTER = (
    (r"\bcontinues to\b", ""),
    (r"\bhopes to\b", "plans to"),
    (r"\breportedly\b", ""),
    (r"\bit is reported that\b", ""),
    (r"\bsources say\b", ""),
    (r"\bWatch:\s*", ""),
    (r"\bBREAKING:\s*", ""),
    (r"\bin\s+OT\b", "in overtime"),
    (r"\bOT\.$", "overtime."),
    (r"\bOT\b$", "overtime"),
    (r"\bamid\b", "during"),
    (r"\bamidst\b", "during"),
)
# Headlines of known forms, what figures in them rule out, and the wordings that replace them.
WON_LATE = r"(?i)^(.+?)\s+down\s+(.+?)\s+in\s+OT\.?$"
WON = r"(?i)^(.+?)\s+down\s+(.+)$"
FIGURES = r"(?i)\d|%|points?|percent"
POLICE_WELCOME = r"(?i)^(.+?)\s+Police\s+Service\s+welcomes\s+new\s+(.+)$"
SEARCH_DOG = r"(?i)electronic\s+storage\s+detection\s+dog$"
DETAINED = r"(?is)^ICE\s+detains\s+(.+?)\s+in\s+Texas,?\s*amid\s+(.+)$"
DETAINED_SHORT = r"(?is)^ICE\s+detains\s+(.*)$"
LONG_ROAD, ROAD = r"(?i)bumpy\s+road\s+to\s+citizenship", r"(?i)^bumpy\s+road\b"
ATTRIBUTED = (r"(?i),\s*(?:says|reports?|according to|per)\b.*$", r"(?i)\s+(?:says|reports?)\s+.+$")


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def without_calls(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), CALLS, ""))


def is_vague(sentence: Column) -> Column:
    low = F.lower(strip(sentence))
    ends = F.lit(False)
    for phrase in VAGUE:
        ends = ends | low.rlike(rf"\b{phrase}\s*\.?$")
    loose = (low.contains("further updates") & low.contains("expected")) | (
        low.contains("more details") & (low.contains("come") | low.contains("follow"))
    )
    return (F.length(low) >= 12) & (ends | loose)


def without_vague_end(c: Column) -> Column:
    """Sentences up to the last that says something."""
    parts = text.sentences(c)
    last = F.array_max(F.transform(parts, lambda s, i: F.when(~is_vague(s), i + 1)))
    return F.array_join(F.slice(parts, F.lit(1), F.coalesce(last, F.lit(0))), " ")


def _whole(words: Column) -> Column:
    """Words as a sentence: cut after the last mark inside, or closed with a full stop."""
    joined = F.array_join(words, " ")
    upto = F.regexp_extract(joined, r"(?s)^(.+[.!?])", 1)
    return F.when(joined == "", "").when(joined.rlike(r"[.!?]$"), joined).when(upto != "", upto).otherwise(F.concat(joined, F.lit(".")))


def clean_summary(c: Column) -> Column:
    """At most MOST_SENTENCES sentences and MOST_WORDS words, without calls to read on, with one closing mark."""
    parts = F.slice(text.sentences(text.squeeze(without_calls(c))), 1, MOST_SENTENCES)
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.lit("").alias("out"))
    add = lambda out, s: F.when(s == "", out).when(out == "", s).otherwise(F.concat(out, F.lit(" "), s))

    def step(acc: Column, s: Column) -> Column:
        words = _words(s)
        fits = acc["n"] + F.size(words) <= MOST_WORDS
        head = F.when(acc["n"] < MOST_WORDS, _whole(F.slice(words, F.lit(1), F.greatest(F.lit(0), MOST_WORDS - acc["n"])))).otherwise("")
        return F.when(acc["full"], acc).otherwise(
            F.struct(
                F.when(fits, acc["n"] + F.size(words)).otherwise(acc["n"]).alias("n"),
                (~fits).alias("full"),
                add(acc["out"], F.when(fits, s).otherwise(head)).alias("out"),
            )
        )

    return text.tidy_tail(text.squeeze(F.aggregate(parts, start, step, lambda acc: acc["out"])))


def is_redundant(summary: Column, title: Column, likeness: Column) -> Column:
    """Whether a summary adds almost nothing to its title; ``likeness`` is ``ratio`` of the two in lower case."""
    s, t = F.lower(strip(summary)), F.lower(strip(title))
    kept = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(r"[a-z0-9']+"), F.lit(0)), lambda w: F.length(w) > 2))
    own, of_title = kept(s), kept(t)
    inside = (F.size(of_title) > 0) & (F.size(F.array_except(own, of_title)) == 0) & (F.size(own) >= F.least(F.lit(4), F.size(of_title)))
    phrase = (F.length(t) > 20) & s.contains(t) & (F.length(s) < F.length(t) + 25)
    return (s != "") & (t != "") & ((s == t) | phrase | (likeness >= 0.88) | inside)


def sentence_case(c: Column) -> Column:
    """First letter large, a closing mark; 'News update.' for nothing."""
    s = strip(c)
    large = F.when(
        s.rlike(r"\p{L}"),
        F.concat(
            F.regexp_extract(s, r"(?s)^([^\p{L}]*)", 1), F.upper(F.regexp_extract(s, r"(?s)^[^\p{L}]*(\p{L})", 1)), F.regexp_extract(s, r"(?s)^[^\p{L}]*\p{L}(.*)$", 1)
        ),
    ).otherwise(s)
    return F.when(s == "", text.DEFAULT_TITLE).when(large.rlike("[.!?…]$"), large).otherwise(F.concat(large, F.lit(".")))


def softened(c: Column) -> Column:
    for pattern, plain in SOFTER:
        c = F.regexp_replace(c, f"(?i){pattern}", plain)
    return c


def without_attribution(c: Column) -> Column:
    for pattern in ATTRIBUTED:
        c = F.regexp_replace(c, pattern, "")
    return c


def _two_from_split(title: Column) -> Column:
    """Two sentences around the first of : – — with more than eight letters on either side."""
    made = []
    for mark in (":", "–", "—"):
        at = F.instr(title, mark)
        a, b = strip(F.substr(title, F.lit(1), at - 1)), strip(F.substr(title, at + 1))
        one = lambda c: sentence_case(softened(without_attribution(c)))
        made.append(F.when((at > 0) & (F.length(a) > 8) & (F.length(b) > 8), F.concat(one(a), F.lit(" "), one(b))))
    return F.coalesce(*made)


def _won(title: Column) -> Column:
    """'A down B': who beat whom, unless figures went down."""
    side = lambda p, k: strip(F.regexp_extract(title, p, k))
    said = lambda p, end: F.concat(F.lit("The "), side(p, 1), F.lit(" beat the "), side(p, 2), F.lit(end))
    names = ~side(WON, 2).rlike(FIGURES) & (F.size(_words(side(WON, 1))) >= 2) & (F.size(_words(side(WON, 2))) >= 2)
    return F.when(title.rlike(WON_LATE), said(WON_LATE, " in overtime")).when(title.rlike(WON) & names, said(WON, ""))


def _police_welcome(title: Column) -> Column:
    rest = F.regexp_replace(strip(F.regexp_extract(title, POLICE_WELCOME, 2)), r"\.+$", "")
    what = F.when(rest.rlike(SEARCH_DOG), "dog trained to detect electronic storage devices").otherwise(rest)
    return F.when(title.rlike(POLICE_WELCOME), F.concat(strip(F.regexp_extract(title, POLICE_WELCOME, 1)), F.lit(" police have introduced a new "), what))


def _detained(title: Column) -> Column:
    who = F.regexp_replace(strip(F.regexp_extract(title, DETAINED, 1)), ",+$", "")
    who = F.regexp_replace(F.regexp_replace(who, r"(?i)\bmom,\s*daughter\b", "mother and daughter"), r"(?i)\bmom\b", "mother")
    why = F.regexp_replace(strip(F.regexp_extract(title, DETAINED, 2)), r"\.+$", "")
    why = (
        F.when(why.rlike(LONG_ROAD), "during a complicated citizenship process")
        .when(why.rlike(ROAD), "during a difficult process")
        .otherwise(F.concat(F.lit("amid "), why))
    )
    return F.when(title.rlike(DETAINED), F.concat(F.lit("A "), who, F.lit(" were detained by ICE in Texas "), why)).when(
        title.rlike(DETAINED_SHORT), F.concat(F.lit("ICE detained "), strip(F.regexp_extract(title, DETAINED_SHORT, 1)))
    )


def title_summary(title: Column) -> Column:
    """One or two sentences from a headline alone: a split, else a known pattern, else softer words."""
    t = strip(title)
    tidy = softened(without_attribution(t))
    tidy = F.regexp_replace(text.squeeze(F.regexp_replace(tidy, r"\s*,\s*,", ",")), r"^[ ,;—-]+|[ ,;—-]+$", "")
    tidy = strip(F.regexp_replace(tidy, r"\s+\.", "."))
    known = F.coalesce(_won(t), _police_welcome(t), _detained(t), F.when(F.length(tidy) < 8, t).otherwise(tidy))
    return F.when(t == "", text.DEFAULT_TITLE).otherwise(F.coalesce(_two_from_split(t), sentence_case(known)))


def _body(excerpt: Column) -> Column:
    """Text of an excerpt of EXCERPT_MIN letters, tags out; else empty."""
    raw = strip(excerpt)
    plain = text.squeeze(F.regexp_replace(raw, r"<[^>]+>", " "))
    return F.when((F.length(raw) >= EXCERPT_MIN) & (F.length(plain) >= EXCERPT_MIN), plain).otherwise("")


def two_sentences(excerpt: Column) -> Column:
    """Two sentences of an excerpt, or two runs of its words; empty where it is too short."""
    plain = _body(excerpt)
    chunk = F.substring(plain, 1, 2000)
    parts = F.filter(text.sentences(chunk), lambda s: F.length(s) > 20)
    words = _words(chunk)
    half = F.least(F.floor(F.size(words) / 2), F.lit(28)).cast("int")
    run = lambda lo, n: sentence_case(F.array_join(F.slice(words, lo, n), " "))
    one = lambda k: sentence_case(strip(F.substring(F.get(parts, k), 1, 500)))
    return (
        F.when(plain == "", "")
        .when(F.size(parts) >= 2, F.concat(one(0), F.lit(" "), one(1)))
        .when(F.size(words) < 24, sentence_case(F.concat(strip(F.substring(chunk, 1, 400)), F.lit("."))))
        .otherwise(F.concat(run(F.lit(1), half), F.lit(" "), run(half + 1, F.lit(28))))
    )


def second_sentence(excerpt: Column, title: Column) -> Column:
    """A sentence of the excerpt that shares few words with the title, else a run of words; empty where there is none."""
    plain = _body(excerpt)
    of_title = F.filter(_words(F.lower(F.coalesce(title, F.lit("")))), lambda w: F.length(w) > 3)
    able = F.filter(
        text.sentences(F.substring(plain, 1, 2000)),
        lambda s: (F.length(s) >= 25) & (F.size(_words(s)) >= 5) & (F.size(F.filter(of_title, lambda w: F.lower(s).contains(w))) <= 3),
    )
    words = _words(plain)
    return (
        F.when(plain == "", "")
        .when(F.size(able) > 0, sentence_case(F.substring(F.get(able, 0), 1, 500)))
        .when(F.size(words) >= 12, sentence_case(F.array_join(F.slice(words, 9, 28), " ")))
        .otherwise("")
    )


def rebuilt_summary(title: Column, excerpt: Column) -> Column:
    """From the excerpt where it is long enough, else from the title."""
    made = two_sentences(excerpt)
    return F.when(made != "", clean_summary(made)).otherwise(clean_summary(title_summary(title)))


def checked_summary(df: DataFrame, summary: str, title: str, excerpt: str, to: str = "checked") -> DataFrame:
    """``df`` with a summary made elsewhere brought into form: filler out, thin or redundant ones rebuilt. Rows keep their columns."""
    keep = df.columns
    s, t, ex = F.col(summary), F.col(title), strip(F.col(excerpt))
    rich = F.length(ex) >= EXCERPT_MIN
    out = df.withColumn("__s", clean_summary(without_vague_end(without_calls(s)))).withColumn("__rebuilt", rebuilt_summary(t, ex))
    out = out.withColumn("__two", clean_summary(two_sentences(ex))).withColumn("__more", second_sentence(ex, t))
    lone = (F.size(text.sentences(F.col("__s"))) == 1) & rich & (F.col("__more") != "")
    out = out.withColumn("__s1", F.when(lone, clean_summary(F.concat("__s", F.lit(" "), F.col("__more")))).otherwise(F.col("__s")))
    thin = F.size(text.sentences(F.col("__s1"))) < 2
    out = out.withColumn("__s2", F.when(thin & rich & (F.col("__two") != ""), F.col("__two")).otherwise(F.col("__s1")))
    out = out.withColumn("__s3", F.when((F.col("__s") == "") | (F.size(text.sentences(F.col("__s2"))) < 2), F.col("__rebuilt")).otherwise(F.col("__s2")))
    low = lambda c: F.lower(strip(c))
    out = out.withColumn("__like", ratio(low(F.col("__s3")), low(t))).withColumn("__like2", ratio(low(F.col("__rebuilt")), low(t)))
    echo = (
        rich
        & (F.col("__s") != "")
        & is_redundant(F.col("__s3"), t, F.col("__like"))
        & (F.col("__rebuilt") != "")
        & ~is_redundant(F.col("__rebuilt"), t, F.col("__like2"))
    )
    return out.withColumn(to, F.when(echo, F.col("__rebuilt")).otherwise(F.col("__s3"))).select(*keep, to)


def enriched_excerpt(excerpt: Column, title: Column, source: Column, description: Column) -> Column:
    """The excerpt where it is long and says more than the title; else, for an aggregator, the page's description; else the excerpt or null."""
    ex = strip(excerpt)
    rich = (F.length(ex) >= RICH_EXCERPT_MIN) & ~is_redundant(ex, title, ratio(F.lower(ex), F.lower(strip(title))))
    found = F.when(is_aggregator_source(source) & (strip(description) != ""), strip(description))
    return F.when(rich, ex).otherwise(F.coalesce(found, F.nullif(ex, F.lit(""))))


def is_aggregator_source(source: Column) -> Column:
    return F.lower(strip(source)).contains("google news")
