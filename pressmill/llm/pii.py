"""Personal data: base patterns, and candidate spans judged by boosted trees. DataFrame operations only.

The base patterns give spans that always stay. High-recall generators propose
further spans of the same four kinds, which may overlap each other and the base
spans: anything around an @ or a bracketed at, digit groups with plain,
bracketed or spaced dots, and digit runs with up to two separators between
digits. Each candidate has format and context features of few values, worked
out on its plain form (bracketed marks made plain, a leading + dropped), so
that the mark which decides a base pattern is not among them.

Labels come from validation: a candidate on a base span of its kind teaches
yes, with its deciding mark hidden; one that is shown to be something else
teaches no (see ``_taught``); all others teach nothing, as what the base
patterns miss may be among them, and are what the model judges. Numbers that
fail a checksum or a range, and handles without a domain, show what words and
formats such numbers and handles have besides; those that pass by chance have
the same. So the trees are not told of checksum, range or domain: no feature
restates a label, and they judge by format and context alone. Each kind gets
boosted trees of depth DEPTH over the table of its distinct feature vectors
with their counts, of all documents; the features' values bound that table.
Half of the documents, by hash, fit the trees, the other half gives the
threshold: the least score at which PRECISION of the labelled candidates above
it are true. The trees become one column expression. Candidates at or above the
threshold that touch no base span are added, the leftmost, then longest, first.

Positions are code points. They come from the lengths of the pieces between
matches by block sums, so a text of n matches costs n^(4/3) additions; a text
is scanned twice for each pattern, and only where it has the character that the
pattern needs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace

KINDS = ("email", "ip", "card", "phone")
# The possessive forms and the look-behinds match what the plain patterns match and keep runs of any length linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:@|\x20?[\[({]\x20?(?:[Aa][Tt]|@)\x20?[\])}]\x20?)"
_DOT = r"(?:\.|\x20?[\[({]\x20?(?:[Dd][Oo][Tt]|\.)\x20?[\])}]\x20?|\x20[Dd][Oo][Tt]\x20|\x20\.\x20)"
GENERATORS = {
    "email": rf"(?<![^\x20\x09-\x0D<>\"'(),;:])[^\x20\x09-\x0D<>\"'(),;:@\[\]{{}}]++{_AT}[^\x20\x09-\x0D<>\"'(),;:@\[\]{{}}]++(?:{_DOT}[A-Za-z0-9-]++)*+",
    "ip": rf"(?<![0-9A-Za-z.])[0-9]{{1,3}}+(?:{_DOT}[0-9]{{1,3}}+)++",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9])++",
    "phone": r"(?<![0-9A-Za-z])[+(]{0,2}[0-9](?:[\x20().-]{0,3}[0-9])++",
}
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
#: What a text needs for a generator, where that is more than the base pattern's.
WIDER = NEEDS | {"email": r"@|(?i)[\[({]\x20?at\x20?[\])}]"}
DEPTH = 3
TREES = 40
RATE = 0.3
PRECISION = 0.98
FEATURES = ("digits", "groups", "widest", "dots", "hyphens", "blanks", "parens", "before", "after", "cue", "word")
#: The share of numbers that pass a kind's check by chance: one last digit in ten is the Luhn sum's.
CHANCE = {"card": 0.1}
#: The word before a candidate is one of so many hash values.
WORDS = 16
_MATCH = "array<struct<start: int, end: int, s: string, left: string, right: string>>"


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _spans(text: Column, pattern: str, needs: str) -> Column:
    """array<struct<start, end, s, left, right>> of the matches, leftmost first.

    ``left`` and ``right`` are up to 15 and 2 characters around a match, from
    the neighbouring matches and what lies between. A match starts at the sum
    of all lengths before it: whole blocks, then what precedes it in its own.
    """
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)

    def placed(m: Column) -> Column:
        found, gaps = m["found"], m["gaps"]
        lengths = F.transform(found, lambda s, i: F.length(s) + F.length(F.get(gaps, i)))
        block = F.greatest(F.lit(16), F.ceil(1.26 * F.pow(F.size(found), F.lit(1 / 3))).cast("int"))
        return _bound(F.struct(lengths.alias("n"), block.alias("b")), lambda x: _bound(
            F.transform(F.sequence(F.lit(0), F.floor((F.size(x["n"]) - 1) / x["b"]).cast("int")), lambda k: total(F.slice(x["n"], k * x["b"] + 1, x["b"]))),
            lambda sums: _bound(
                F.transform(sums, lambda _, k: total(F.slice(sums, F.lit(1), k))),
                lambda begin: F.transform(found, lambda s, i: F.transform(
                    F.array(
                        F.get(begin, F.floor(i / x["b"]).cast("int"))
                        + total(F.slice(x["n"], F.floor(i / x["b"]).cast("int") * x["b"] + 1, i % x["b"]))
                        + F.length(F.get(gaps, i))
                    ),
                    lambda at: F.struct(
                        at.alias("start"),
                        (at + F.length(s)).alias("end"),
                        s.alias("s"),
                        F.right(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(gaps, i)), F.lit(15)).alias("left"),
                        F.left(F.concat(F.get(gaps, i + 1), F.coalesce(F.get(found, i + 1), F.lit(""))), F.lit(2)).alias("right"),
                    ),
                )[0]),
            ),
        ))

    pieces = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    none = F.expr(f"cast(array() as {_MATCH})")
    run = _bound(pieces, lambda m: F.when(F.size(m["found"]) > 0, placed(m)).otherwise(none))
    return F.when(text.rlike(needs), run).otherwise(none)


def _luhn(digits: Column) -> Column:
    turned = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
    ))
    return F.aggregate(turned, F.lit(0), lambda a, d: a + d) % 10 == 0


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = F.translate(s, " -", "")
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.translate(s, "+ ().-", "")).between(10, 15)
    return F.lit(True)


def _keeps(kind: str):
    return lambda m: _valid(kind, m["s"])


def _named(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with an array column base_<kind> of the valid base spans of each kind."""
    for kind in KINDS:
        docs = docs.withColumn(f"__raw_{kind}", _spans(F.col(text), PATTERNS[kind], NEEDS[kind]))
        docs = docs.withColumn(f"base_{kind}", F.filter(f"__raw_{kind}", _keeps(kind))).drop(f"__raw_{kind}")
    return docs


def _plain(kind: str, s: Column) -> Column:
    """The candidate with bracketed and spelled marks made plain, one separator in cards, and without a leading plus."""
    if kind == "card":
        return F.regexp_replace(s, r"[\x20._/-]+", "-")
    at = F.regexp_replace(s, r"(?i)\x20?[\[({]\x20?(?:at|@)\x20?[\])}]\x20?", "@")
    return F.regexp_replace(F.regexp_replace(at, rf"{_DOT}", "."), r"^[(]?\+", "")


def _features(s: Column, left: Column, right: Column) -> dict[str, Column]:
    """Format and context of a candidate in plain form as small integers; their product bounds the table of vectors."""
    digits = F.regexp_replace(s, "[^0-9]", "")
    groups = F.filter(F.split(s, "[^0-9]+"), lambda g: g != "")
    word = F.lower(F.regexp_extract(left, r"(\p{L}+)[^\p{L}\p{N}]{0,4}$", 1))
    count = lambda mark, most: F.least(F.length(s) - F.length(F.translate(s, mark, "")), F.lit(most))
    kind_of = lambda c: (
        F.when(c.rlike(r"[\x20\x09-\x0D]"), 0).when(c == "", 0).when(c.rlike(r"[\p{L}]"), 1).when(c.rlike(r"[=\"'#/_]"), 2).otherwise(3)
    )
    return {
        "digits": F.least(F.length(digits), F.lit(20)),
        "groups": F.least(F.size(groups), F.lit(6)),
        "widest": F.least(F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)), F.lit(8)),
        "dots": count(".", 4),
        "hyphens": count("-", 3),
        "blanks": count(" ", 3),
        "parens": (F.instr(s, "(") > 0).cast("int"),
        "before": kind_of(F.right(left, F.lit(1))),
        "after": kind_of(F.left(right, F.lit(1))),
        "cue": F.lower(left).rlike(r"(tel|phone|call|fax|mobile|cell|card|visa|mail|contact|ip|address|host|server|reach|at|on)[^\p{L}]{0,4}$").cast("int"),
        "word": F.when(word == "", 0).otherwise(1 + F.pmod(F.xxhash64(word), F.lit(WORDS - 1))).cast("int"),
    }


def _refuted(kind: str, s: Column, right: Column) -> Column:
    """Whether a candidate's plain form is shown to be no ``kind``."""
    digits = F.length(F.regexp_replace(s, "[^0-9]", ""))
    if kind == "email":
        return ~s.rlike(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$")
    if kind == "ip":
        return ~s.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return ~digits.between(14, 19) | ~_valid("card", s)
    date = s.rlike(r"^(?:[0-9]{4}[-. /][0-9]{1,2}[-. /][0-9]{1,2}|[0-9]{1,2}[-. /][0-9]{1,2}[-. /][0-9]{2,4}|[12][0-9]{3}[-\x20]+[12][0-9]{3})$")
    decimal = s.rlike(r"^[0-9]+\.[0-9]+$") | s.rlike(r"^[0-9]{1,3}(?:[.\x20][0-9]{3})+$")
    return ~digits.between(10, 15) | date | decimal | right.rlike(r"^[\p{L}%_=/]") | s.rlike(r"^[0-9]+$")


def _taught(own: Column, touched: Column, refuted: Column) -> Column:
    """1 for a candidate on a base span of its kind, 0 for one that is refuted or lies on another kind's span, else null."""
    return F.when(own, 1).when(touched | refuted, 0)


#: Digits that a candidate may have. Those of cards are a card's own, so that their number alone decides nothing.
DIGITS = {"card": (14, 19), "phone": (7, 24)}


def _candidates(docs: DataFrame) -> DataFrame:
    """A row for each candidate: row, kind, start, end, touched, label (null: none), fold and its features."""
    parts = []
    for kind in KINDS:
        found = docs.where(F.col("text").rlike(WIDER[kind])).select(
            "row", *[f"base_{k}" for k in KINDS], F.explode(_spans(F.col("text"), GENERATORS[kind], WIDER[kind])).alias("m")
        )
        if kind in DIGITS:
            found = found.where(F.length(F.regexp_replace("m.s", "[^0-9]", "")).between(*DIGITS[kind]))
        if kind == "ip":
            found = found.where(F.size(F.split(_plain(kind, F.col("m.s")), r"\.")) == 4)
        meets = lambda k: F.exists(f"base_{k}", lambda b: (b["start"] < F.col("m.end")) & (b["end"] > F.col("m.start")))
        touched = F.lit(False)
        for k in KINDS:
            touched = touched | meets(k)
        parts.append(
            found.select(
                "row", F.lit(kind).alias("kind"), "m.start", "m.end", meets(kind).alias("own"), touched.alias("touched"), _plain(kind, F.col("m.s")).alias("s"), "m.left", "m.right"
            ).withColumn("label", _taught(F.col("own"), F.col("touched"), _refuted(kind, F.col("s"), F.col("right"))))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("fold", F.pmod(F.xxhash64("row.text_hash"), F.lit(2)).cast("int"))
    # An address is known by its dots: those of emails are not shown to the trees.
    out = out.withColumns(_features(F.col("s"), F.col("left"), F.col("right"))).withColumn("dots", F.when(F.col("kind") == "email", 0).otherwise(F.col("dots")))
    return out.drop("s", "left", "right", "own")


class Trees:
    """Boosted regression trees on the logistic loss, over weighted rows of small integers."""

    def __init__(self):
        self.bias, self.trees = 0.0, []

    def fit(self, x: np.ndarray, yes: np.ndarray, all_: np.ndarray) -> Trees:
        share = (yes.sum() + 0.5) / (all_.sum() + 1.0)
        self.bias = math.log(share / (1 - share))
        z = np.full(len(x), self.bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(x, yes - all_ * p, all_ * p * (1 - p), np.arange(len(x)), DEPTH)
            self.trees.append(tree)
            z = z + self._leaves(tree, x)
        return self

    def _grow(self, x, g, h, rows, depth):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        for j in range(x.shape[1] if depth else 0):
            v = x[rows, j]
            of_g, of_h = np.bincount(v, weights=g[rows]).cumsum(), np.bincount(v, weights=h[rows]).cumsum()
            gain = of_g**2 / (of_h + 1) + (total_g - of_g) ** 2 / (total_h - of_h + 1) - total_g**2 / (total_h + 1)
            cut = int(np.argmax(gain[:-1])) if len(gain) > 1 else -1
            if cut >= 0 and gain[cut] > best[0]:
                best = (gain[cut], (j, cut, v <= cut))
        if best[1] is None:
            return float(RATE * total_g / (total_h + 1))
        j, cut, left = best[1]
        return (j, cut, self._grow(x, g, h, rows[left], depth - 1), self._grow(x, g, h, rows[~left], depth - 1))

    def _leaves(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        return np.where(x[:, tree[0]] <= tree[1], self._leaves(tree[2], x), self._leaves(tree[3], x))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sum((self._leaves(t, x) for t in self.trees), np.full(len(x), self.bias))  # in the order of the column's sum

    def column(self) -> Column:
        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            return F.when(F.col(FEATURES[tree[0]]) <= tree[1], of(tree[2])).otherwise(of(tree[3]))

        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + of(tree)
        return total


def _threshold(z: np.ndarray, yes: np.ndarray, n: np.ndarray, chance: float = 1.0) -> float | None:
    """The least score at which the share of true ones among those at or above it, with one failure more, is PRECISION.

    Of the others only a share ``chance`` would come before the model, as the rest fail the check.
    """
    order = np.argsort(-z, kind="stable")
    precision = np.cumsum(yes[order]) / (np.cumsum(yes[order] + chance * (n - yes)[order]) + 1.0)
    last = np.append(z[order][1:] != z[order][:-1], True)  # equal scores stand together
    good = np.flatnonzero((precision >= PRECISION) & last)
    return float(z[order][good[-1]]) if len(good) else None


def _models(candidates: DataFrame) -> dict[str, tuple[Trees, float]]:
    """A model and a threshold for each kind whose two folds both have true and other candidates."""
    table = (
        candidates.where("label is not null")
        .groupBy("kind", "fold", *FEATURES)
        .agg(F.count("*").alias("n"), F.sum("label").alias("yes"))
        .collect()
    )
    out = {}
    for kind in KINDS:
        rows = sorted((r["fold"], *(r[f] for f in FEATURES), r["n"], r["yes"]) for r in table if r["kind"] == kind)
        if not rows:
            continue
        t = np.array(rows, dtype=np.int64)
        fits, tests = t[t[:, 0] == 0], t[t[:, 0] == 1]
        if any(len(part) == 0 or not 0 < part[:, -1].sum() < part[:, -2].sum() for part in (fits, tests)):
            continue
        model = Trees().fit(fits[:, 1:-2], fits[:, -1].astype(float), fits[:, -2].astype(float))
        least = _threshold(model.scores(tests[:, 1:-2]), tests[:, -1].astype(float), tests[:, -2].astype(float), CHANCE.get(kind, 1.0))
        if least is not None:
            out[kind] = (model, least)
    return out


def _joined(spans: Column) -> Column:
    rank = F.create_map(*[F.lit(v) for pair in ((k, i) for i, k in enumerate(KINDS)) for v in pair])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("r"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and added (spans that the model adds) for each row.

    The counts and the hash are of the base spans. Null and empty texts have
    none. Rows keep their repeats; rows with equal ids and texts get equal
    spans. An empty table gives an empty result.
    """
    space = Workspace(docs.sparkSession, "pii")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slim = slim.withColumn("row", F.struct("doc_id", F.xxhash64("text").alias("text_hash")))
    found = base_spans(slim, "text")
    marks = space.keep(found.select("row", *[F.transform(f"base_{k}", _named(k)).alias(f"base_{k}") for k in KINDS]), "base")
    candidates = space.keep(_candidates(found), "candidates")
    models = _models(candidates)
    base = F.concat(*[F.col(f"base_{k}") for k in KINDS])
    if models:
        chosen = None
        for kind, (model, least) in models.items():
            part = candidates.where((F.col("kind") == kind) & ~F.col("touched") & F.col("label").isNull()).where(model.column() >= least)
            part = part.select("row", F.struct(F.lit(kind).alias("kind"), "start", "end").alias("span"))
            chosen = part if chosen is None else chosen.unionByName(part)
        added = chosen.groupBy("row").agg(F.collect_set("span").alias("more"))
        marks = marks.join(added, "row", "left")
    else:
        marks = marks.withColumn("more", F.lit(None).cast("array<struct<kind: string, start: int, end: int>>"))
    more = F.aggregate(
        F.sort_array(F.transform(F.coalesce("more", F.expr("cast(array() as array<struct<kind: string, start: int, end: int>>)")), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind")))),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<kind: string, start: int, end: int>>)").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct((-s["back"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["back"]).alias("end")))).alias("out"))
        ),
        lambda acc: acc["out"],
    )
    return marks.withColumn("added", more).select(
        F.col("row.doc_id").alias("doc_id"),
        *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, F.col("added"))).alias("spans"),
        _joined(F.col("added")).alias("added"),
    )
