"""Quality rules: text statistics and robust multivariate outliers, in DataFrame operations only.

Each text gives counts; two base rules fail it outright. The others are judged
by a vector of transformed statistics for each language and source: location
and scatter are minimum-covariance-determinant estimates. Every group has
STARTS starts, one from coordinatewise medians and deviations and the others
from small random sets of its texts; each takes concentration steps (estimate,
keep the share CORE of least distance, repeat), the start of least determinant
stays, and each group's steps go on until its determinant falls no further. The
scatter is scaled to be right for normal texts, and a text is rejected when its
squared Mahalanobis distance exceeds CUTOFF. Sources with fewer than LEAST
texts in a language are judged together; where those are fewer too, only the
base rules hold. Every step is a sum over all texts of a group; one number a
step comes to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SEPARATORS, Workspace

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
LEAST = 60
CORE = 0.75
STARTS, FIRST_STEPS = 4, 2
#: A step that lowers a group's log determinant by less is its last; determinants have a floor, so the steps end.
SETTLED = 1e-6
#: Texts of a random start, about: two for each that the scatter of so many statistics needs.
DRAWN = 12
#: Parts over which a group's texts are dealt in joins, so that no task gets a whole group.
SALT = 16
#: The 0.999 quantile of chi-square with a degree of freedom for each statistic.
CUTOFF = 20.515
#: CORE / P(chi-square with 7 degrees <= the CORE quantile with 5): covariances of the core are too small by it.
CONSISTENCY = 1.412
#: Standard deviations whose squares are added to the scatter's diagonal, as in the regularised estimate, so that a
#: statistic which most texts of a group share exactly doesn't reject the rest and no determinant is 0. Each is small
#: enough that its statistic alone can exceed CUTOFF.
FLOORS = {"f_length": 0.5, "f_word": 0.3, "f_symbols": 0.03, "f_repeats": 0.12, "f_lines": 0.12}
#: Words and lines without repeats that each text is taken to have besides its own, so that one repeated line of a short text weighs no more than in a typical one.
MORE_WORDS, MORE_LINES = 100, 7
NAMES = list(FLOORS)


def _compact(array: str) -> Column:
    return F.filter(F.split(F.col(array), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed added.

    Null counts as the empty text. Repeated windows are found by sorting a
    text's window hashes, each with its position, and comparing neighbours, so
    a text of n words costs n log n and stays in its row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__text", text).withColumn("__words", _compact("__text"))
    out = out.withColumn("n_words", F.size("__words").cast("long"))
    out = out.withColumn(
        "__windows",
        F.expr(
            "case when n_words >= 3 then sort_array(transform(sequence(0, cast(n_words - 3 as int)), "
            "i -> struct(xxhash64(__words[i], __words[i + 1], __words[i + 2]) as h, i as i))) "
            "else cast(array() as array<struct<h: bigint, i: int>>) end"
        ),
    )
    out = out.withColumn(
        "__twice",
        F.expr(
            "case when size(__windows) > 1 then sort_array(transform(filter(sequence(0, size(__windows) - 1), "
            "k -> __windows[k].h <=> get(__windows, k - 1).h or __windows[k].h <=> get(__windows, k + 1).h), "
            "k -> __windows[k].i)) else cast(array() as array<int>) end"
        ),
    )
    covered = F.expr(
        "case when size(__twice) > 0 then aggregate(sequence(0, size(__twice) - 1), 0L, "
        "(n, k) -> n + least(3, coalesce(get(__twice, k + 1) - __twice[k], 3))) else 0L end"
    )
    lines = F.expr("filter(split(__text, '\\n', -1), l -> translate(l, ' \\t\\u000B\\f\\r', '') != '')")
    out = out.withColumn("__lines", lines)
    out = out.withColumns(
        {
            "word_chars": F.length(F.translate("__text", SEPARATORS, "")).cast("long"),
            "n_symbols": (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
        }
    )
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.drop("__text", "__words", "__windows", "__twice", "__lines")


def _vector() -> dict[str, Column]:
    """Transforms that bring the counts near to a symmetric scale."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "f_length": F.log1p(F.col("n_words").cast("double")),
        "f_word": F.col("word_chars") / words,
        "f_symbols": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "f_repeats": F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + MORE_WORDS)),
        "f_lines": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + MORE_LINES)),
    }


def _factor(params: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_i_j of the regularised covariances v_i_j, and logdet, the logarithm of their determinant."""
    for i in range(len(NAMES)):
        for j in range(i + 1):
            rest = F.col(f"v_{i}_{j}") + (FLOORS[NAMES[i]] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            if i == j:
                rest = F.sqrt(F.greatest(rest, F.lit(0.25 * FLOORS[NAMES[i]] ** 2)))  # no less but for rounding
            else:
                rest = rest / F.col(f"l_{j}_{j}")
            params = params.withColumn(f"l_{i}_{j}", rest)
    return params.withColumn("logdet", sum((2 * F.log(F.col(f"l_{i}_{i}")) for i in range(len(NAMES))), F.lit(0.0)))


def _distance(joined: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    total = F.lit(0.0)
    for i, name in enumerate(NAMES):
        z = F.col(name) - F.col(f"m_{i}")
        for k in range(i):
            z = z - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        joined = joined.withColumn(f"z_{i}", z / F.col(f"l_{i}_{i}"))
        total = total + F.col(f"z_{i}") * F.col(f"z_{i}")
    return joined.withColumn("d2", total)


def _moments(core: DataFrame, scale: float = CONSISTENCY) -> DataFrame:
    sums = [F.count("*").alias("n")]
    for i, a in enumerate(NAMES):
        sums.append(F.avg(a).alias(f"m_{i}"))
        sums += [(scale * F.covar_pop(a, NAMES[j])).alias(f"v_{i}_{j}") for j in range(i + 1)]
    return core.groupBy("group", "start").agg(*sums)


def _near(vectors: DataFrame, params: DataFrame) -> DataFrame:
    """``vectors`` with the parameters of their group, once for each start of it."""
    dealt = params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return vectors.join(dealt, ["group", "salt"])


def _starts(vectors: DataFrame) -> DataFrame:
    """Parameters of each (group, start): start 0 from medians and deviations, the others from about DRAWN random texts."""
    medians = vectors.groupBy("group").agg(
        F.count("*").alias("n"), *[F.percentile_approx(x, 0.5, 1000).alias(f"m_{i}") for i, x in enumerate(NAMES)]
    )
    off = _near(vectors, medians).groupBy("group").agg(
        *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{i}")), 0.5, 1000).alias(f"mad_{i}") for i, x in enumerate(NAMES)]
    )
    middle = medians.join(off, "group").select(
        "group",
        F.lit(0).alias("start"),
        "n",
        *[
            F.col(f"m_{i}") if j < 0 else (F.pow(1.4826 * F.col(f"mad_{i}"), 2) if i == j else F.lit(0.0)).alias(f"v_{i}_{j}")
            for i in range(len(NAMES))
            for j in range(-1, i + 1)
        ],
    )
    drawn = _near(vectors, medians.select("group", "n")).withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(STARTS - 1))))
    drawn = drawn.where(F.pmod(F.xxhash64("pick", "start"), F.lit(1 << 40)) < F.lit(float(DRAWN << 40)) / F.col("n"))
    return _factor(middle.unionByName(_moments(drawn.drop("n"), 1.0)))


def _step(vectors: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step of each start."""
    edge = _distance(_near(vectors, params)).groupBy("group", "start").agg(F.percentile_approx("d2", CORE, 10_000).alias("edge"))
    core = _distance(_near(vectors, params.join(edge, ["group", "start"]))).where("d2 <= edge").select("group", "start", *NAMES)
    return _factor(_moments(core))


def robust_parameters(vectors: DataFrame, space: Workspace) -> DataFrame:
    """Location m_i, Cholesky factor l_i_j and logdet of the least determinant found, for each group of (group, salt, pick, statistics)."""
    params = space.keep(_starts(vectors), "starts")
    for _ in range(FIRST_STEPS):
        params = space.keep(_step(vectors, params), "estimate")
    least = params.groupBy("group").agg(F.min(F.struct("logdet", "start"))["start"].alias("start"))
    params = space.keep(params.join(least, ["group", "start"]), "least")
    settled = []
    while not params.isEmpty():
        fell = F.coalesce(F.col("was") - F.col("logdet") >= SETTLED, F.lit(False))
        after = _step(vectors, params).join(params.select("group", F.col("logdet").alias("was")), "group")
        after = space.keep(after.withColumn("fell", fell).drop("was"), "estimate")
        settled.append(after.where("not fell").drop("fell"))
        params = after.where("fell").drop("fell")
    return reduce(DataFrame.unionByName, settled or [params]).drop("start", "n")


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The statistics of each row, its squared distance d2 (null where no group is large enough) and kept.

    Null and empty texts have no words and fail the base rule. A null language
    or source is a value like any other. Equal rows get equal verdicts. An
    empty table gives an empty result.
    """
    space = Workspace(docs.sparkSession, "quality")
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")
    )
    stats = text_statistics(slim).drop("text")
    stats = stats.withColumn("of", F.to_json(F.struct("lang", "source"))).withColumn("rest", F.to_json(F.struct("lang")))
    stats = space.keep(stats.withColumns(_vector()), "statistics")
    judged = stats.where("not base_failed")
    n_of = judged.groupBy("of", "rest").agg(F.count("*").alias("n"))
    group = n_of.select("of", F.when(F.col("n") >= LEAST, F.col("of")).otherwise(F.concat(F.lit("rest "), "rest")).alias("group"), "n")
    size = group.groupBy("group").agg(F.sum("n").alias("group_n"))
    group = space.keep(group.join(size, "group").where(F.col("group_n") >= LEAST).select("of", "group"), "groups")
    salt = F.pmod("pick", F.lit(SALT)).cast("int").alias("salt")
    stats = stats.withColumn("pick", F.xxhash64("doc_id", *NAMES)).withColumn("salt", salt)
    dealt = group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    grouped = stats.join(dealt, ["of", "salt"], "left")
    vectors = space.keep(
        grouped.where("not base_failed and group is not null").select("group", "salt", "pick", *NAMES), "vectors"
    )
    params = robust_parameters(vectors, space).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    out = _distance(grouped.join(params, ["group", "salt"], "left"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= CUTOFF)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2"
    )
