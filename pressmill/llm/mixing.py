"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source gets a target in words. Its documents are all taken ``whole`` =
floor(target / size of the source) times. The rest of the target is a sample of
unequal probabilities: a document's inclusion probability p is proportional to
its size, up to 1, such that the expected words are that rest; documents with
p = 1 are certain. Documents are ranked by their random odds over the inclusion
odds, (u / (1 - u)) / (p / (1 - p)), and the least ranks are taken once more
until the rest is met as nearly as whole documents allow, so the sample has a
fixed size in words and reruns agree (u is a hash of the id and a seed).

The rate of p comes from a table of the distinct sizes of each source. The cut
is found from sums over HISTOGRAM ranges of the rank for each source; only the
documents of the one range that holds the cut are put in order, equal ones as
one row, so no task sorts a source. A row's copies then follow from its own
values and a table with one row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, n_words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2.0
SEED = "mix-1"
HISTOGRAM = 4096


def uniform(id_col: str, text_col: str, seed: str = SEED) -> Column:
    """A number in (0, 1) from the id, or from the text where the id is null; the same at every run and in other SQL engines."""
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target: ``share`` of all words, dealt by weight, at most ``most`` times a source.

    Weights repeat over the sources in code point order, null last. What a
    source can't take goes to the others by weight, until none is above its
    most; that is one level of filling, found from running sums over the
    sources in order of most / weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    rows = by_source.withColumn("weight", F.get(kinds, (F.row_number().over(order) - 1) % len(weights)))
    rows = rows.withColumn("most", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = rows.withColumns(
        {
            "turn": F.row_number().over(fill),
            "level": (
                F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
            )
            / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
        }
    )
    free = F.col("level") * F.col("weight") < F.col("most")
    rows = rows.withColumn("first", F.min(F.when(free, F.struct("turn", "level"))).over(whole))
    target = F.when(
        F.col("first").isNull() | (F.col("turn") < F.col("first.turn")), F.col("most")
    ).otherwise(F.col("first.level") * F.col("weight"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def inclusion(rate: Column, size: Column) -> Column:
    """The probability of one copy more: proportional to size, up to 1; null where the source has no rate."""
    return F.when(rate.isNotNull(), F.least(F.lit(1.0), rate * size))


def pareto_rank(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds; 0 for certain documents, null where p is 0 or null, which are never taken."""
    return F.when(p >= 1, 0.0).when(p > 0, (u / (1 - u)) / (p / (1 - p)))


def _range(rank: Column) -> Column:
    """The number of the rank's range; ranks near 1, where cuts lie, are spread most."""
    return F.floor(rank / (1 + rank) * HISTOGRAM)


def sampling_rates(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """of, rate: for each source with a quota, the rate at which the sum of size * least(1, rate * size) is the quota.

    The larger sizes are certain. With all sizes above a level certain, the
    rate is what is left of the quota over the sum of squares from that level
    down; the greatest level which that rate leaves uncertain is the right one.
    Only the distinct sizes of a source are put in order.
    """
    exact = "decimal(38, 0)"
    levels = sized.where("size > 0").groupBy(F.col("source").alias("of"), "size").agg(F.count("*").cast(exact).alias("n"))
    above = Window.partitionBy("of").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("of").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    words, squares = F.col("n") * F.col("size"), (F.col("n") * F.col("size")).cast(exact) * F.col("size")
    levels = levels.withColumns(
        {
            "certain": F.coalesce(F.sum(words.cast(exact)).over(above), F.lit(0)).cast("double"),
            "squares": F.sum(squares.cast(exact)).over(below).cast("double"),
        }
    )
    quotas = plan.where("quota > 0").select("source", "quota")
    rates = levels.join(quotas, F.col("of").eqNullSafe(F.col("source"))).withColumn(
        "rate", (F.col("quota") - F.col("certain")) / F.col("squares")
    )
    return rates.where("rate * size < 1").groupBy("of").agg(F.max(F.struct("size", "rate"))["rate"].alias("rate"))


def mix_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source: whole copies, the rate of p, and where the ranks are cut (range, and last (rank, id, size) taken in it)."""
    plan = targets.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    )
    plan = plan.withColumn(
        "quota", F.when(F.col("source_size") > 0, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(F.lit(0.0))
    )
    rates = sampling_rates(sized, plan)
    plan = plan.join(rates, plan["source"].eqNullSafe(rates["of"]), "left").drop("of")
    ranked = sized.withColumnRenamed("source", "of").join(
        plan.where("rate is not null").select("source", "rate", "quota"), F.col("of").eqNullSafe(F.col("source"))
    )
    ranked = ranked.withColumn("rank", pareto_rank(F.col("u"), inclusion(F.col("rate"), F.col("size")))).where("rank is not null")
    ranked = ranked.withColumn("part", _range(F.col("rank")))
    sums = ranked.groupBy("of", "part", "quota").agg(F.sum("size").alias("part_size"))
    sums = sums.withColumn("upto", F.sum("part_size").over(Window.partitionBy("of").orderBy("part")))
    cut = (
        sums.where("upto > quota")
        .groupBy("of")
        .agg(F.min(F.struct("part", (F.col("upto") - F.col("part_size")).alias("below"), "quota")).alias("cut"))
        .select(F.col("of").alias("cut_of"), F.col("cut.part").alias("cut_part"), F.col("cut.below").alias("below"), F.col("cut.quota").alias("need"))
    )
    inside = ranked.join(cut, ranked["of"].eqNullSafe(cut["cut_of"]) & (ranked["part"] == cut["cut_part"]))
    inside = inside.groupBy("cut_of", "below", "need", "rank", "doc_id", "size").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("cut_of").orderBy("rank", "doc_id", "size")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("upto", F.col("below") + F.coalesce(F.sum("words").over(before), F.lit(0)) + F.col("words") / 2)
    inside = inside.withColumn("over", F.max(F.col("upto") > F.col("need")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = inside.where("not over").groupBy(F.col("cut_of").alias("last_of")).agg(F.max(F.struct("rank", "doc_id", "size")).alias("last"))
    cut = cut.join(last, cut["cut_of"].eqNullSafe(last["last_of"]), "left").select("cut_of", "cut_part", "last")
    return plan.join(cut, plan["source"].eqNullSafe(cut["cut_of"]), "left").select(
        "source", "source_size", "target", "whole", "rate", "cut_part", "last"
    )


def _with_copies(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` with its source's row of the plan, rank and copies."""
    joined = sized.join(plan.withColumnRenamed("source", "of"), sized["source"].eqNullSafe(F.col("of")))
    joined = joined.withColumn("rank", pareto_rank(F.col("u"), inclusion(F.col("rate"), F.col("size"))))
    part = _range(F.col("rank"))
    more = (
        F.when(F.col("rank").isNull(), False)
        .when(F.col("cut_part").isNull() | (part < F.col("cut_part")), True)
        .when(part > F.col("cut_part"), False)
        .otherwise(F.col("last").isNotNull() & (F.struct("rank", "doc_id", "size") <= F.col("last")))
    )
    return joined.withColumn("copies", (F.col("whole") + more.cast("int")).cast("int"))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    return docs.select(
        *more,
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        n_words(text_col).alias("size"),
        uniform(id_col, text_col).alias("u"),
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken and rank for each row of ``docs``.

    A null or blank text has size 0, a null rank, the whole copies of its
    source and adds no words. Null is a source of its own. Rows that repeat an
    id share one random number; rows equal in id and size (null ids: in text)
    are taken alike. An empty table gives an empty result.
    """
    space = Workspace(docs.sparkSession, "mix")
    sized = space.keep(_sizes(docs, id_col, text_col, source_col), "sizes")
    plan = space.keep(mix_plan(sized, source_targets(sized, **options)), "plan")
    return _with_copies(sized, plan).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "rank"
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` with the columns of ``docs``, each as often as ``mix_sources`` takes it; an empty table stays empty."""
    space = Workspace(docs.sparkSession, "mix")
    sized = space.keep(_sizes(docs, id_col, text_col, source_col), "sizes")
    plan = space.keep(mix_plan(sized, source_targets(sized, **options)), "plan")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    taken = _with_copies(_sizes(docs, id_col, text_col, source_col, row), plan).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight
  FROM sized GROUP BY source),
lvl AS (
  SELECT *, 2.0::DOUBLE * source_size AS most,
         row_number() OVER f AS turn,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0))
           / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM src
  WINDOW f AS (ORDER BY 2.0::DOUBLE * source_size / weight, source IS NULL, source),
         b AS (ORDER BY 2.0::DOUBLE * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT min(turn) AS turn, arg_min(level, turn) AS level FROM lvl WHERE level * weight < most),
tgt AS (
  SELECT source, source_size,
         CASE WHEN lev.turn IS NULL OR lvl.turn < lev.turn THEN most ELSE lev.level * weight END AS target
  FROM lvl, lev),
pl AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN target - floor(target / source_size) * source_size ELSE 0 END AS quota
  FROM tgt),
levels AS (
  SELECT s.source, s.size, p.quota,
         p.quota - coalesce(sum(sum(s.size)) OVER (PARTITION BY s.source ORDER BY s.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS left_over,
         (sum(sum(s.size * s.size)) OVER (PARTITION BY s.source ORDER BY s.size))::DOUBLE AS squares
  FROM sized s JOIN pl p ON s.source IS NOT DISTINCT FROM p.source
  WHERE s.size > 0 AND p.quota > 0 GROUP BY s.source, s.size, p.quota),
rates AS (SELECT source, arg_max(left_over / squares, size) AS rate FROM levels WHERE left_over / squares * size < 1 GROUP BY source),
odds AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.quota, CASE WHEN r.rate IS NOT NULL THEN least(1.0::DOUBLE, r.rate * s.size) END AS p
  FROM sized s JOIN pl p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
ranked AS (
  SELECT *, CASE WHEN p >= 1 THEN 0.0::DOUBLE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM odds),
alike AS (SELECT source, quota, rank, doc_id, size, sum(size) AS words FROM ranked WHERE rank IS NOT NULL GROUP BY ALL),
met AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + words / 2.0 > quota AS fails
  FROM alike),
cut AS (
  SELECT *, max(fails::INTEGER) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS over FROM met)
SELECT r.doc_id, r.size, r.source_size, r.target, (r.size * (r.whole + coalesce(1 - c.over, 0)))::BIGINT AS taken
FROM ranked r LEFT JOIN cut c ON r.source IS NOT DISTINCT FROM c.source AND r.rank = c.rank AND r.doc_id IS NOT DISTINCT FROM c.doc_id AND r.size = c.size
"""
