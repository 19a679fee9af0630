"""Queries on scores, pages, search, counts, the brief and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cluster, dedupe, feed, local, rank
from ..plans import dims, feedplan
from .tables import AS_OF, PLACES_SQL, STORIES_SQL, as_of, places, stories, table

CITY, PROVINCE, HUB = "NATION_7", "ASIA", "NATION_12"
CITY_OF = {f"NATION_{k}": p for k in range(25) for p in [("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")[k % 5]]}
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    parts = rank.recency(F.col("published_ts"), as_of()) + rank.coverage(F.col("trending")) + rank.diversity(F.col("n_sources"))
    return stories(spark, d).withColumn("rank_e4", rank.scaled(parts))


_SCORED_SQL = (
    "WITH "
    + STORIES_SQL
    + f""",
g AS (SELECT *, greatest(0.0::DOUBLE, date_diff('second', published_ts, TIMESTAMP '{AS_OF}') / 3600.0::DOUBLE) AS age FROM s),
q AS (SELECT *, floor((44.0::DOUBLE * exp(-age / 30.0::DOUBLE) + CASE WHEN age <= 2.0 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END
        + least(greatest(1, trending), 14) * 3.2::DOUBLE + least(greatest(1, n_sources), 9) * 4.5::DOUBLE) * 10000.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS rank_e4
      FROM g)"""
)


def feed_page(spark: SparkSession, d: str) -> DataFrame:
    """Page 2 of the ranked feed."""
    page = feed.feed_slice(_scored(spark, d), 5, 100, "rank_e4")
    return page.select("id", "trending", "n_sources", "rank_e4")


def feed_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Q12, O15."""
    return feed.feed_top(table(spark, d, "orders"), 10, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


def feed_look_ahead(spark: SparkSession, d: str) -> DataFrame:
    """The two rows after a cursor."""
    return feed.look_ahead(table(spark, d, "orders"), 4, 2, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


def feed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Q2, Q3, Q4, Q6: one pass."""
    rows = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "P", " Pending ").when(F.col("o_orderstatus") == "O", "").otherwise("ready"))
    return feed.counts(rows, "o_orderkey", "status", "o_orderdate")


def scope_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows, newest row and staleness of one scope."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    scope = o.join(c.where("c_nationkey = 7"), o["o_custkey"] == c["c_custkey"])
    age = F.timestamp_diff("SECOND", F.max("o_orderdate"), as_of())
    return scope.agg(
        F.count("*").alias("n"), F.max("o_orderdate").alias("newest"), (F.max("o_orderdate").isNull() | (age >= feed.FRESH_SECONDS)).alias("stale")
    )


def rank_recency(spark: SparkSession, d: str) -> DataFrame:
    """Recency where hours matter, also for events later than the time asked for."""
    when = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    e = table(spark, d, "events")
    return e.select("event_id", rank.scaled(rank.recency(F.col("ts"), when), 6).alias("recency_e6"))


def rank_category(spark: SparkSession, d: str) -> DataFrame:
    """R1e, R1d: category boosts by substring and the picture bonus."""
    e = table(spark, d, "events")
    label = F.concat_ws(" ", F.element_at(F.array(*[F.lit(w) for w, _ in rank.CATEGORY]), (F.col("event_id") % 9 + 1).cast("int")), "event_type")
    url = F.when(F.col("event_id") % 3 == 0, " ").otherwise("http://x")
    return e.select("event_id", rank.category(label).alias("category"), rank.image(url).alias("image"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    picture = F.when(F.col("id") % 3 == 0, F.lit(" ")).when(F.col("id") % 3 == 1, F.lit("http://i/x.jpg"))
    topic = F.get(F.array(*[F.lit(t) for t in ("Politics", "Local Sports", "world", "Canada business", "Other")]), (F.col("id") % 5).cast("int"))
    parts = rank.rank_parts(F.col("published_ts"), F.col("trending"), F.col("n_sources"), picture, topic, as_of())
    return stories(spark, d).withColumn("parts", parts)


def rank_strongest(spark: SparkSession, d: str) -> DataFrame:
    """The strongest of all five parts of the score, for each story."""
    return _parts(spark, d).select("id", rank.strongest_part(F.col("parts")).alias("strongest"))


def rank_rounded(spark: SparkSession, d: str) -> DataFrame:
    """The five parts to two places and their sum."""
    part = lambda n: rank.scaled(F.col(f"parts.{n}"), 2).alias(f"{n}_e2")
    return _parts(spark, d).select("id", *[part(n) for n in ("recency", "coverage", "diversity", "image", "category")], rank.scaled(rank.rank_score(F.col("parts")), 2).alias("score_e2"))


_PARTS_SQL = f"""r AS (SELECT id, greatest(0.0::DOUBLE, date_diff('second', published_ts, TIMESTAMP '{AS_OF}') / 3600.0::DOUBLE) AS age, trending, n_sources FROM s),
k AS (SELECT id, round_even(44.0::DOUBLE * exp(-age / 30.0::DOUBLE) + CASE WHEN age <= 2.0 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END, 2) AS recency,
        round_even(least(greatest(1, trending), 14) * 3.2::DOUBLE, 2) AS coverage, round_even(least(greatest(1, n_sources), 9) * 4.5::DOUBLE, 2) AS diversity,
        CASE WHEN id % 3 = 1 THEN 11.0::DOUBLE ELSE 0.0::DOUBLE END AS image, [18.0::DOUBLE, 9.0::DOUBLE, 4.0::DOUBLE, 14.0::DOUBLE, 0.0::DOUBLE][1 + id % 5] AS category FROM r)"""


def search_page(spark: SparkSession, d: str) -> DataFrame:
    """Any of several columns holds the term; a percent sign is only a percent sign."""
    o = table(spark, d, "orders")
    hit = o.where(dedupe.search_any("ig", "o_orderpriority", "o_orderstatus") & ~dedupe.search_any("%", "o_orderpriority"))
    return feed.feed_slice(hit, 20, 30, "o_totalprice", "o_orderkey").select("o_orderkey", "o_orderpriority", "o_totalprice")


def search_count(spark: SparkSession, d: str) -> DataFrame:
    """Q9."""
    docs = table(spark, d, "documents")
    return docs.where(dedupe.search_any("Token", "text", "lang", "source")).agg(F.count("*").alias("n"))


def client_filter(spark: SparkSession, d: str) -> DataFrame:
    """Free text over joined columns, with an outlet that a story's list decides, and its source only where there is no list."""
    p = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit("").alias("summary"), F.lit("red").alias("topic"), F.col("p_brand").alias("category"),
        F.lit("").alias("region"), F.col("p_type").alias("source"), F.when(F.col("p_size") % 3 > 0, F.array("p_brand", F.concat(F.lit(" "), "p_name"))).alias("sources"),
    )
    return feed.client_filter(p, "red", "Ed", "SMALL").unionByName(feed.client_filter(p, None, "red", "Brand#11")).select("id", "title")


def facets(spark: SparkSession, d: str) -> DataFrame:
    """A22."""
    p = table(spark, d, "part").select(F.col("p_type").alias("topic"), F.col("p_brand").alias("source"), F.when(F.col("p_size") > 25, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>")).alias("sources"))
    return feed.facets(p)


def daily_brief(spark: SparkSession, d: str) -> DataFrame:
    """The best five of the first eighty, today's first."""
    news = _scored(spark, d).select(
        "id", (F.col("rank_e4") / 10000.0).alias("rank_score"), "published_ts", F.concat(F.lit("http://n/"), (F.col("id") % 50).cast("string")).alias("link"),
        F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("source"), F.lit("").alias("published_text"),
    )
    best = feed.daily_brief(news, F.lit("1998-08-01 12:00:00").cast("timestamp_ntz"))
    return best.select("id", rank.scaled(F.col("brief_score")).alias("brief_e4"))


def reading_time(spark: SparkSession, d: str) -> DataFrame:
    """Words of a conversation at 200 a minute, from 20 to 180 seconds."""
    c = table(spark, d, "conversations").where("text is not null")
    words = F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != ""))
    return c.groupBy("conv_id").agg(F.sum(words).alias("n_words")).select("conv_id", "n_words", text.read_seconds(F.col("n_words")).alias("seconds"))


def _tier(p: DataFrame):
    return local.local_tier(*[F.col(c) for c in ("region", "coverage_level", "coverage_city", "coverage_province")], CITY, PROVINCE, HUB, CITY_OF, REGIONS)


def local_tier(spark: SparkSession, d: str) -> DataFrame:
    """The tier of each article for one reader."""
    p = places(spark, d).where(~local.is_excluded(F.col("region"), F.col("coverage_level")))
    return p.select("id", _tier(p).alias("tier"))


def local_feed(spark: SparkSession, d: str) -> DataFrame:
    """Tiers 0 to 3, best first."""
    p = places(spark, d)
    boost = rank.location_boost(F.col("region"), CITY, PROVINCE, city_province=CITY_OF, provinces=REGIONS)
    outlet = local.source_boost(F.col("source"), F.col("region"), F.col("coverage_city"), CITY, HUB, ("BUILD",), ("MACHIN",))
    ordered = local.local_order(p, _tier(p), F.col("rank_score") + boost["boost"] + outlet)
    return ordered.select("id", "tier", rank.scaled(F.col("local_score"), 2).alias("score_e2"), boost["reason"].alias("reason"))


def tier_counts(spark: SparkSession, d: str) -> DataFrame:
    """A16."""
    p = places(spark, d)
    return local.tier_counts(p.withColumn("tier", _tier(p)))


def location_mix(spark: SparkSession, d: str) -> DataFrame:
    """Articles by kind of place."""
    p = places(spark, d).select(rank.location_boost(F.col("region"), CITY, PROVINCE, city_province=CITY_OF, provinces=REGIONS)["reason"].alias("reason"))
    return p.groupBy("reason").agg(F.count("*").alias("n"))


_TIER_SQL = f"""
t AS (SELECT p.*, CASE WHEN region IN {REGIONS!r} THEN region ELSE (SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = p.region) END AS home,
             region LIKE 'NATION%' AS is_city, region IN {REGIONS!r} AS is_prov FROM p),
u AS (SELECT *, CASE
  WHEN is_prov AND lower(region) <> '{PROVINCE.lower()}' THEN 4
  WHEN home IS NOT NULL AND lower(home) <> '{PROVINCE.lower()}' THEN 4
  WHEN is_city AND lower(region) <> '{CITY.lower()}' AND lower(region) <> '{HUB.lower()}' THEN 4
  WHEN lower(region) = '{CITY.lower()}' THEN 0
  WHEN coverage_level IN ('city', 'civic') AND lower(coverage_city) = '{CITY.lower()}' THEN 0
  WHEN coverage_level IN ('city', 'civic') AND coverage_city <> '' THEN CASE WHEN lower(coverage_city) = '{HUB.lower()}' THEN 1 ELSE 4 END
  WHEN lower(region) = '{HUB.lower()}' THEN 1
  WHEN coverage_level = 'national' THEN CASE WHEN region IN ('Canada', '', 'Other') THEN 3 WHEN is_city OR is_prov THEN 4 ELSE 3 END
  WHEN coverage_level = 'province' AND lower(coverage_province) = '{PROVINCE.lower()}' THEN 2
  WHEN lower(region) = '{PROVINCE.lower()}' THEN 2
  WHEN region = '' THEN 4
  WHEN lower(home) = '{PROVINCE.lower()}' THEN 2
  WHEN region = 'Canada' THEN 3 ELSE 4 END AS tier FROM t)"""
_REASON_SQL = f"""CASE WHEN trim(region) = '' THEN 'empty_region' WHEN lower(region) = '{CITY.lower()}' THEN 'city_exact' WHEN lower(region) = '{PROVINCE.lower()}' THEN 'province_exact'
  WHEN lower(home) = '{PROVINCE.lower()}' THEN 'province_via_city' WHEN region = 'Canada' THEN 'national' ELSE 'baseline' END"""
_BOOST_SQL = f"""CASE {_REASON_SQL} WHEN 'city_exact' THEN 92.0::DOUBLE WHEN 'province_exact' THEN 50.0::DOUBLE WHEN 'province_via_city' THEN 50.0::DOUBLE WHEN 'national' THEN 24.0::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN lower(coverage_city) IN ('{CITY.lower()}', '{HUB.lower()}') OR lower(region) = '{HUB.lower()}' OR source LIKE '%BUILD%' OR source LIKE '%MACHIN%' THEN 38.0::DOUBLE ELSE 0.0::DOUBLE END"""


def feed_plan_sources(spark: SparkSession, d: str) -> DataFrame:
    """The feeds of a suburb's reader, with tiers."""
    return feedplan.scoped_entries(dims.sources(spark), "Mississauga", "Ontario").select("registry_key", "tier", "priority", "feed_url")


def registry_stats(spark: SparkSession, d: str) -> DataFrame:
    """A18, P14."""
    return feedplan.registry_stats(dims.sources(spark))


def registry_groups(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the active sources by level."""
    return dims.sources(spark).where("active").groupBy("coverage_level").agg(F.array_join(F.sort_array(F.collect_list("registry_key")), ",").alias("registry_keys"))


def city_suggest(spark: SparkSession, d: str) -> DataFrame:
    """Nations as cities, regions as provinces."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    c = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        F.col("n_name").alias("city"), F.col("r_name").alias("province"), F.substring("r_name", 1, 2).alias("province_code"), F.col("n_nationkey").alias("population_rank")
    )
    return feed.suggest(c, "AS").select("city", "province", rank.scaled(F.col("score"), 3).alias("score_e3"))


def cluster_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as reports of one story."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    level = F.element_at(F.array(*[F.lit(x) for x in ("national", "province", "city", "")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    members = o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("pos"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.concat(F.lit("http://o/"), (F.col("o_orderkey") % 7).cast("string")).alias("link"), F.col("o_orderpriority").alias("source"),
        F.col("o_orderdate").cast("timestamp").alias("published_ts"), F.lit("").alias("image_url"), F.col("c_mktsegment").alias("topic"), F.lit("").alias("region"),
        level.alias("coverage_level"), F.lit("").alias("coverage_city"), F.lit("").alias("coverage_province"), F.col("o_orderstatus").alias("registry_key"), "o_custkey",
    )
    first = members.groupBy("o_custkey").agg(F.min("pos").alias("component"))
    labels = members.join(first, "o_custkey").select(F.col("pos").alias("node"), "component")
    out = cluster.collapse(members.drop("o_custkey"), labels)
    return out.select(
        "cluster_id", "pos", "trending_score", F.array_join("sources", "|").alias("sources"), F.array_join("related_links", "|").alias("related_links"), "coverage_level", "registry_key"
    )


def cluster_quality(spark: SparkSession, d: str) -> DataFrame:
    """A7."""
    sizes = table(spark, d, "part").groupBy(F.concat_ws("/", "p_name", F.col("p_size").cast("string")).alias("cluster_id")).agg(F.count("*").alias("trending_score"))
    return cluster.cluster_quality(sizes)


def cluster_samples(spark: SparkSession, d: str) -> DataFrame:
    """The five largest groups of documents that begin with the same line, and how six of each begin."""
    docs = table(spark, d, "documents").where("text is not null")
    members = docs.select(F.substring_index("text", "\n", 1).alias("cluster_id"), F.col("doc_id").alias("pos"), F.col("text").alias("title"))
    return cluster.cluster_samples(members).select("cluster_id", "size", F.array_join("titles", "|").alias("titles"))


QUERIES = {
    f.__name__: f
    for f in (
        feed_page, feed_top_k, feed_look_ahead, feed_counts, scope_counts, rank_recency, rank_category, rank_strongest, rank_rounded, search_page, search_count,
        client_filter, facets, daily_brief, reading_time, local_tier, local_feed, tier_counts, location_mix, feed_plan_sources, registry_stats,
        registry_groups, city_suggest, cluster_collapse, cluster_quality, cluster_samples,
    )
}

_SRC = dims.sql_values(dims.source_rows(), "registry_key, city, province, source_name, source_group, feed_url, coverage_level, priority, active, include_in_general")
_CAT = " ".join(f"WHEN {k} THEN '{w}'" for k, (w, _) in enumerate(rank.CATEGORY))
_CATS = ", ".join(f"CASE WHEN contains(l, '{w}') THEN {b}::DOUBLE ELSE 0.0::DOUBLE END" for w, b in rank.CATEGORY)

ORACLES = {
    "feed_page": _SCORED_SQL + " SELECT id, trending, n_sources, rank_e4 FROM q ORDER BY rank_e4 DESC, id DESC LIMIT 100 OFFSET 5",
    "feed_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY coalesce(o_totalprice, 0) DESC, o_orderkey DESC LIMIT 10",
    "feed_look_ahead": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY coalesce(o_totalprice, 0) DESC, o_orderkey DESC LIMIT 2 OFFSET 5",
    "feed_counts": """SELECT count(*) AS n_rows, coalesce(max(o_orderkey), 0) AS max_id, count(*) FILTER (o_orderstatus IN ('P', 'O')) AS n_pending,
        max(o_orderdate) AS last_updated FROM orders""",
    "scope_counts": f"""SELECT count(*) AS n, max(o_orderdate) AS newest,
        (max(o_orderdate) IS NULL OR date_diff('second', max(o_orderdate), TIMESTAMP '{AS_OF}') >= 900) AS stale
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7""",
    "rank_recency": """WITH a AS (SELECT event_id, greatest(0.0::DOUBLE, date_sub('second', ts, TIMESTAMP '2024-01-15 00:00:00') / 3600.0::DOUBLE) AS age FROM events)
        SELECT event_id, floor((44.0::DOUBLE * exp(-age / 30.0::DOUBLE) + CASE WHEN age <= 2.0 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END) * 1000000.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS recency_e6 FROM a""",
    "rank_category": f"""WITH a AS (SELECT event_id, lower(CASE event_id % 9 {_CAT} END || ' ' || event_type) AS l FROM events)
        SELECT event_id, greatest({_CATS}) AS category, CASE WHEN event_id % 3 = 0 THEN 0.0::DOUBLE ELSE 11.0::DOUBLE END AS image FROM a""",
    "rank_strongest": f"""WITH {STORIES_SQL}, {_PARTS_SQL} SELECT id,
        list_max([struct_pack(v := recency, n := 'recency'), struct_pack(v := coverage, n := 'coverage'), struct_pack(v := diversity, n := 'diversity'), struct_pack(v := image, n := 'image'), struct_pack(v := category, n := 'category')]).n AS strongest FROM k""",
    "rank_rounded": f"""WITH {STORIES_SQL}, {_PARTS_SQL} SELECT id, floor(recency * 100.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS recency_e2, floor(coverage * 100.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS coverage_e2,
        floor(diversity * 100.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS diversity_e2, floor(image * 100.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS image_e2, floor(category * 100.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS category_e2,
        floor(round_even(recency + coverage + diversity + image + category, 4) * 100.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS score_e2 FROM k""",
    "search_page": r"""SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
        WHERE (lower(coalesce(o_orderpriority, '')) LIKE '%ig%' OR lower(coalesce(o_orderstatus, '')) LIKE '%ig%') AND NOT lower(coalesce(o_orderpriority, '')) LIKE '%\%%' ESCAPE '\'
        ORDER BY coalesce(o_totalprice, 0) DESC, o_orderkey DESC LIMIT 30 OFFSET 20""",
    "search_count": """SELECT count(*) AS n FROM documents WHERE contains(lower(coalesce(text, '')), 'token') OR contains(lower(coalesce(lang, '')), 'token')
        OR contains(lower(coalesce(source, '')), 'token')""",
    "client_filter": """WITH p AS (SELECT p_partkey AS id, p_name AS title, lower(p_name || ' ' || p_brand || ' ' || p_type || CASE WHEN p_size % 3 > 0 THEN ' ' || p_brand || '  ' || p_name ELSE '' END) AS hay,
          CASE WHEN p_size % 3 > 0 THEN [p_brand, p_name] ELSE [p_type] END AS outlets FROM part)
        SELECT id, title FROM p WHERE contains(hay, 'ed') AND list_contains(outlets, 'SMALL') UNION ALL SELECT id, title FROM p WHERE contains(hay, 'red') AND list_contains(outlets, 'Brand#11')""",
    "facets": """SELECT DISTINCT kind, value FROM (SELECT 'topic' AS kind, p_type AS value FROM part UNION ALL SELECT 'source', p_brand FROM part
        UNION ALL SELECT 'source', p_type FROM part WHERE p_size > 25) WHERE value <> ''""",
    "daily_brief": _SCORED_SQL
    + """, w AS (SELECT *, rank_e4 / 10000.0::DOUBLE AS rank_score, row_number() OVER (ORDER BY rank_e4 DESC, id DESC) AS pos FROM q QUALIFY pos <= 80),
        x AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id % 50 ORDER BY pos) = 1)
        SELECT id, floor((rank_score + CASE WHEN published_ts::DATE = DATE '1998-08-01' THEN 14.0::DOUBLE ELSE 0.0::DOUBLE END) * 10000.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS brief_e4
        FROM x ORDER BY rank_score + CASE WHEN published_ts::DATE = DATE '1998-08-01' THEN 14.0::DOUBLE ELSE 0.0::DOUBLE END DESC, id DESC LIMIT 5""",
    "reading_time": r"""WITH w AS (SELECT conv_id, sum(len(regexp_extract_all(text, '[^ \t\n\r]+')))::BIGINT AS n_words FROM conversations WHERE text IS NOT NULL GROUP BY 1)
        SELECT conv_id, n_words, greatest(20, least(180, round_even(n_words / 200.0::DOUBLE * 60.0::DOUBLE, 0)::INTEGER)) AS seconds FROM w""",
    "local_tier": f"WITH {PLACES_SQL},{_TIER_SQL} SELECT id, tier FROM u",
    "local_feed": f"""WITH {PLACES_SQL},{_TIER_SQL}, v AS (SELECT id, tier, rank_score + {_BOOST_SQL} AS score, {_REASON_SQL} AS reason FROM u WHERE tier <= 3)
        SELECT id, tier, floor(score * 100.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS score_e2, reason FROM v""",
    "tier_counts": f"WITH {PLACES_SQL},{_TIER_SQL} SELECT tier, count(*) AS n FROM u GROUP BY tier",
    "location_mix": f"WITH {PLACES_SQL},{_TIER_SQL} SELECT {_REASON_SQL} AS reason, count(*) AS n FROM u GROUP BY 1",
    "feed_plan_sources": f"""WITH t AS (SELECT *, CASE WHEN coverage_level = 'city' AND lower(city) = 'mississauga' THEN 0 WHEN coverage_level = 'city' AND lower(city) = 'toronto' THEN 1
        WHEN coverage_level = 'province' AND lower(province) = 'ontario' THEN 2 WHEN coverage_level = 'national' THEN 3 END AS tier FROM {_SRC} WHERE active)
        SELECT registry_key, tier, priority, feed_url FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trim(feed_url) ORDER BY tier, priority, registry_key) = 1""",
    "registry_stats": f"""SELECT count(*) AS defined, count(*) FILTER (active) AS active, count(*) FILTER (active AND include_in_general) AS general FROM {_SRC}""",
    "registry_groups": f"SELECT coverage_level, string_agg(registry_key, ',' ORDER BY registry_key) AS registry_keys FROM {_SRC} WHERE active GROUP BY 1",
    "city_suggest": """WITH c AS (SELECT lower(n_name) AS city, n_name, lower(r_name) AS prov, r_name, lower(substr(r_name, 1, 2)) AS code, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey),
        s AS (SELECT *, (CASE WHEN starts_with(city, 'as') THEN 100000 WHEN contains(city, 'as') THEN 50000 ELSE 0 END
          + CASE WHEN starts_with(prov, 'as') THEN 30000 WHEN contains(prov, 'as') THEN 15000 ELSE 0 END + CASE WHEN starts_with(code, 'as') THEN 25000 ELSE 0 END
          + greatest(0, 500 - k)) - ascii(city) / 1000.0::DOUBLE AS score FROM c WHERE contains(city || ' ' || prov || ' ' || code, 'as'))
        SELECT n_name AS city, r_name AS province, floor(score * 1000.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS score_e3 FROM s ORDER BY score DESC, n_name LIMIT 10""",
    "cluster_collapse": """WITH m AS (SELECT o_custkey, o_orderkey AS pos, 'http://o/' || (o_orderkey % 7) AS link, o_orderpriority AS source, o_orderdate AS ts,
            ['national', 'province', 'city', ''][1 + o_orderkey % 4] AS level, o_orderstatus AS rk FROM orders JOIN customer ON o_custkey = c_custkey),
        g AS (SELECT o_custkey, min(pos) AS cluster_id, arg_max(pos, (ts, -pos)) AS pos, count(*) AS trending_score,
            arg_max(link, (ts, -pos)) AS head_link, arg_min(level, (CASE level WHEN 'city' THEN 0 WHEN 'province' THEN 1 WHEN 'national' THEN 2 END, pos)) FILTER (level <> '') AS coverage_level,
            arg_min(rk, (CASE level WHEN 'city' THEN 0 WHEN 'province' THEN 1 WHEN 'national' THEN 2 END, pos)) FILTER (level <> '') AS registry_key FROM m GROUP BY 1),
        so AS (SELECT o_custkey, string_agg(source, '|' ORDER BY p) AS sources FROM (SELECT o_custkey, source, min(pos) AS p FROM m GROUP BY 1, 2) GROUP BY 1),
        li AS (SELECT x.o_custkey, string_agg(x.link, '|' ORDER BY p) AS related_links FROM (SELECT o_custkey, link, min(pos) AS p FROM m GROUP BY 1, 2) x
               JOIN g ON g.o_custkey = x.o_custkey AND x.link <> g.head_link GROUP BY 1)
        SELECT cluster_id, pos, trending_score, sources, coalesce(related_links, '') AS related_links, coalesce(coverage_level, '') AS coverage_level, coalesce(registry_key, '') AS registry_key
        FROM g JOIN so USING (o_custkey) LEFT JOIN li USING (o_custkey)""",
    "cluster_quality": """WITH c AS (SELECT p_name || '/' || p_size AS id, count(*) AS n FROM part GROUP BY 1), l AS (SELECT id, n FROM c WHERE n > 1 ORDER BY n DESC, id LIMIT 8)
        SELECT count(*) AS n_clusters, sum(n)::BIGINT AS n_articles, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n > 1) AS multi,
          round_even(100.0::DOUBLE * count(*) FILTER (n > 1) / count(*), 1) AS multi_percent, (SELECT string_agg(id || ':' || n, ',' ORDER BY n DESC, id) FROM l) AS largest FROM c""",
    "cluster_samples": """WITH m AS (SELECT split_part(text, chr(10), 1) AS cluster_id, doc_id, substr(text, 1, 120) AS title FROM documents WHERE text IS NOT NULL),
        l AS (SELECT cluster_id, count(*) AS size FROM m GROUP BY 1 HAVING count(*) > 1 ORDER BY size DESC, cluster_id LIMIT 5),
        t AS (SELECT m.*, l.size FROM m JOIN l USING (cluster_id) QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY doc_id) <= 6)
        SELECT cluster_id, size, string_agg(title, '|' ORDER BY doc_id) AS titles FROM t GROUP BY 1, 2""",
}
