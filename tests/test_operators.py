"""Property and brute-force tests of the operators that have no SQL oracle."""

import difflib
import random

from pyspark.sql import functions as F

from pressmill.catalogue import articles
from pressmill.functions import text
from pressmill.operators import cluster, components, dedupe, ingest, readers


def test_greedy_dedupe_equals_scan(spark):
    rng = random.Random(3)
    for n in (1, 40, 120):
        rows = [(i, rng.choice([None, *"abcdefgh"]), rng.choice("uvwxyz")) for i in range(n)]
        df = spark.createDataFrame(rows, "pos long, link_key string, content_key string")
        got = {r.pos for r in dedupe.dedupe_greedy(df).where("kept").collect()}
        links, contents, want = set(), set(), set()
        for pos, link, content in rows:
            if (link and link in links) or content in contents:
                continue
            want.add(pos)
            contents.add(content)
            if link:
                links.add(link)
        assert got == want


def test_dedupe_cases(spark):
    df = spark.createDataFrame([(1, "L1", "F1"), (2, "L1", "F2"), (3, "L2", "F2")], "pos long, link_key string, content_key string")
    assert sorted(r.pos for r in dedupe.dedupe_greedy(df).where("kept").collect()) == [1, 3]
    assert dedupe.dedupe_greedy(df.limit(0)).count() == 0


def test_rounds_have_one_row_for_each_pair_of_keys(spark):
    """Rows equal in both keys are judged as one; links and contents may be null or shared across pairs."""
    rng = random.Random(7)
    rows = [(i, rng.choice([None, "a", "b", "c"]), rng.choice("uvw")) for i in range(400)]
    df = spark.createDataFrame(rows, "pos long, link_key string, content_key string")
    kept = dedupe.kept_first(df)
    assert kept.count() <= 12 and dedupe.dedupe_greedy(df).count() == 400
    stored = spark.createDataFrame([("c", "x"), (None, "w")], "link_key string, content_key string")
    links, contents, want = set(), set(), {}
    for pos, link, content in rows:
        if link is None or link == "c" or content == "w":
            want[pos] = "missing_link" if link is None else "stored_link" if link == "c" else "stored_content"
            continue
        want[pos] = "batch_duplicate" if link in links or content in contents else "new"
        if want[pos] == "new":
            links.add(link)
            contents.add(content)
    got = dedupe.merge_new(df, stored).collect()
    assert len(got) == 400 and {r.pos: r.reason for r in got} == want


def test_judged_without_links_is_by_content(spark):
    rows = [(0, "", "t", "s"), (1, " ", "t", "s"), (2, "http://a.ca/x", "t", "s"), (3, "http://a.ca/y", "u", "s"), (4, "http://a.ca/y/", "v", "s"), (5, "", "w", "s")]
    df = spark.createDataFrame([(*r, "", "Canada") for r in rows], "pos long, link string, title string, source string, published_text string, region string")
    got = {r.pos: r.verdict for r in ingest.judged(df).collect()}
    assert got == {0: "kept", 1: "duplicate_content", 2: "duplicate_content", 3: "kept", 4: "duplicate_link", 5: "kept"}


def test_merge_reasons(spark):
    schema = "pos long, link_key string, content_key string"
    batch = spark.createDataFrame([(1, None, "a"), (2, "s", "b"), (3, "n", "c"), (4, "n", "d"), (5, "m", "e")], schema)
    stored = spark.createDataFrame([(0, "s", "x"), (0, "q", "e")], schema)
    got = {r.pos: r.reason for r in dedupe.merge_new(batch, stored).collect()}
    assert got == {1: "missing_link", 2: "stored_link", 3: "new", 4: "batch_duplicate", 5: "stored_content"}


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_wording_candidates_cover_all_pairs(spark):
    rng = random.Random(9)
    words = "storm hits coast mayor budget vote fire crews river team wins final".split()
    titles = [" ".join(rng.choices(words, k=rng.randrange(2, 8))) for _ in range(40)]
    titles += [titles[0], titles[1] + " again today", "the", "a an", "vote"]
    df = spark.createDataFrame([(i, t, "", "", rng.choice(["", "x", "y"])) for i, t in enumerate(titles)], "pos long, title string, excerpt string, link string, topic string")
    prepared = cluster.prepare(df)
    got = {(r.a, r.b) for r in cluster.wording_edges(prepared).collect()}
    every = prepared.select(F.col("pos").alias("a")).crossJoin(prepared.select(F.col("pos").alias("b"))).where("a < b")
    want = {(r.a, r.b) for r in cluster.scored_pairs(prepared, every).where(cluster.wording_rule()).select("a", "b").collect()}
    assert got == want and want


def test_ratio_is_directed(spark):
    df = spark.createDataFrame([("abcd ef", "ef abcd"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(cluster.ratio("a", "b")).collect()] == [difflib.SequenceMatcher(None, "abcd ef", "ef abcd").ratio(), 0.0]


def test_clusters_end_to_end(spark):
    rows = [
        (1, "Storm hits the northern coast tonight", "", "http://a/1", "A", "2026-01-01 00:00:00", "Other"),
        (2, "Storm hits the northern coast tonight!", "", "http://b/2", "B", "2026-01-02 00:00:00", "Canada"),
        (3, "Council passes budget", "", "http://c/3", "C", None, "Other"),
        (4, "Unrelated words here", "", "http://c/3?utm_source=x", "D", None, "Other"),
    ]
    df = spark.createDataFrame(rows, "pos long, title string, excerpt string, link string, source string, t string, topic string").withColumn("published_ts", F.to_timestamp("t"))
    for c in ("image_url", "region", "coverage_level", "coverage_city", "coverage_province", "registry_key"):
        df = df.withColumn(c, F.lit(""))
    got = {r.cluster_id: r for r in cluster.cluster_articles(df).collect()}
    assert set(got) == {1, 3} and got[1].title.endswith("!") and got[1].sources == ["A", "B"] and got[1].related_links == ["http://a/1"]
    assert got[3].trending_score == 2


def test_affinity_cap(spark):
    df = spark.createDataFrame([("u", " News ", "save")] * 30 + [("u", "", "open"), ("u", "news", "close")], "user_id string, category string, kind string")
    assert [tuple(r) for r in readers.affinity(df).collect()] == [("u", "news", 200.0)]


def test_image_repeats(spark):
    df = spark.createDataFrame([(1, "http://i/a?x"), (2, "http://i/a?y"), (3, "")], "pos long, image string").withColumn("page", F.lit(1))
    from pressmill.functions.urls import image_key

    got = [r.image_shown for r in dedupe.unique_images(df, "image", image_key(F.col("image")), F.col("pos").cast("string"), ["page"]).orderBy("pos").collect()]
    assert got[0] == "http://i/a?x" and got[1].startswith("placeholder-") and got[2].startswith("placeholder-")


def test_placeholder_range(spark):
    got = {r[0] for r in spark.range(50).select(text.placeholder(F.col("id").cast("string"))).collect()}
    assert got == {0, 1, 2, 3}


def _written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_containment_pairs_equal_brute_force(spark, tmp_path):
    head = "storm hits the northern coast tonight"
    docs = [(1, f"{head}\nmore"), (2, f"Breaking news now {head}"), (3, f"{head} and crews wait"), (4, "council passes a budget at last"), (5, None), (6, "tonight")]
    items = [(1, f"Late {head} again"), (2, "passes a budget at last"), (9, "nothing like the others at all here")]
    d = _written(spark, tmp_path, documents=([(i, t, "en", "s") for i, t in docs], "doc_id long, text string, lang string, source string"), benchmark=(items, "item_id long, text string"))
    got = {tuple(r) for r in articles.containment_pairs(spark, d).collect()}
    titles = [("documents", i, (t or "").split("\n")[0].lower()) for i, t in docs] + [("benchmark", i, t.lower()) for i, t in items]
    want = set()
    for k, a in enumerate(sorted(titles)):
        for b in sorted(titles)[k + 1 :]:
            short, long_ = sorted((a[2], b[2]), key=len)
            if len(short) >= 18 and len(short) / len(long_) >= 0.48 and short in long_:
                want.add((*a[:2], *b[:2]))
    assert got == want and ("documents", 1, "documents", 2) in got and ("benchmark", 1, "documents", 1) in got and ("benchmark", 2, "documents", 4) in got


def test_titles_with_a_common_head_make_no_pair(spark):
    """Only titles that hold one another come out, however many share a head or a passage; copies are paired in parts."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcd é") for _ in range(rng.randint(2, 9)))
    titles = [f"the council of the city says {word()} {word()}{' more words' * rng.randint(0, 3)}" for _ in range(120)]
    titles += [t[rng.randint(0, 4) : len(t) - rng.randint(0, 4)] for t in titles[:40]] + ["the council of the city says"] * 5 + ["x" * n for n in range(15, 60)]
    df = spark.createDataFrame(list(enumerate(titles)), "pos long, story string")
    got = [(r.a, r.b) for r in cluster.contained_candidates(df).collect()]
    holds = lambda a, b: len(a) >= 18 and len(a) / len(b) >= 0.48 and a in b
    want = {(i, j) for i, a in enumerate(titles) for j, b in enumerate(titles) if i < j and (holds(a, b) or holds(b, a))}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40


def test_pairs_of_one_group_are_made_by_many_tasks(spark, monkeypatch):
    """Copies of one title, and of a longer one that holds it: no task makes more than half of the pairs."""
    monkeypatch.setattr(cluster, "PART", 50)
    short = "the council of the city says"
    df = spark.createDataFrame([(k, short if k % 3 else short + " no") for k in range(900)], "pos long, story string")
    got = cluster.contained_candidates(df).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.count_if(F.expr("a < b")).alias("up"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).collect()
    want = spark.range(900).toDF("a").crossJoin(spark.range(900).toDF("b")).where("a < b").agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[0]
    made = [r.n for r in got]
    assert sum(made) == sum(r.up for r in got) == 900 * 899 // 2 and sum(r.sum for r in got) == want
    assert max(made) < sum(made) / 2


def test_lexical_clusters_equal_brute_force(spark, tmp_path):
    rng = random.Random(6)
    words = "storm hits coast mayor budget vote fire crews river team wins final council road bridge school".split()
    line = lambda n: " ".join(rng.choices(words, k=n))
    long_, body = line(25), line(40)
    texts = [f"{long_} {line(25)}\n{line(30)}" for _ in range(3)] + [f"{long_} {long_} the end", f"{long_} {long_} the end\n{line(30)}", f"storm on coast\n{body}", f"storm on a coast\n{body}"]
    texts += [f"fire in the council\n{body}", f"fire in the council minister\n{body}", *(f"{line(4)}\n{line(20)}" for _ in range(20)), None]
    d = _written(spark, tmp_path, documents=([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string"))
    got = sorted(tuple(r) for r in articles.lexical_clusters(spark, d).collect())
    blob = F.lower(F.concat_ws(" ", "title", "excerpt"))
    prepared = cluster.prepare(articles._docs(spark, d).withColumns({"link": F.lit(""), "topic": articles.classify.keyword_topic(blob, articles.TEST_TOPICS)}))
    every = prepared.select(F.col("pos").alias("a")).crossJoin(prepared.select(F.col("pos").alias("b"))).where("a < b")
    label = list(range(len(texts)))
    for r in cluster.scored_pairs(prepared, every).where(cluster.wording_rule()).collect():
        x, y = sorted((label[r.a], label[r.b]))
        label = [x if v == y else v for v in label]
    want = sorted((x, label.count(x)) for x in set(label) if label.count(x) > 1)
    assert got == want and want and label[0] != label[1] and label[3] == label[4] and label[5] == label[6]


def test_wording_links_have_the_components_of_all_pairs(spark, monkeypatch):
    """Many blocks and steps; near and whole copies, short and sports titles, topics, and titles without a word that counts."""
    monkeypatch.setattr(cluster, "SIDE", 40)
    monkeypatch.setattr(cluster, "STEP", 8)
    rng = random.Random(12)
    words = "storm hits coast mayor budget vote fire crews river team wins final council road".split()
    titles = [" ".join(rng.choices(words, k=rng.randrange(1, 14))) for _ in range(90)]
    near = lambda t: " ".join(w[: rng.randint(len(w) - 1, len(w))] for w in t.split())
    titles += [near(t) for t in titles[:45] for _ in range(2)] + titles[:20] + [f"leafs vs {w} 4" for w in words[:3] * 4] + ["a vs b"] * 6 + ["to be or not to be", "to be or not to by", "it is what it is", "it is what it is it"]
    bodies = ["", *(" ".join(rng.choices(words, k=9)) for _ in range(3))]
    rows = [(i, t, "" if i % 3 else rng.choice(bodies), "", rng.choice([None, "", "x", "y"])) for i, t in enumerate(titles)]
    prepared = cluster.prepare(spark.createDataFrame(rows, "pos long, title string, excerpt string, link string, topic string")).checkpoint()
    every = prepared.select(F.col("pos").alias("a")).crossJoin(prepared.select(F.col("pos").alias("b"))).where("a < b")
    want = list(range(len(rows)))
    for r in cluster.scored_pairs(prepared, every).where(cluster.wording_rule()).collect():
        x, y = sorted((want[r.a], want[r.b]))
        want = [x if v == y else v for v in want]
    links = [(r.a, r.b) for r in cluster.wording_links(prepared).collect()]
    got = list(range(len(rows)))
    for a, b in links:
        x, y = sorted((got[a], got[b]))
        got = [x if v == y else v for v in got]
    assert got == want and len(set(want)) > 30 and want[-4] == want[-3] and want[-2] == want[-1]


def test_lexical_clusters_of_titles_without_a_word_that_counts(spark, tmp_path):
    texts = ["to be or not to be", "to be or not to by", "a long storm on the coast"]
    d = _written(spark, tmp_path, documents=([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string"))
    assert [tuple(r) for r in articles.lexical_clusters(spark, d).collect()] == [(0, 2)]


def test_near_copies_make_few_links(spark):
    rows = [(i, f"the mayor and the council vote on the budget again tonight {i % 9}", "the whole text of it", "", "") for i in range(400)]
    prepared = cluster.prepare(spark.createDataFrame(rows, "pos long, title string, excerpt string, link string, topic string"))
    assert cluster.wording_links(prepared).count() < 2 * len(rows)
    assert {r.component for r in components.components(cluster.wording_links(prepared)).collect()} == {0}


def test_reaches_is_the_ratio():
    rng = random.Random(15)
    texts = ["".join(rng.choice("ab cdeé9" * 9 + "xyzwvutsrq") for _ in range(rng.choice([1, 9, 40, 260]))) for _ in range(40)]
    texts += [t[: len(t) // 2] + t[len(t) // 2 + rng.randint(0, 3) :] for t in texts]
    matcher = difflib.SequenceMatcher(None)
    for a in texts:
        for b in texts:
            r = 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()
            assert all(cluster.reaches(matcher, a, b, x) == (r >= x) for x in (0.3, 0.86, 0.93, r, 1.0))


def test_whole_rows_go_only_where_they_may_have_a_partner(spark, monkeypatch):
    """Rows that are alike by no bound take part in the first comparison alone; copies of a row are one in it."""
    monkeypatch.setattr(cluster, "SIDE", 40)
    monkeypatch.setattr(cluster, "STEP", 8)
    linked_in = cluster._linked_in

    def only_alike(config):
        run = linked_in(config)

        def checked(part):
            assert all(t.startswith("mayor") for t in part.column("story").to_pylist())
            return run(part)

        return checked

    monkeypatch.setattr(cluster, "_linked_in", only_alike)
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7))
    titles = [" ".join(word() for _ in range(5)) for _ in range(150)] + ["council votes on the budget again"] * 60 + ["mayor sees the storm at the coast", "mayor sees the storm on the coast"]
    rows = [(i, t, "", "", "") for i, t in enumerate(titles)]
    prepared = cluster.prepare(spark.createDataFrame(rows, "pos long, title string, excerpt string, link string, topic string"))
    links = {(r.a, r.b) for r in cluster.wording_links(prepared).collect()}
    assert links == {(150, 150 + k) for k in range(1, 60)} | {(210, 211)}


def test_jaccard_pairs_of_all_parts_equal_brute_force(spark):
    d = "/root/testdata/sf0.001"
    words = {r.p_partkey: set(f"{r.p_name} {r.p_brand} {r.p_type} s{r.p_size}".lower().split(" ")) for r in spark.read.parquet(f"{d}/part.parquet").collect()}
    want = {(a, b) for a in words for b in words if a < b and len(words[a] & words[b]) >= 0.6 * len(words[a] | words[b])}
    got = [tuple(r) for r in articles.jaccard_pairs(spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_prefix_pairs_lose_none(spark):
    """Random sets with common and rare tokens, repeats, tiny and empty ones, against all pairs; frequent tokens are split."""
    import random

    rng = random.Random(4)
    common, rare = [f"c{k}" for k in range(12)], [f"r{k}" for k in range(60)]
    sets = [sorted(set(rng.sample(common, rng.randint(0, 8)) + rng.sample(rare, rng.randint(0, 2)))) for _ in range(260)] + [[], ["c1"], ["c1"], ["c1", "c2"], ["r1"]]
    df = spark.createDataFrame(list(enumerate(sets)), "pos long, words array<string>")
    for least in (0.3, 0.38, 0.6, 0.9, 1.0):
        similar = lambda a, b: bool(a and b) and len({*a} & {*b}) >= least * len({*a} | {*b}) - 1e-9  # noqa: B023, E731
        want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and similar(a, b)}
        got = [(r.a, r.b) for r in cluster.prefix_pairs(df, least).collect()]
        assert len(got) == len(set(got)) and want <= set(got) and (least > 0.5 or len(got) < 260 * 259 / 2)


def test_copies_are_paired_after_their_sets_are_compared(spark, monkeypatch):
    monkeypatch.setattr(cluster, "PART", 7)
    kinds = [["a", "b", "c"], ["a", "b", "c", "d"], ["a", "b", "x", "y"], ["q"]]
    df = spark.createDataFrame([(k, kinds[k % 4]) for k in range(120)], "pos long, words array<string>")
    assert cluster.similar_sets(df, 0.6)[2].count() <= 3
    got = [(r.a, r.b) for r in cluster.overlap_pairs(df, 0.6).collect()]
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if len({*kinds[i % 4]} & {*kinds[j % 4]}) >= 0.6 * len({*kinds[i % 4]} | {*kinds[j % 4]})}
    assert len(got) == len(set(got)) and set(got) == want


def test_ratio_bound_is_never_below_the_ratio(spark):
    from pressmill.functions import similarity

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde éß9") for _ in range(rng.randint(0, 30)))
    rows = [(a, b) for a, b in ((word(), word()) for _ in range(300))] + [("", ""), ("abc", ""), ("abc", "abc"), ("council votes", "council vote")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(similarity.ratio("a", "b").alias("r"), similarity.ratio_bound(similarity.letter_counts(F.col("a")), similarity.letter_counts(F.col("b"))).alias("m")).collect()
    assert all(x.r <= x.m + 1e-9 for x in got) and sum(x.m < 0.6 for x in got) > 50


def test_cluster_samples(spark):
    rows = [("a", k, f"title {k} " + "x" * 200) for k in range(9)] + [("b", 20, None), ("b", 21, "t")] + [("c", 30, "alone")] + [(f"d{k}", 40 + 2 * k + i, "d") for k in range(5) for i in range(2)]
    got = {r.cluster_id: (r["size"], r.titles) for r in cluster.cluster_samples(spark.createDataFrame(rows, "cluster_id string, pos int, title string")).collect()}
    assert set(got) == {"a", "b", "d0", "d1", "d2"} and got["b"] == (2, ["", "t"])
    assert got["a"][0] == 9 and [t[:7] for t in got["a"][1]] == [f"title {k}" for k in range(6)] and {len(t) for t in got["a"][1]} == {120}


def test_scan_order_and_warm_up(spark):
    feeds = [spark.createDataFrame(r, "entry_pos int, title string") for r in ([(0, "x"), (1, "y")], [], [(0, "y"), (1, "z")])]
    first = dedupe.first_by(ingest.scanned(feeds), F.col("title"))
    assert sorted((r.pos.feed, r.pos.entry, r.title) for r in first.collect()) == [(0, 0, "x"), (0, 1, "y"), (2, 1, "z")]
    rows = spark.createDataFrame([(1, None), (2, 3.0), (3, 3.0), (4, 0.0), (5, -1.0)], "id int, rank_score double")
    assert [r.id for r in ingest.warm_up(rows).collect()] == [3, 2, 4]
