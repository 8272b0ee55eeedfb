"""What grew faster than its input, or was cut: each test fails on the code before."""

import pathlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_rounds import plain_selection

from cartoloom.functions import pages, structure, text
from cartoloom.operators import claims, graph, search, sites, topics
from cartoloom.plans import catalog, planning, work
from cartoloom.plans import structure as structure_plans
from cartoloom.sources import reports


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(200).select(F.lit("k").alias("kind"), F.col("id").cast("string").alias("name"), F.array(F.lit("x")).alias("blocks"))
    reports.write_by_file(rows, str(tmp_path / "out"), group="kind", name="name", blocks="blocks")
    tasks = {f.name.split("-")[1] for f in pathlib.Path(tmp_path / "out").rglob("part-*")}
    assert len(tasks) > 4 and spark.read.text(str(tmp_path / "out")).count() == 200


def test_equal_wordings_of_links_meet_once(spark):
    q = spark.createDataFrame([(k % 3, "same?") for k in range(50)], "n int, question string")
    picked = spark.createDataFrame([(k % 5, " same?", f"a{k % 2}", "u/") for k in range(60)], "n int, question string, anchor string, url string")
    got = claims.question_links(q, picked.select("n", "anchor", "url").limit(0), picked)
    assert sorted((r.n, r.anchor, r.url, r.via) for r in got.collect()) == [(n, a, "u", "picked") for n in range(3) for a in ("a0", "a1")]
    assert "LeftSemi" in plan(got) and plan(got).count("Aggregate") >= 4


def test_search_pairs_are_not_met_by_address(spark):
    """Addresses join nothing by themselves: 4,000 searches share one, and only those with a common word are paired."""
    r = spark.range(4000).select("id", F.lit("u").alias("url"), F.lit("h").alias("host")).unionByName(spark.range(2).select("id", F.lit("v").alias("url"), F.lit("h").alias("host")))
    k = spark.range(4000).select("id", F.when(F.col("id") < 3, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.concat(F.lit("t"), F.col("id").cast("string")))).alias("tokens"))
    got = topics.serp_overlaps(r, k, merge=2, split=2)
    assert sorted(map(tuple, got.select("a", "b", "shared", "decision", "suspect").collect())) == [(0, 1, 2, "merge", False), (0, 2, 1, "split", False), (1, 2, 1, "split", False)]
    joins = [line for line in plan(got).splitlines() if "Join Inner" in line]
    assert len(joins) == 1 and "token" in joins[0]


def test_all_pages_of_a_site_are_listed(spark):
    robots = spark.createDataFrame([("s", "https://s.org/", None)], "site string, root string, robots string")
    xml = "<urlset>" + "".join(f"<loc>https://s.org/{k}</loc>" for k in range(4100)) + "</urlset>"
    files = spark.createDataFrame([("https://s.org/sitemap.xml", xml)], "url string, xml string")
    assert sites.site_pages(robots, files, most=None).count() == 4100 and sites.site_pages(robots, files).count() == 4000


def _folder(tmp_path, spark, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_unfinished_references_stay(spark, tmp_path):
    page = "<html><head><title>a &amp; b&amp</title></head><body><h1>c &quot;d&quot; &am &amp</h1><p>e</p></body></html>"
    got = structure_plans.page_readings(spark, _folder(tmp_path, spark, "pages", [(1, "https://a.org/", page)], "page_id long, url string, html string")).collect()
    assert [(r.title, r.h1, r.words) for r in got] == [("a & b&amp", 'c "d" &am &amp', 1)]


def test_pages_of_one_address_are_probed_one_by_one(spark, tmp_path):
    folder = _folder(tmp_path, spark, "pages", [(1, "https://a.org/en/x", ""), (2, "https://a.org/en/x", "")], "page_id long, url string, html string")
    assert sorted(r.in_sitemap for r in work.probed_terms(spark, folder).collect()) == [False, True]


def test_reviews_are_told_apart_by_their_letters(spark, tmp_path):
    rows = [(1, "A b", "en", "s"), (2, "a b", "en", "s"), (3, "A  b", "en", "s"), (4, "A b", "en", "s"), (5, None, None, "s"), (6, None, None, "s")]
    folder = _folder(tmp_path, spark, "documents", rows, "doc_id long, text string, lang string, source string")
    assert sorted(r.doc_id for r in catalog.review_dedupe(spark, folder).collect()) == [1, 2, 3, 5]


def test_pages_are_handed_on_in_small_slices():
    batch = pd.Series(["<p>a</p>"] * 300)
    sizes = [len(x) for x in structure.page_chunks.func(iter([batch]))]
    parsed = [len(x) for x in pages.parse_page.func(iter([batch]))]
    links = [len(x) for x in structure.link_classes.func(iter([(batch, batch)]))]
    blocks = [len(x) for x in structure.page_blocks.func(iter([(batch, batch)]))]
    assert sum(sizes) == sum(links) == sum(blocks) == sum(parsed) == 300 and max(sizes + links + blocks + parsed) <= 64


def test_queries_meet_documents_in_place_or_shuffled_alike(spark):
    words = lambda k: [f"w{(k * j) % 17}" for j in range(1, 9)]
    docs = spark.createDataFrame([(k, words(k)) for k in range(60)], "d int, words array<string>")
    asked = spark.createDataFrame([(k, words(k + 3)[:3]) for k in range(5)], "q int, words array<string>")
    got, far = (search.bm25(docs, asked, doc_key="d", query_key="q", k=None, most_terms=n) for n in (100, 0))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, far.collect()))
    # neither terms nor scores are shuffled: one exchange for the documents' postings, one for document frequencies
    text = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in text and text.count("hashpartitioning(d#") == 1 and "hashpartitioning(q#" not in text


def test_keywords_are_paired_by_many_tasks(spark):
    """600 keywords of one page, all of one token set but two: what they read is little, so a task number of their own is kept."""
    rows = spark.createDataFrame([(k, ["x"] if k < 2 else ["x", "y"], "/u", "generic", "", "mixed") for k in range(600)], "id long, tokens array<string>, url string, partition string, local string, intent string")
    for got, n in ((topics.identical_tokens(rows), 1 + 598 * 597 // 2), (topics.same_url(rows, least=0.6), 1 + 598 * 597 // 2), (topics.same_url(rows, least=0.5), 600 * 599 // 2)):
        tasks = got.select(F.spark_partition_id().alias("t")).groupBy("t").count().collect()
        assert sum(r["count"] for r in tasks) == n and len(tasks) > 4


def test_words_of_runs_are_split_once(spark):
    rows = spark.createDataFrame([("a b la c 1 2 a b",), (None,), ("a",)], "text string").select(text.ngrams(text.ascii_words(F.col("text")), 2, ["la"]).alias("g"))
    assert [r.g for r in rows.collect()] == [["a b", "c 1", "2 a"], [], []] and plan(rows).count("split(") == 1


def test_edges_are_made_by_many_tasks(spark, tmp_path):
    folder = _folder(tmp_path, spark, "part", [(k, "x") for k in range(2000)], "p_partkey long, p_type string")
    edges = planning._edges(spark, folder)
    tasks = edges.select(F.spark_partition_id().alias("t")).groupBy("t").count().collect()
    assert sum(r["count"] for r in tasks) == 2000 * 40 - 40 * 41 // 2 and len(tasks) > 16


def test_questions_meet_in_blocks(spark):
    """No pair that only shares a word is shuffled; rows are those of the plain rule, for equal wordings, empty and null ones too."""
    rng = random.Random(4)
    rows = [(k, f"q{k % 37}", rng.sample([f"w{j}" for j in range(30)], rng.randrange(0, 9)) or None) for k in range(90)] + [(90, None, ["only"]), (91, None, [])]
    got = claims.near_questions(spark.createDataFrame(rows, "n int, question string, tokens array<string>"), least=0.4)
    like = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) >= 0.4 if a and b else False
    assert sorted(map(tuple, got.collect())) == [(a, b) for a, q, s in rows for b, r, t in rows if a < b and ((q == r and q is not None) or like(s, t))]
    assert "FlatMapGroupsInArrow" in plan(got) and plan(got).count("Join Inner") <= 3


def test_neighbours_meet_in_cells(spark, monkeypatch):
    """Vectors and anchors in several parts give the plain rule's rows, equal ones by key; no pair of rows is joined."""
    monkeypatch.setattr(search, "VECTORS", 7)
    monkeypatch.setattr(search, "ANCHORS", 3)
    rng = random.Random(6)
    rows = [(k, k % 2, [float(rng.randrange(-2, 3)) for _ in range(3)]) for k in range(60)] + [(60, 0, None), (61, None, [1.0, 0.0, 0.0]), (62, 0, [1.0, None, 0.0])]
    v = spark.createDataFrame(rows, "id int, b int, v array<double>")
    got = search.neighbours(v, v.where("id % 4 = 0"), key="id", block="b", vector="v", floor=0.1, k=4)
    size = lambda x: sum(t * t for t in x) ** 0.5
    cosine = lambda x, y: round(sum(s * t for s, t in zip(x, y, strict=True)) / (size(x) * size(y)), 6) if size(x) and size(y) else 0.0
    want = []
    for k, b, x in rows[:60:4]:
        best = sorted((-cosine(x, y), o) for o, c, y in rows[:60] if c == b and o != k and cosine(x, y) >= 0.1)[:4]
        want += [(k, o, -c, n) for n, (c, o) in enumerate(best, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and "Join" not in plan(got)


def shuffled(spark):
    """Rows written for shuffles so far."""
    context = spark.sparkContext
    store = context._jsc.sc().statusStore()
    stages = store.stageList(context._jvm.java.util.ArrayList(), False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def _candidates(spark, seed, n, anchors):
    rng = random.Random(seed)
    rows = [{"id": k, "site": rng.choice(["s", "t", None]), "source": rng.randrange(n // 8), "target": rng.randrange(1, n // 8), "anchor": f"a{rng.randrange(anchors)}", "sentence": rng.randrange(9), "score": rng.randrange(n // 2) / n, "first_reason": None, "second_reason": None, "owner": None} for k in range(n)]
    return rows, spark.createDataFrame([tuple(r.values()) for r in rows], "id int, site string, source int, target int, anchor string, sentence int, score double, first_reason string, second_reason string, owner string").coalesce(1)


def test_link_candidates_stay_where_they_are(spark, monkeypatch):
    """Six anchors: their owners rule out nearly all candidates, and only the neighbours of the others are shuffled."""
    monkeypatch.setattr(graph, "FEW", 400, raising=False)
    rows, table = _candidates(spark, 1, 4000, 6)
    before = shuffled(spark)
    got = {r.id: r.drop_reason for r in graph.select_links(table.na.fill("u", ["site"])).collect()}
    assert shuffled(spark) - before < 4000
    assert got == plain_selection([r | {"site": r["site"] or "u"} for r in rows], 5, 10)


@pytest.mark.parametrize("few", [0, 40, 100_000])
def test_links_are_selected_alike_with_many_open(spark, monkeypatch, few):
    """Sites without a name are one site (before, they never came to an end)."""
    monkeypatch.setattr(graph, "FEW", few)
    rows, table = _candidates(spark, 2, 240, 70)
    assert {r.id: r.drop_reason for r in graph.select_links(table, per_source=2, per_target=3).collect()} == plain_selection(rows, 2, 3)


@pytest.mark.parametrize("bits", [64, 256])
def test_searches_meet_in_blocks_by_bits(spark, monkeypatch, bits):
    """More and fewer addresses than bits, words of many blocks: rows are those of the plain rule, and a pair compares no word sets."""
    monkeypatch.setattr(topics, "BITS", bits)
    monkeypatch.setattr(topics, "HELD", 4)
    rng = random.Random(8)
    found = {k: {f"u{rng.randrange(90)}" for _ in range(rng.randrange(0, 6))} for k in range(120)}
    words = {k: rng.sample([f"w{j}" for j in range(7)], rng.randrange(0, 4)) for k in range(130)} | {7: ["own"], 8: ["rare", "w1"], 9: ["rare", "w1"]}
    r = spark.createDataFrame([(k, u, "h") for k, x in found.items() for u in x] + [(k, "u1", "p.com") for k in found] + [(0, None, "h"), (1, "u2", None)], "id long, url string, host string")
    k = spark.createDataFrame([(k, [*x, None]) for k, x in words.items()] + [(5, None)], "id long, tokens array<string>")
    both = [(a, b, len(found[a] & found[b])) for a in found for b in found if a < b and {*words[a]} & {*words[b]}]
    company = {x for a, b, n in both if n for x in (a, b)}
    wanted = [(a, b, n, "keep" if not {a, b} <= company else "merge" if n >= 2 else "split" if n < 1 else "keep", not {a, b} <= company) for a, b, n in both]
    got = topics.serp_overlaps(r, k, platforms=["p.com"], merge=2, split=1)
    assert sorted(map(tuple, got.collect())) == sorted(wanted) and len({d for *_, d, _ in wanted}) == 3 and "array_min" not in plan(got)


def test_keyword_sets_are_numbered(spark, monkeypatch):
    """Rows are those of the plain rule, blocks or none, words with blanks and missing intents too; no set of words is shuffled for a pair."""
    monkeypatch.setattr(topics, "HELD", 5)
    rng = random.Random(9)
    sets = [["x"], ["x", "y"], ["x y"], []]
    rows = [(k, rng.choice(sets), rng.choice(["generic", "own-brand", "branded"]), rng.choice(["", "", None]), rng.choice(["mixed", "commercial", "informational", None])) for k in range(150)]
    got = topics.identical_tokens(spark.createDataFrame(rows, "id long, tokens array<string>, partition string, local string, intent string"))
    fits = lambda x, y: "mixed" in (x, y) or (x == y and x is not None)
    wanted = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] and a[1:4] == b[1:4] and a[2] != "own-brand" and a[3] is not None and fits(a[4], b[4])]
    assert sorted((r.a, r.b) for r in got.collect()) == wanted and len(wanted) > 100


def test_files_are_made_and_read_by_the_tasks(spark, tmp_path):
    """The folders are those that Spark's writer makes, odd names too; what is read is what was written, and no driver lists the files."""
    names = ["a", "a b", "x/y", "50%", "a=b", "[1]", "é:#", 'q"', "", None, "back\\slash", "t\tab", "+"]
    rows = spark.createDataFrame([(g, n, [f"{g} {n} ", "z"]) for g in ("k", None, "g/1") for n in names] + [("k", "a", ["z"])], "kind string, name string, blocks array<string>")
    reports.write_by_file(rows, str(tmp_path / "out"), group="kind", name="name", blocks="blocks")
    rows.where("size(blocks) > 1").dropDuplicates(["kind", "name"]).selectExpr("kind", "name", "to_json(blocks) value").write.partitionBy("kind", "name").text(str(tmp_path / "plain"))
    folders = lambda at: sorted(str(p.relative_to(tmp_path / at)) for p in pathlib.Path(tmp_path / at).glob("*/*") if p.is_dir())
    assert folders("out") == folders("plain")
    got = reports.read_by_file(spark, "file://" + str(tmp_path / "out"), group="kind", name="name").collect()
    named = {(r.kind, r.name) for r in got}
    assert named == {(g, n or None) for g in ("k", None, "g/1") for n in names} and len([r for r in got if (r.kind, r.name) == ("k", "a b")]) == 1
    with pytest.raises(FileExistsError):
        reports.write_by_file(rows, str(tmp_path / "out"), group="kind", name="name", blocks="blocks")
