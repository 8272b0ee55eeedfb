"""Sequential choices and rules that SQL can't state, on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from cartoloom.functions import structure
from cartoloom.operators import graph, links, reviews, sites, topics, voice
from cartoloom.sources import files


def test_links_are_taken_in_order_with_every_reason(spark):
    rows = [
        (1, "gone", "b", "a fine way", 1, 0.99, "a fine way"), (2, "a", "gone", "a fine way", 1, 0.98, "a fine way"), (3, "a", "a", "a fine way", 1, 0.97, "a fine way"), (4, "a", "b", "a fine way", 1, 0.96, "a fine way"),
        (5, "a", "b", "other way", 2, 0.95, "other way"), (6, "a", "c", "other way", 2, 0.94, "other way"), (7, "a", "d", "other way", 2, 0.93, "other way"), (8, "b", "c", "", 3, 0.92, "x"), (9, "b", "c", "not there", 3, 0.91, "x"),
        (10, "b", "c", "word", 3, 0.90, "word"), (11, "b", "c", "Click here", 3, 0.89, "Click here"), (12, "b", "c", "old anchor", 3, 0.88, "old anchor"), (13, "b", "c", "A fine way", 3, 0.87, "A fine way"), (14, "a", "e", "new way", 1, 0.86, "new way"),
        (15, "a", "e", "new way", 4, 0.85, "new way"), (16, "a", "f", "next way", 5, 0.84, "next way"), (17, "b", "e", "last way", 6, 0.83, "last way"),
    ]
    c = spark.createDataFrame([("s", *r) for r in rows], "site string, id int, source string, target string, anchor string, sentence int, score double, sentence_text string")
    pages = spark.createDataFrame([(u, True, True) for u in "abcdef"], "url string, source_ok boolean, target_ok boolean")
    linked = spark.createDataFrame([("a", "c")], "source string, destination string")
    near = spark.createDataFrame([("a", "d")], "a string, b string")
    owners = spark.createDataFrame([("old anchor", "f")], "anchor string, target string")
    marked = links.static_drop_reasons(c, pages, linked, near, owners, generic=("click here",))
    got = {r.id: r.drop_reason for r in graph.select_links(marked, per_source=2, per_target=1).collect()}
    assert got == {
        1: "source not eligible", 2: "target not eligible", 3: "self", 4: None, 5: "duplicate pair", 6: "already linked", 7: "near duplicate", 8: "no anchor", 9: "not verbatim", 10: "anchor length", 11: "generic anchor",
        12: "anchor owned", 13: "anchor owned", 14: "sentence used", 15: None, 16: "source budget", 17: "target budget",
    }


def test_anchor_spans(spark):
    s = spark.createDataFrame([("We compare red boxing gloves, and running shoes",), ("",)], "s string")
    spans = s.select(links.anchor_spans(F.col("s"), F.array(F.lit("boxing"), F.lit("gloves")), stop=("and", "we"), breaks=("is",)).alias("x")).collect()
    assert spans[0].x[0] == "boxing gloves" and "gloves and running" not in spans[0].x and all(2 <= len(x.split()) <= 6 for x in spans[0].x) and spans[1].x == []


def test_quotes_are_not_used_twice(spark):
    rows = [("r", 1, "x", k, f"q{k}") for k in range(4)] + [("r", 2, "y", 0, "q0"), ("r", 2, "y", 1, "q7"), ("r", 3, "z", 0, "q1")]
    got = voice.assigned_quotes(spark.createDataFrame(rows, "run string, rank int, issue string, place int, review string"), most=3).collect()
    assert sorted((r.issue, r.review) for r in got) == [("x", "q0"), ("x", "q1"), ("x", "q2"), ("y", "q7"), ("z", "q1")]


def test_phrases_that_say_the_same_go(spark):
    rows = [("p", "day off work", 3.0, [1, 2, 3]), ("p", "off work", 2.5, [1, 2, 3]), ("p", "work to wait", 2.0, [1, 2]), ("p", "work well", 1.5, [9, 10]), ("n", "off work", 1.0, [1])]
    got = voice.distinct_phrases(spark.createDataFrame(rows, "side string, phrase string, score double, reviews array<int>")).collect()
    assert sorted((r.side, r.phrase) for r in got) == [("n", "off work"), ("p", "day off work"), ("p", "work well")]


def test_a_budget_passes_over_what_does_not_fit(spark):
    rows = [("s", k, a, b) for k, (a, b) in enumerate([("a", "b"), ("b", "c"), ("d", "e"), ("a", "c"), ("c", "d")])]
    got = topics.within_budget(spark.createDataFrame(rows, "site string, place int, a string, b string"), limit=4).orderBy("place").collect()
    assert [(r.a, r.b) for r in got] == [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")]


def test_praise_turns_a_safety_word_round(spark):
    said = ["Never had any problems with mould", "There was mould on it", "no issues at all. Caught fire", "without any problem, a recall", "exposed wires everywhere", "it is sharp"]
    got = spark.createDataFrame([(s,) for s in said], "s string").select(voice.safety_kind(F.col("s")).alias("k")).collect()
    assert [r.k for r in got] == [None, "food safety", "injury", None, "hazard", None]


def test_closest_snapshot_ties_and_gaps(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    pages = spark.createDataFrame([("a", t(10)), ("a", t(1)), ("b", t(5))], "url string, wanted timestamp")
    shots = spark.createDataFrame([("a", t(8), "x"), ("a", t(12), "y"), ("c", t(5), "z")], "url string, taken timestamp, v string")
    got = {(r.url, r.wanted.hour): r.v for r in sites.closest_snapshot(pages, shots, key="url", wanted="wanted", taken="taken", value="v").collect()}
    assert got == {("a", 10): "x", ("a", 1): "x", ("b", 5): None}


def test_link_classes_by_container_target_and_block(spark):
    page = """<body><div id="site-header"><a href="/h">H</a></div><nav><a href="/n">N</a></nav><main><h2><a href="/k">Head</a></h2>
    <p>Some words before <a href="/c">this link</a> and after</p><ul><li><a href="/l">Only link</a></li></ul><p>We say <a href="https://other.org/">there</a> now</p>
    <p>Back to <a href="https://a.org/page">this page</a> here</p><a href="#x">jump</a><a href="mailto:a@b.c">mail</a><a href="/bare">bare</a></main><div class="wrap"><p>Out of it <a href="/t">link</a> it is</p></div>
    <aside><a href="/s">S</a></aside><div class="breadcrumbs"><a href="/b">B</a></div></body>"""
    got = spark.createDataFrame([(page, "https://a.org/page"), (None, "https://a.org/")], "h string, u string").select(structure.link_classes(F.col("h"), F.col("u")).alias("x")).collect()
    assert {x.href: x["class"] for x in got[0].x} == {
        "/h": "header", "/n": "nav", "/k": "heading_link", "/c": "contextual", "/l": "link_list", "https://other.org/": "external", "https://a.org/page": "self_link", "#x": "toc", "mailto:a@b.c": "non_http", "/bare": "other", "/t": "template", "/s": "sidebar", "/b": "breadcrumb",
    } and got[1].x == []


def test_append_merge_keeps_old_rows_first(spark):
    old = spark.createDataFrame([(1, "g2", "h", "one"), (2, "yelp", "k", "two")], "id int, platform string, author_hash string, text string")
    new = spark.createDataFrame([(1, "g2", "h", "changed"), (3, "g2", "h", "one"), (4, "g2", "m", "new")], old.schema)
    kept, counts = reviews.append_merge(old, new, order="id")
    assert sorted((r.id, r.text) for r in kept.collect()) == [(1, "one"), (2, "two"), (4, "new")] and sorted(map(tuple, counts.collect())) == [("g2", 2), ("yelp", 1)]


def test_raw_files_become_reviews_again(spark, tmp_path):
    (tmp_path / "g2.json").write_text('[{"type":"review","review_rating":4,"review_content":"a"},{"type":"review_summary"}]')
    (tmp_path / "reddit.jsonl").write_text('{"dataType":"post","title":"t","body":"b"}\n\n{"dataType":"comment","title":"x","body":"c"}\n')
    got = voice.normalised(files.read_raw(spark, f"file://{tmp_path}")).collect()
    assert sorted((r.platform, r.text, r.title) for r in got) == [("g2", "a", None), ("reddit", "b", "t"), ("reddit", "c", "")]
