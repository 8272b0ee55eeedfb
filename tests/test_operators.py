"""Exact expectations on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cartoloom.functions import pages, text, urls
from cartoloom.operators import evidence, graph, keywords, links, reviews
from cartoloom.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, text.keyword_key(F.lit("  Best “Café’s” ﬁlm_guides! "))) == "best cafés film guides"
    assert one(spark, text.number(F.lit("1,234%"))) == 1234.0 and one(spark, text.number(F.lit("n/a"))) is None
    assert one(spark, text.numbers_in(F.lit("113.4k users, 2 plans"))) == [113400.0, 2.0]
    assert one(spark, text.date_of(F.lit("October 10, 2026"))) == dt.date(2026, 10, 10)
    assert one(spark, text.date_of(F.lit("1700000000000"))) == dt.date(2023, 11, 14)
    assert [one(spark, text.stem_plural(F.lit(w))) for w in ("stories", "class", "links")] == ["story", "class", "link"]
    assert one(spark, text.jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))) == 0.5


@pytest.mark.parametrize("position,rate", [(1, 0.28), (3.5, 0.07), (15, 0.01), (80, 0.002)])
def test_click_rates(spark, position, rate):
    assert one(spark, text.ctr_at(F.lit(float(position)))) == rate


def test_status_and_opportunity(spark):
    m = spark.createDataFrame([("c", 900.0, 2.0), ("c", 100.0, 12.0)], "grp string, demand double, position double")
    row = keywords.cluster_scores(m, group="grp").first()
    assert round(row.position, 6) == 3.0 and row.opportunity == 0.0
    assert round(one(spark, keywords.opportunity(F.lit(1000.0), F.lit(8.0))), 6) == 75.0
    none = F.lit(None).cast("string")
    assert one(spark, keywords.status(F.lit(8.0), F.lit("u"), none, F.lit(False))) == "Striking"
    assert one(spark, keywords.status(F.lit(35.0), F.lit("u"), none, F.lit(False))) == "Underperforming"
    assert one(spark, keywords.status(F.lit(None).cast("double"), none, F.lit("old"), F.lit(False))) == "Lost"


def test_redirect_cycle_and_chain(spark):
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "url string, target string")
    got = {r.url: r.final for r in graph.resolve_redirects(hops).collect()}
    assert got["a"] == "c" and got["b"] == "c" and set(got) == {"a", "b", "x", "y"}


def test_redirects_take_ten_hops_and_stop_in_cycles(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(15)]
    hops = spark.createDataFrame([*chain, ("a", "b"), ("b", "c"), ("c", "a"), ("t", "a"), ("s", "s")], "url string, target string")
    got = {r.url: (r.final, r.hops) for r in graph.resolve_redirects(hops).collect()}
    assert got == {f"n{i}": (f"n{min(15, i + 10)}", min(15, i + 10) - i) for i in range(15)} | {"a": ("a", 3), "b": ("b", 3), "c": ("c", 3), "t": ("a", 4), "s": ("s", 1)}
    short = {r.url: (r.final, r.hops) for r in graph.resolve_redirects(hops, most=3).collect()}
    assert short["n0"] == ("n3", 3) and short["n13"] == ("n15", 2) and short["t"] == ("c", 3)


def test_trend_and_fixes(spark):
    day = dt.date(2026, 10, 12)
    rows = [("p", day - dt.timedelta(days=5))] * 15 + [("p", day - dt.timedelta(days=120))] * 10
    d = spark.createDataFrame(rows, "aspect string, date date")
    assert reviews.trend(d, by=["aspect"], date="date", as_of=F.lit(day)).first().verdict == "rising"


def test_review_dedupe_keeps_anonymous(spark):
    rows = [(1, "g2", "h", "same"), (2, "g2", "h", "same"), (3, "g2", None, "same"), (4, "g2", None, "same"), (1, "g2", "z", "other")]
    d = spark.createDataFrame(rows, "id int, platform string, author_hash string, text string")
    # "other" comes first and takes id 1, so the first row goes by its id and row 2 is the first of its author and text
    got = reviews.dedupe(d, order="text").collect()
    assert sorted((r.id, r.text) for r in got) == [(1, "other"), (2, "same"), (3, "same"), (4, "same")]
    twice = spark.createDataFrame([(1, "g2", "h", "Same  text"), (2, "g2", "h", "same text"), (3, "yelp", "h", "same text")], d.schema)
    assert sorted(r.id for r in reviews.dedupe(twice, order="id").collect()) == [1, 3]


def test_page_parser_and_urls(spark):
    src = '<html><head><title> A &amp; B </title><link rel="canonical" href="https://x.org/"><script type="application/ld+json">{"@graph":[{"@type":["Org","Brand"]}]}</script></head><body><nav><a href="/n">N</a></nav><h1>Top</h1><p>Hi <a href="/p" rel="nofollow">there</a></p></body></html>'
    p = spark.createDataFrame([(src,), (None,)], "h string").select(pages.parse_page("h").alias("p")).collect()[0].p
    assert p.title == "A & B" and p.canonical == "https://x.org/" and p.types == ["Org", "Brand"]
    assert [(x.href, x.area, x.nofollow) for x in p.links] == [("/n", "nav", False), ("/p", "body", True)]
    assert one(spark, urls.bare(F.lit("HTTPS://www.Ex.com/a/?q=1#z"))) == "ex.com/a"
    assert one(spark, urls.registrable(F.lit("https://a.b.co.uk/x"))) == "b.co.uk"


def test_robots_and_lint(spark):
    rules = spark.createDataFrame([("*", "disallow", "/"), ("bot", "disallow", "/x"), ("bot", "allow", "/x/y")], "agent string, kind string, pattern string")
    asked = spark.createDataFrame([("MyBot", "/x/y/z"), ("MyBot", "/x/q"), ("other", "/a")], "agent string, path string")
    got = {(r.agent, r.path): r.allowed for r in evidence.robots_allowed(rules, asked).collect()}
    assert got == {("MyBot", "/x/y/z"): True, ("MyBot", "/x/q"): False, ("other", "/a"): False}
    f = spark.createDataFrame([("a", "c", "critical", "inferred", ["u"], []), ("a", "z", "bad", "absent", [], ["p"])], "id string, category string, severity string, evidence string, sources array<string>, checked array<string>")
    assert {r.rule for r in evidence.findings(f, ["c"]).collect()} == {"duplicate id", "unknown category", "unknown severity", "absent needs two pages checked", "inferred cannot be critical"}


def test_link_selection_budgets(spark):
    rows = [("s", "a", "a", "x", 1, 0.9), ("s", "a", "b", "x", 1, 0.8), ("s", "a", "c", "y", 1, 0.7), ("s", "d", "c", "x", 1, 0.6)]
    d = spark.createDataFrame(rows, "site string, source string, target string, anchor string, sentence int, score double")
    assert [r.drop_reason for r in graph.select_links(d).orderBy(F.desc("score")).collect()] == ["self", None, "sentence used", "anchor owned"]
    assert links.page_degrees(spark.createDataFrame([], "source string, destination string, class string")).count() == 0


def test_exports_and_upsert(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿Keyword\tCountry\tVolume\tKD\tCPC\tCurrent position\tCurrent URL\na \"b\"\tus\t1,000\t5\t0.1\t3\tu\n".encode("utf-16-le"))
    frame = files.read_table(spark, f"file://{p}")
    assert files.detect_export(frame) == "a" and frame.first()["Volume"] == "1,000"
    old = spark.createDataFrame([(1, "x", "kept"), (2, "y", "kept")], "k int, v string, note string")
    new = spark.createDataFrame([(2, "Y", None), (3, "z", None)], "k int, v string, note string")
    assert sorted(map(tuple, files.upsert(old, new, "k", ["note"]).collect())) == [(1, "x", "kept"), (2, "Y", "kept"), (3, "z", None)]
    assert files.digest(old).first() == files.digest(old.orderBy(F.desc("k"))).first()


def test_streaming_counts(spark, tmp_path):
    from cartoloom.streaming import events

    batch = spark.createDataFrame([(dt.datetime(2024, 1, 1, 1), "a", 1.0), (dt.datetime(2024, 1, 1, 2), "a", 2.0)], "ts timestamp, event_type string, value double")
    batch.write.parquet(str(tmp_path / "in"))
    s = events.daily_counts(events.read_events(spark, str(tmp_path / "in"), "ts timestamp, event_type string, value double"))
    q = s.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").first().n == 2
