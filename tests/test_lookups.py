"""Passages word for word, sitemaps of sites, and BM25 against plain versions."""

import collections
import datetime as dt
import math
import random

from pyspark.sql import functions as F

from cartoloom.operators import claims, evidence, search, sites


def test_passages_word_for_word(spark):
    rng = random.Random(4)
    words = "a bb ccc the quick Brown fox, jumps over.\n lazy dogs  now".split(" ")
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(80)] + [(90, None), (91, ""), (92, "xy")]
    passages = []
    for k in range(120):
        text = rng.choice(docs[:80])[1]
        lo = rng.randrange(len(text) + 1)
        passages.append((k, text[lo : lo + rng.choice((0, 1, 2, 3, 9, 25, 60, 90))] if rng.random() < 0.8 else " ".join(rng.choices(words, k=9))))
    passages += [(200, None), (201, "absent zz"), (202, "xyz"), (203, "y")]
    got = evidence.verbatim(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, text string"), doc_key="doc_id", key="item_id")
    want = sorted((p, d) for p, said in passages for d, text in docs if said and text and said in text)
    assert sorted((r.item_id, r.doc_id) for r in got.collect()) == want and len(want) > 500
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_sitemaps_of_sites_in_order(spark):
    page = lambda *urls: "<urlset>" + "".join(f"<url><loc> {u} </loc></url>" for u in urls) + "</urlset>"
    index = lambda *urls: "<sitemapindex>" + "".join(f"<loc>{u}</loc>" for u in urls) + "</sitemapindex>"
    files = [
        ("https://a.org/own.xml", index("https://a.org/tag.xml", "https://a.org/z.xml", "https://a.org/image.xml", "https://a.org/own.xml")), ("https://a.org/tag.xml", page("https://a.org/t", "https://a.org/1")),
        ("https://a.org/z.xml", page("https://a.org/2?x=1&amp;y=2", "https://a.org/1")), ("https://a.org/image.xml", page("https://a.org/no")), ("https://a.org/sitemap.xml", page("https://a.org/usual")),
        ("https://b.org/wp-sitemap.xml", page(*[f"https://b.org/{k}" for k in range(9)])), ("https://c.org/other.xml", page("https://c.org/x")),
    ]
    robots = [("a", "https://a.org/", "User-agent: *\n  SITEMAP: https://a.org/own.xml\nx"), ("b", "https://b.org", None), ("c", "https://c.org/", "")]
    got = sites.site_pages(spark.createDataFrame(robots, "site string, root string, robots string"), spark.createDataFrame(files, "url string, xml string"), most=5)
    rows = collections.defaultdict(list)
    for r in got.orderBy("site", "place").collect():
        rows[r.site].append(r.url)
    assert rows == {"a": ["https://a.org/usual", "https://a.org/2?x=1&y=2", "https://a.org/1", "https://a.org/t"], "b": [f"https://b.org/{k}" for k in range(5)]}


def test_bm25_against_the_formula(spark):
    rng = random.Random(6)
    docs = [(k, rng.choices("abcdefg", k=rng.randint(0, 12))) for k in range(40)]
    asked = [(q, rng.choices("abcxyz", k=rng.randint(0, 5))) for q in range(12)]
    n, mean = len(docs), sum(len(w) for _, w in docs) / len(docs)
    df = collections.Counter(t for _, w in docs for t in set(w))
    want = []
    for q, terms in asked:
        scores = []
        for d, w in docs:
            s = sum((1 + math.log(c)) * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, c in collections.Counter(terms).items() if w.count(t))
            if s > 0:
                scores.append((-round(s, 6), d))
        want += [(q, d, -s, k + 1) for k, (s, d) in enumerate(sorted(scores)[:5])]
    got = search.bm25(spark.createDataFrame(docs, "d long, words array<string>"), spark.createDataFrame(asked, "q long, words array<string>"), doc_key="d", query_key="q", k=5)
    assert sorted((r.q, r.d, round(r.score, 5), r["rank"]) for r in got.collect()) == sorted((q, d, round(s, 5), k) for q, d, s, k in want)
    assert got._jdf.queryExecution().toString().count("LocalTableScan") <= 4  # the documents are not read again
    none = search.bm25(spark.createDataFrame([], "d long, words array<string>"), spark.createDataFrame(asked, "q long, words array<string>"), doc_key="d", query_key="q")
    assert none.count() == 0


def test_robots_groups_of_sites(spark):
    files = [("a", "Disallow: /early\nUser-agent: One\nUser-Agent: two # here\nDisallow: /x\nAllow: /x/y\nSitemap: s\nUser-agent: *\nDisallow: /\nUser-agent: three"), ("b", None), ("c", "User-agent: *\nDisallow: /p*.html$")]
    rules = evidence.robots_groups(spark.createDataFrame(files, "site string, robots string"), by=["site"])
    asked = [("a", who, path) for who in ("OneBot", "two", "three", "other") for path in ("/x/1", "/x/y/2", "/early", "/")] + [("b", "OneBot", "/x/1"), ("c", "any", "/page.html"), ("c", "any", "/page.html?x")]
    got = {(r.site, r.agent, r.path): r.allowed for r in evidence.robots_allowed(rules, spark.createDataFrame(asked, "site string, agent string, path string"), by=["site"]).collect()}
    shut = {(s, w, p) for s, w, p in asked if (s == "a" and w in ("OneBot", "two") and p == "/x/1") or (s == "a" and w == "other") or (s == "c" and p == "/page.html")}
    assert got == {x: x not in shut for x in asked}


def test_live_checks(spark):
    good = "<title>T</title><link rel=canonical href='https://a.org/info/'><script type='application/ld+json'>{\"@type\": [\"Organization\"]}</script><p>Acme</p>" + "word " * 301 + "<p><strong>Last updated:</strong> <time datetime=x>April 2026</time></p>"
    schema = "k int, site string, url string, final string, status int, html string, robots_header string"
    pages = [(1, "a", "https://a.org/info", "https://a.org/info/", 200, good, None), (2, "a", "https://a.org/old", None, 404, "<meta name=robots content='noindex'>Last updated: Smarch 2026", ""), (3, "z", "https://z.org", None, 200, None, "x-noindex")]
    sites_ = [("a", "User-agent: *\nDisallow: /old", "see /info")]
    run = lambda brand: claims.live_checks(spark.createDataFrame(pages, schema), spark.createDataFrame(sites_, "site string, robots string, llms string"), spark.createDataFrame([("a", "https://a.org/info/")], "site string, url string"), spark.createDataFrame([("a", "https://a.org/info#x")], "site string, href string"), key="k", as_of=F.lit(dt.date(2026, 9, 1)), brand=brand).collect()
    got = run("acme")
    assert len(got) == 33 and all(r.ok for r in got if r.k == 1) and {r.name for r in got if r.optional} == {"in llms.txt"}
    assert {r.name for r in got if r.k == 2 and r.ok} == {"canonical"} and {r.name for r in got if r.k == 3 and r.ok} == {"answers", "canonical", "lets crawlers in"}
    assert len(run(None)) == 30
