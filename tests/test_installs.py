"""Policies and installs; keyed state and increments of streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cartoloom.functions import policies
from cartoloom.operators import installs
from cartoloom.streaming import state

URL = "https://news.google.com/swg/js/v1/publisher.js"


@pytest.mark.parametrize("values, script, inline", [
    ([], "no policy", "no policy"), (None, "no policy", "no policy"), (["", " , "], "no policy", "no policy"),
    (["img-src *"], "allows", "allows"), (["default-src 'self'"], "blocks", "may block"), (["default-src *"], "allows", "may block"), (["script-src"], "blocks", "may block"), (["script-src 'none'"], "blocks", "may block"),
    (["script-src https:"], "allows", "may block"), (["script-src http:"], "blocks", "may block"), (["script-src HTTPS://News.Google.com"], "allows", "may block"), (["script-src http://news.google.com:80"], "allows", "may block"), (["script-src *.google.com:*"], "allows", "may block"),
    (["script-src *.news.google.com"], "blocks", "may block"), (["script-src google.com"], "blocks", "may block"), (["script-src news.google.com/swg/"], "allows", "may block"), (["script-src news.google.com/swg"], "blocks", "may block"), (["script-src news.google.com/sw%67/js/v1/publisher.js"], "allows", "may block"),
    (["script-src 'strict-dynamic' https://news.google.com"], "unclear", "may block"), (["default-src 'strict-dynamic'"], "blocks", "may block"), (["script-src-elem *; script-src 'none'"], "allows", "may block"), (["SCRIPT-SRC *; script-src 'none'"], "allows", "may block"),
    (["script-src * 'unsafe-inline'"], "allows", "allows"), (["script-src * 'unsafe-inline' 'nonce-abc'"], "allows", "may block"), (["script-src *, default-src 'none'"], "blocks", "may block"), (["script-src *", "script-src 'strict-dynamic'"], "unclear", "may block"), (["script-src 'sha256-xyz' 'UNSAFE-INLINE'"], "blocks", "may block"),
])
def test_policies(spark, values, script, inline):
    row = spark.createDataFrame([(values,)], "v array<string>").select(policies.policies(F.col("v")).alias("p")).select(policies.verdict(F.col("p"), "script", F.lit(URL)).alias("s"), policies.inline_verdict(F.col("p")).alias("i")).first()
    assert (row.s, row.i) == (script, inline)


def test_source_expressions_against_addresses(spark):
    rows = [("*", "ftp://a.org/", False), ("ftp:", "ftp://a.org/", True), ("https://a.org", "http://a.org/", False), ("a.org/x", "https://a.org/x?q=1", True), ("*", "https://a.org", True), ("a b", "https://a.org", False), ("*.org", "https://a.org/", True), ("https://*", "https://q.net/z", True)]
    got = spark.createDataFrame(rows, "s string, u string, w boolean").select("w", policies.source_matches(F.col("s"), F.col("u")).alias("g")).collect()
    assert [r.g for r in got] == [r.w for r in got]


BUTTON, CALL = f"<div {installs.BUTTON}></div>", "<script>(self.PREFERRED_SOURCE = self.PREFERRED_SOURCE || []).push(s => s.addPreferredSource('a'))</script>"
SCRIPT, WORDS = f'<script async src="{URL}"></script>', "<p>" + "word " * 200 + "</p>"


def page(head="", body=""):
    return f"<html><head>{head}</head><body>{body}{WORDS}</body></html>"


@pytest.mark.parametrize("html, headers, status, names", [
    (page(SCRIPT, BUTTON), None, "pass", []),
    (page(SCRIPT.replace(" async", " defer"), BUTTON), [], "pass", []),
    (page(SCRIPT.replace(" async", ""), BUTTON), None, "warn", ["script not asynchronous"]),
    (page("", SCRIPT + SCRIPT + BUTTON), None, "warn", ["script loaded again", "script in the body"]),
    (page(SCRIPT), None, "fail", ["script without anything to show"]),
    (page(SCRIPT + BUTTON), None, "fail", ["button in the head"]),
    (page("", BUTTON), None, "fail", ["button without script"]),
    (page(f'<link rel="preload" href="{URL}">', BUTTON), None, "needs browser", ["script named by a loader"]),
    (page(SCRIPT, BUTTON.replace("></div>", ' data-theme="pink"></div>')), None, "warn", ["unknown theme"]),
    (page(SCRIPT, BUTTON), ["script-src 'self'"], "fail", ["policy blocks the script"]),
    (page(SCRIPT, BUTTON), ["script-src 'strict-dynamic'; frame-src *; connect-src *"], "warn", ["policy may block the script"]),
    (page(SCRIPT + '<meta http-equiv="Content-Security-Policy" content="connect-src a.org">', BUTTON), None, "warn", ["policy may block the frame"]),
    (page(SCRIPT, CALL), ["script-src *; frame-src *; connect-src *"], "warn", ["policy may block inline code"]),
    (page(SCRIPT.replace("async", f'async {installs.MANUAL}="manual"'), BUTTON), None, "fail", ["manual mode without a call", "manual mode and a button"]),
    (page("", CALL), None, "fail", ["manual code without script"]),
    (page("", '<a href="https://google.com/preferences/source/?q=a.org">x</a>'), None, "pass", ["link differs by www"]),
    (page("", '<a href="https://google.com/preferences/source?q=www.a.org">x</a>'), None, "pass", []),
    (page("", '<a href="https://google.com/preferences/source?q=https%3A%2F%2Fwww.a.org%2Fblog">x</a>'), None, "fail", ["link names a path"]),
    (page("", '<a href="https://google.com/preferences/source?q=b.org">x</a>'), None, "fail", ["link names another site"]),
    (page(SCRIPT, '<a href="https://google.com/preferences/source?q=www.a.org">x</a>'), None, "warn", ["script not needed"]),
    (page("", f'<a class="b {installs.CUSTOM}" href="https://google.com/preferences/source?q=www.a.org">x</a>'), None, "warn", ["custom button without script"]),
    (page("", '<a href="https://google.com/preferences/source">x</a>'), None, "fail", ["nothing found", "link to the tool alone"]),
    (page("<script type='module'>import {x} from 'https://news.google.com/swg/js/v1/publisher.mjs'</script>", BUTTON), None, "pass", []),
    (page(), None, "fail", ["nothing found"]), (None, None, "fail", ["nothing found"]), ('<body><div id="root"></div></body>', None, "needs browser", ["drawn by the browser"]),
    (page("", f"<pre>&lt;script src={URL}&gt;</pre>"), None, "fail", ["nothing found"]),
])
def test_installs(spark, html, headers, status, names):
    d = spark.createDataFrame([(1, "https://www.a.org/page", html, headers)], "k int, url string, html string, policies array<string>")
    row = installs.install_verdicts(d, key="k").first()
    assert (row.status, [f.name for f in row.findings]) == (status, names)


def test_pages_that_must_have_none(spark):
    rows = [(1, page()), (2, page(SCRIPT)), (3, page("", f"<script>load('{URL}')</script>")), (4, "<body><div id='app'></div></body>")]
    d = spark.createDataFrame([(k, "https://a.org/", h, None) for k, h in rows], "k int, url string, html string, policies array<string>")
    got = installs.absence_verdicts(installs.install_verdicts(d, key="k"), installs.install_facts(d), key="k").collect()
    assert {r.k: r.status for r in got} == {1: "pass", 2: "fail", 3: "needs browser", 4: "needs browser"}


# --- streams


def run(stream, folder, name, mode="update"):
    rows = []
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).foreachBatch(lambda d, n: rows.extend((n, *r) for r in d.collect())).start()
    assert q.awaitTermination(120)
    return rows


def test_latest_answers_in_any_order_and_after_a_restart(spark, tmp_path):
    rng = random.Random(3)
    at = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    rows = [(f"k{rng.randrange(4)}", at(rng.randrange(60)), f"v{rng.randrange(5)}") for _ in range(80)] + [("k9", None, "x"), ("k0", at(70), None)]
    schema = "k string, at timestamp, v string"
    source, last = f"{tmp_path}/in", {}
    for n in range(4):
        spark.createDataFrame(rows[n * 21 : (n + 1) * 21], schema).coalesce(1).write.mode("append").parquet(source)
        stream = state.latest_answers(spark.readStream.schema(schema).parquet(source), keys=["k"], at="at", value="v")
        for _, k, t, v, seen in run(stream, tmp_path, "latest"):  # a new query on the old checkpoint each time
            assert k not in last or (t, v) > last[k]
            last[k] = (t, v)
        twin = state.latest_batch(spark.read.parquet(source), keys=["k"], at="at", value="v").collect()
        assert last == {r.k: (r["at"], r.v) for r in twin}


def test_changed_pages_come_once_and_runs_again_replace_their_own(spark, tmp_path):
    schema = "url string, seen_at int, html string"
    source, folder = f"{tmp_path}/in", f"{tmp_path}/pages"
    html = lambda text, frame="f": f"<nav>{frame}</nav><h1>T</h1><h2>A</h2><p>{text}</p>"
    batches = [
        [("a", 1, html("one")), ("b", 1, html("two")), (None, 1, html("none"))],
        [("a", 2, html("one", "other frame")), ("b", 2, html("new")), ("b", 3, html("newer")), ("c", 1, None)],
        [("b", 4, html("two")), ("a", 3, html("one"))],
        [],
    ]
    seen = []
    for rows in batches:
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        step = state.changed_pages(stream, folder)
        q = stream.writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(step).start()
        assert q.awaitTermination(120)
        seen.append(sorted((r.batch, r.url) for r in spark.read.parquet(folder).select("batch", "url").collect()))
    assert seen[0] == [(0, "a"), (0, "b")] and seen[1] == seen[0] + [(1, "b"), (1, "c")] and seen[2] == seen[1] + [(2, "b")] == seen[3]
    last = {r.url: r.digest for r in state.known_pages(spark, folder).collect()}
    again = state.changed_pages(stream, folder)
    again(spark.createDataFrame(batches[1], schema), 1)  # as after a failure
    assert sorted((r.batch, r.url) for r in spark.read.parquet(folder).select("batch", "url").collect()) == seen[3]
    assert {r.url: r.digest for r in state.known_pages(spark, folder).collect()} == last
    with pytest.raises(ValueError):
        state.changed_pages(spark.createDataFrame([], "url string"), folder)
