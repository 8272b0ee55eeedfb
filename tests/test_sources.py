"""Calls, sinks and document functions."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from cartoloom.functions import documents
from cartoloom.sources import calls, reports


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_retries_limits_and_gates():
    slept, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise calls.RetryError("busy", after=7.0 if len(tries) == 1 else None)
        return "ok"

    assert calls.retried(flaky, sleep=slept.append) == "ok" and slept[0] == 7.0 and 1.0 <= slept[1] <= 3.0
    with pytest.raises(calls.QuotaError):
        calls.retried(lambda: (_ for _ in ()).throw(calls.QuotaError("no credit")))
    now = [0.0]
    limit = calls.RateLimiter(2, 60, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(5):
        limit.wait()
    assert now[0] == 120.0
    got = calls.ordered_map(lambda x: 1 // x, [1, 0, 2])
    assert got[0] == 1 and isinstance(got[1], ZeroDivisionError) and got[2] == 0
    with pytest.raises(PermissionError):
        calls.within_budget(2.0, 1.0)
    calls.within_budget(2.0, 2.0)
    assert list(calls.paged(lambda o, n: list(range(o, min(o + n, 25))), size=10)) == list(range(25))
    states = iter(["RUNNING", "RUNNING", "SUCCEEDED"])
    assert calls.awaited(lambda: next(states), sleep=lambda s: None) == "SUCCEEDED"
    with pytest.raises(RuntimeError):
        calls.awaited(lambda: "RUNNING", most=10, sleep=lambda s: None)


def test_settings_and_documents(tmp_path):
    assert calls.deep_merge({"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"b": 3}, "d": [2]}) == {"a": {"b": 3, "c": 2}, "d": [2]}
    calls.merged_metadata(tmp_path / "m.json", a=1)
    assert calls.merged_metadata(tmp_path / "m.json", b=[2]) == calls.read_document(tmp_path / "m.json") == {"a": 1, "b": [2]}
    with pytest.raises(FileNotFoundError):
        calls.read_document(tmp_path / "none.json")
    for k in (2, 10):
        (tmp_path / "brain" / f"run-{k}").mkdir(parents=True)
    assert calls.run_folder(tmp_path, "run").name == "run-10" and calls.run_folder(tmp_path, "other").name == "other-1"
    rows = calls.registry_rows({"primary": [{"id": "x", "endpoint": "e", "param": "q", "extra_params": {"b": 2, "a": 1}, "default_enabled": True}], "version": 3})
    assert rows == [("primary", "x", "x", "e", "q", "a=1&b=2", True)]


def test_cached_calls_and_pages(spark, tmp_path):
    asked = spark.createDataFrame([("p1",), ("p1",), ("p2",), ("bad",)], "payload string")
    cache = asked.where("payload = 'p2'").select(F.sha2("payload", 256).alias("key"))
    open_ = calls.missing_answers(asked, cache)
    assert sorted(r.payload for r in open_.collect()) == ["bad", "p1"]

    def call(text):
        if text == "bad":
            raise ValueError("no")
        return text.upper()

    got = {r.answer: r.error for r in calls.answered(open_, call).collect()}
    assert got == {"P1": None, None: "ValueError: no"}
    assert calls.dry_run(asked, str(tmp_path / "dry"), price=0.5) == {"requests": 4, "cost": 2.0}

    def transport(url):
        return (301, "", {"location": "/b"}) if url.endswith("/a") else (200, "body " + url, {})

    page = calls.fetched(spark.createDataFrame([("http://x/a",)], "url string"), transport).first()
    assert (page.status, page.final, page.hops, page.body) == (200, "http://x/b", 1, "body http://x/b")
    raw = spark.createDataFrame([(1, '{"output_text":"hi","sources":["u"],"usage":{"cost":0.5}}'), (2, '{"choices":[{"message":{"content":"yo"}}],"error":{"message":"x"}}')], "id int, body string")
    a, b = calls.normalised_answers(raw).orderBy("id").collect()
    assert (a.answer, a.citations, a.cost, a.error) == ("hi", '["u"]', 0.5, None) and (b.answer, b.error) == ("yo", "x")
    serp = spark.createDataFrame([("k", '{"organic":[{"rank":2,"url":"b"},{"rank":1,"url":"a"},{"rank":3,"url":"a"},{"rank":99,"url":"z"}]}')], "k string, body string")
    assert sorted((r.url, r["rank"]) for r in calls.organic(serp, key="k").collect()) == [("a", 1), ("b", 2)]
    v = calls.embedded(spark.createDataFrame([(1, "x"), (2, "")], "id int, text string"), lambda ts: [[3.0, 4.0] if t else [0.0, 0.0] for t in ts], key="id", text="text").orderBy("id").collect()
    assert v[0].vector == [0.6, 0.8] and v[1].vector == [0.0, 0.0]


def test_workbook_document_and_csv(spark, tmp_path):
    t = spark.createDataFrame([("a, \"b\"", 1, True), ("é\nx", None, False)], "name string, n int, ok boolean")
    reports.write_spreadsheet_csv(t, str(tmp_path / "t.csv"), ["name", "n"])
    assert (tmp_path / "t.csv").read_bytes() == b'\xef\xbb\xbfname,n\r\n"a, ""b""",1\r\n' + '"é\nx",\r\n'.encode()
    for name in ("one", "two"):
        reports.write_workbook(str(tmp_path / f"{name}.xlsx"), {"T & U": t, "Ice": [("I", "C", "E"), (8, 6, 2)]}, choices={"T & U": {"B2:B9": ["Yes", "No"]}}, formulas={"Ice": {"D2": "A2*B2/C2"}})
    assert (tmp_path / "one.xlsx").read_bytes() == (tmp_path / "two.xlsx").read_bytes()
    assert reports.read_workbook(str(tmp_path / "one.xlsx"), "T & U") == [["name", "n", "ok"], ["a, \"b\"", "1", "1"], ["é\nx", None, "0"]]
    assert "<f>A2*B2/C2</f>" in zipfile.ZipFile(tmp_path / "one.xlsx").read("xl/worksheets/sheet2.xml").decode()
    reports.write_workbook(str(tmp_path / "v.xlsx"), {"S": [("Claim", "x", "Verdict"), ("c1", None, "yes"), ("c2", "y", None)]})
    assert [tuple(r) for r in reports.verdicts(spark, str(tmp_path / "v.xlsx"), "S").collect()] == [("c1", "yes")]
    first = reports.write_document(str(tmp_path / "d.docx"), ["Dear [Name], see {{COMMENT: check}} & [REVIEW: x]", ""])
    second = reports.write_document(str(tmp_path / "d.docx"), [])
    assert first.endswith("d.docx") and second.endswith("d-v2.docx")
    z = zipfile.ZipFile(first)
    assert z.read("word/document.xml").decode().count("highlight") == 2 and "check" in z.read("word/comments.xml").decode()
    assert reports.markdown_table(t, ["name"]) == '| name |\n|---|\n| a, "b" |\n| é x |\n'
    fragment, schema = reports.faq_page([("A < B?", "Yes </script>")])
    assert "&lt;" in fragment and "</script>" not in schema and json.loads(schema)["mainEntity"][0]["name"] == "A < B?"


def test_files_by_page_checklist_and_client_columns(spark, tmp_path):
    p = spark.createDataFrame([("post", "a", ["x"]), ("post", "b", None), ("home", "c", [])], "kind string, name string, blocks array<string>")
    reports.write_by_file(p, str(tmp_path / "out"), group="kind", name="name", blocks="blocks")
    got = {(r.kind, r.name): r.value for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert got == {("post", "a"): '["x"]', ("post", "b"): "[]", ("home", "c"): "[]"}
    reports.write_jsonl(p, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 3
    c = spark.createDataFrame([("s1", "open", False, None), ("s2", "open", False, None)], "skill string, status string, done boolean, date string")
    assert sorted((r.skill, r.status, r.date) for r in reports.ticked(c, "s2", date="2026-01-02").collect()) == [("s1", "open", None), ("s2", "done", "2026-01-02")]
    with pytest.raises(Exception, match="no row"):
        reports.ticked(c, "s9", date="x").collect()
    fresh = spark.createDataFrame([("q1", "new", None), ("q2", "new", None)], "q string, a string, verdict string")
    old = spark.createDataFrame([("q1", "old", "ok"), ("q3", "old", "no")], "q string, a string, verdict string")
    assert sorted(map(tuple, reports.keep_client_columns(fresh, old, keys=["q"], columns=["verdict"]).collect())) == [("q1", "new", "ok"), ("q2", "new", None)]
    f = spark.createDataFrame([("run-2/a.md", "x " * 9), ("run-10/a.md", "y " * 9), ("run-10/a.md", "y " * 9), ("voice-1/v.md", "z " * 9)], "path string, content string")
    b = {r.path: (r.truncated, len(r.content.split())) for r in reports.bundle(f, cap=4).collect()}
    assert b == {"run-10/a.md": (True, 4), "voice-1/v.md": (False, 9)}


def test_document_functions(spark):
    assert one(spark, documents.percent(F.lit(0.456), 1)) == "45.6%" and one(spark, documents.percent(F.lit(None).cast("double"))) == "-" and one(spark, documents.grouped(F.lit(1234567))) == "1,234,567"
    doc = '{"@graph":[{"@type":"Org","r":{"@type":["AggregateRating"],"ratingValue":"4.5","reviewCount":12}},{"@type":"Page"}]}'
    d = spark.createDataFrame([(doc,), ("no json",), (None,), ("[]",), ("",)], "d string")
    r = d.select(documents.objects("d").alias("o"), documents.described("d").alias("k")).collect()
    assert len(r[0].o) == 4 and r[1].o == [] and [x.k for x in r] == ["@graph(Org+Page)", "UNPARSED", "EMPTY", "", "EMPTY"]
    assert tuple(d.limit(1).select(documents.rating_of(documents.objects("d")).alias("x")).first().x) == (4.5, 12)
    assert tuple(one(spark, documents.page_stats(F.lit("Rated 4.6 out of 5 from 1,204 reviews")))) == (4.6, 1204)
    text = "# A\n\n<!-- bucket: x; sources: a, b -->\n\nHello\nthere\n\n| a |\n|---|\n## B"
    blocks = one(spark, documents.markdown_blocks(F.lit(text)))
    assert [(b.kind, b.level) for b in blocks] == [("heading", 1), ("comment", 0), ("paragraph", 0), ("table", 0), ("heading", 2)]
    assert one(spark, documents.metadata(F.lit(blocks[1].text))) == {"bucket": "x", "sources": "a, b"}
    clean = [one(spark, documents.cleanly_in(F.lit(t), F.lit("Big Co"))) for t in ("the Big Co.", "aboutBig CoHome", "aBig Cox", "big cost")]
    assert clean == [True, True, False, False]
    assert [one(spark, documents.judged(F.lit(x), "p")) for x in ('{"p":0.4}', '{"p":7}', "{}")] == [0.4, None, None]
    assert [one(spark, documents.polarity(F.lit(x))) for x in (0.0, 2.4, 9.0)] == [-2, 0, 2]
    assert one(spark, documents.filled(F.lit("Hi {a}, {b}"), {"a": F.lit("x"), "b": F.lit(3)})) == "Hi x, 3" and one(spark, documents.filled(F.lit("{b}"), {"b": F.lit(None).cast("int")})) is None
    assert one(spark, documents.request("s", b=F.lit(1), a=F.lit("x"))) == '{"a":"x","b":1,"system":"s"}'
