"""Whether a page has a third party's button installed: facts of its elements, rules over them, the worst finding decides."""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from cartoloom.functions import policies

# What marks the button, its script, its manual mode and its links; what an application shell looks like.
BUTTON, CUSTOM, MANUAL = "google-add-preferred-source-btn", "js-preferred-source", "preferred-sources-control"
SCRIPT_URL, FRAME_URL = "https://news.google.com/swg/js/v1/publisher.js", "https://news.google.com/"
SCRIPT = r"(?i)news\.google\.com/swg/js/v1/publisher\.(m?js)"
MODULE = r"['\"]https://news\.google\.com/swg/js/v1/publisher\.mjs['\"]"
LINK_HOSTS, LINK_PATH = ("google.com", "www.google.com"), "/preferences/source"
SHELL = r"(?i)id=[\"'](?:root|app|__next|__nuxt)[\"']"


class _Elements(HTMLParser):
    """Scripts, links, metas and marked elements of a page, whether each is in its head, and the words outside."""

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.words, self.head, self.silent = 0, False, 0
        self.script: list[str] | None = None
        self.feed(source)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = {k.lower(): v or "" for k, v in attrs}
        self.head = tag == "head" or (self.head and tag != "body")
        if tag in ("script", "meta") or (tag in ("a", "link") and own.get("href")) or BUTTON in own:
            text: list[str] = []
            self.rows.append({"tag": tag, "attrs": own, "head": self.head, "text": text})
            if tag == "script":
                self.script = text
        self.silent += tag in ("style", "noscript", "template")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag == "script":
            self.script = None

    def handle_endtag(self, tag: str) -> None:
        self.head = self.head and tag != "head"
        if tag == "script":
            self.script = None
        elif tag in ("style", "noscript", "template"):
            self.silent = max(0, self.silent - 1)

    def handle_data(self, data: str) -> None:
        if self.script is not None:
            self.script.append(data)
        elif not self.silent and not self.head:
            self.words += len(data.split())


_ELEMENT = T.StructType().add("tag", T.StringType()).add("attrs", T.MapType(T.StringType(), T.StringType())).add("head", T.BooleanType()).add("text", T.StringType())


@pandas_udf(T.StructType().add("elements", T.ArrayType(_ELEMENT)).add("words", T.IntegerType()))
def page_elements(source: pd.Series) -> pd.DataFrame:
    """The elements that rules ask about, and a page's words."""
    parsed = [_Elements(s or "") for s in source]
    return pd.DataFrame({"elements": [[r | {"text": "".join(r["text"])} for r in p.rows] for p in parsed], "words": [p.words for p in parsed]})


@dataclass
class Rules:
    """Findings in order: level, name, condition."""

    rows: list[tuple[str, str, Column]] = field(default_factory=list)

    def add(self, level: str, name: str, when: Column) -> None:
        self.rows.append((level, name, F.coalesce(when, F.lit(False))))

    def findings(self) -> Column:
        return F.array_compact(F.array(*[F.when(c, F.struct(F.lit(level).alias("level"), F.lit(name).alias("name"))) for level, name, c in self.rows]))


def install_facts(pages: DataFrame, *, source: str = "html", url: str = "url", headers: str = "policies") -> DataFrame:
    """The pages' columns with the facts that rules read: scripts, buttons, links, inline code, verdicts of all policies."""
    el = lambda test: F.filter("_p.elements", test)
    at = lambda e, name: F.coalesce(F.try_element_at(e["attrs"], F.lit(name)), F.lit(""))
    has = lambda e, name: F.map_contains_key(e["attrs"], name)
    hits = lambda text, pattern: F.size(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))
    rows = pages.withColumn("_p", page_elements(F.col(source)))
    rows = rows.withColumns({
        "_scripts": el(lambda e: e["tag"] == "script"), "buttons": el(lambda e: has(e, BUTTON)), "words": F.col("_p.words"),
        "_links": F.array_distinct(F.transform(el(lambda e: e["tag"] == "a"), lambda e: F.struct(at(e, "href").alias("href"), F.array_contains(F.split(at(e, "class"), r"\s+"), CUSTOM).alias("custom")))),
        "_meta": F.transform(el(lambda e: (e["tag"] == "meta") & (F.lower(at(e, "http-equiv")) == "content-security-policy")), lambda e: at(e, "content")),
        "_hrefs": F.array_join(F.transform(el(lambda e: e["tag"] == "link"), lambda e: at(e, "href")), " "),
    })
    rows = rows.withColumn("tags", F.filter("_scripts", lambda e: F.rlike(at(e, "src"), F.lit(SCRIPT)))).withColumn("inline", F.array_join(F.transform(F.filter("_scripts", lambda e: at(e, "src") == ""), lambda e: e["text"]), "\n"))
    inline = F.col("inline")
    modules = hits(inline, rf"import\b[^;]*?{MODULE}") + hits(inline, rf"import\(\s*{MODULE}")
    rows = rows.withColumn("modules", modules).withColumn("mentions", F.greatest(F.lit(0), hits(F.concat_ws(" ", "inline", "_hrefs"), SCRIPT.replace("(m?js)", "m?js")) - F.col("modules")))
    host = lambda u: F.lower(F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit("")))
    www = lambda h: F.regexp_replace(h, r"^www\.", "")
    own = host(F.col(url))

    def link(l: Column) -> Column:
        q = F.trim(F.coalesce(F.try_url_decode(F.try_parse_url(F.trim(l["href"]), F.lit("QUERY"), F.lit("q"))), F.lit("")))
        full = F.when(F.rlike(q, F.lit("(?i)^[a-z]+://")), q).otherwise(F.concat(F.lit("https://"), q))
        deep = F.coalesce(F.try_parse_url(full, F.lit("PATH")), F.lit("")).isin("", "/") & F.try_parse_url(full, F.lit("QUERY")).isNull()
        there = F.coalesce(host(F.trim(l["href"])).isin(*LINK_HOSTS) & (F.regexp_replace(F.try_parse_url(F.trim(l["href"]), F.lit("PATH")), "/+$", "") == LINK_PATH), F.lit(False))
        return F.struct(l["href"].alias("href"), l["custom"].alias("custom"), there.alias("there"), q.alias("q"), (~deep).alias("path"), ((own != "") & (host(full) != own)).alias("other"), ((own != "") & (www(host(full)) != www(own))).alias("foreign"))

    rows = rows.withColumn("_links", F.filter(F.transform("_links", link), lambda l: l["there"]))
    rows = rows.withColumns({"links": F.filter("_links", lambda l: l["q"] != ""), "tool_links": F.filter("_links", lambda l: l["q"] == "")})
    rows = rows.withColumns({
        "queue": F.rlike(inline, F.lit(r"\bPREFERRED_SOURCE\b")), "add_call": F.rlike(inline, F.lit(r"\baddPreferredSource\s*\(")), "scripts": F.size("tags") + F.col("modules"),
        "manual": F.exists("tags", lambda e: F.lower(at(e, MANUAL)) == "manual"), "blocking": F.exists("tags", lambda e: ~has(e, "async") & ~has(e, "defer") & (F.lower(at(e, "type")) != "module")), "below": F.exists("tags", lambda e: ~e["head"]),
        "shell": (F.col("words") < 150) & (F.rlike(F.coalesce(F.col(source), F.lit("")), F.lit(SHELL)) | (F.size("_scripts") >= 5)),
        "_policies": policies.policies(F.concat(F.coalesce(F.col(headers), F.array().cast("array<string>")), F.col("_meta"))),
    })
    target = {"script": SCRIPT_URL, "frame": FRAME_URL, "connect": FRAME_URL}
    rows = rows.withColumns({f"csp_{k}": policies.verdict(F.col("_policies"), k, F.lit(u)) for k, u in target.items()} | {"csp_inline": policies.inline_verdict(F.col("_policies"))})
    return rows.drop("_p", "_scripts", "_links", "_meta", "_hrefs", "_policies")


def install_rules() -> Rules:
    """Every finding about a page's facts, errors first."""
    c, r = F.col, Rules()
    some = lambda name: F.size(name) > 0
    theme = lambda e: F.lower(F.coalesce(F.try_element_at(e["attrs"], F.lit("data-theme")), F.lit("")))
    installed, code = c("scripts") > 0, c("queue") | c("add_call")
    r.add("error", "link names a path", F.exists("links", lambda l: l["path"]))
    r.add("error", "link names another site", F.exists("links", lambda l: l["foreign"]))
    r.add("error", "button in the head", F.exists("buttons", lambda e: e["head"]))
    r.add("error", "script without anything to show", installed & ~some("buttons") & ~some("links") & ~code)
    r.add("error", "button without script", some("buttons") & ~installed & (c("mentions") == 0))
    r.add("error", "manual mode without a call", c("manual") & ~c("add_call"))
    r.add("error", "manual code without script", code & ~installed & (c("mentions") == 0))
    r.add("error", "policy blocks the script", installed & (c("csp_script") == "blocks"))
    r.add("error", "nothing found", ~installed & ~some("buttons") & ~some("links") & ~code & ~c("shell") & (c("mentions") == 0))
    r.add("warning", "script loaded again", c("scripts") > 1)
    r.add("warning", "script not asynchronous", c("blocking"))
    r.add("warning", "unknown theme", F.exists("buttons", lambda e: ~theme(e).isin("", "light", "dark")))
    r.add("warning", "script not needed", installed & ~some("buttons") & some("links") & ~code)
    r.add("warning", "custom button without script", F.exists("links", lambda l: l["custom"]) & ~(installed & code))
    r.add("warning", "policy may block the script", installed & (c("csp_script") == "unclear"))
    r.add("warning", "policy may block inline code", code & (c("csp_inline") == "may block"))
    r.add("warning", "policy may block the frame", installed & ((c("csp_frame") == "blocks") | (c("csp_connect") == "blocks")))
    r.add("note", "link to the tool alone", some("tool_links"))
    r.add("note", "link differs by www", F.exists("links", lambda l: l["other"] & ~l["foreign"]))
    r.add("note", "script in the body", c("below"))
    r.add("note", "script named by a loader", some("buttons") & ~installed & (c("mentions") > 0))
    r.add("note", "manual mode and a button", c("manual") & some("buttons"))
    r.add("note", "drawn by the browser", ~installed & ~some("buttons") & ~some("links") & ~code & c("shell"))
    return r


def install_verdicts(pages: DataFrame, *, key: str, source: str = "html", url: str = "url", headers: str = "policies") -> DataFrame:
    """``key, status, findings, csp_script, csp_frame, csp_connect, csp_inline`` of every page.

    Any error fails; what only a browser can tell needs one; any warning warns; else the page passes.  Null pages are
    empty ones, null policies none.
    """
    facts = install_facts(pages, source=source, url=url, headers=headers).withColumn("findings", install_rules().findings())
    any_ = lambda level: F.exists("findings", lambda f: f["level"] == level)
    found = (F.col("scripts") > 0) | (F.size("buttons") > 0) | (F.size("links") > 0) | F.col("queue") | F.col("add_call")
    browser = (~found & (F.col("shell") | (F.col("mentions") > 0))) | ((F.size("buttons") > 0) & (F.col("scripts") == 0) & (F.col("mentions") > 0))
    status = F.when(any_("error"), "fail").when(browser, "needs browser").when(any_("warning"), "warn").otherwise("pass")
    return facts.select(key, status.alias("status"), "findings", "csp_script", "csp_frame", "csp_connect", "csp_inline")


def absence_verdicts(verdicts: DataFrame, facts: DataFrame, *, key: str) -> DataFrame:
    """``key, status`` of pages that must have no install: it fails where anything is found, and needs a browser to be sure of a shell."""
    found = (F.col("scripts") > 0) | (F.size("buttons") > 0) | (F.size("links") > 0) | F.col("add_call")
    unsure = (F.col("mentions") > 0) | F.col("shell")
    return verdicts.select(key).join(facts, key).select(key, F.when(found, "fail").when(unsure, "needs browser").otherwise("pass").alias("status"))
