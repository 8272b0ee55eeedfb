"""Pages: classes of links, sections, chunks."""

import random

from pyspark.sql import functions as F

from cartoloom.functions import structure
from cartoloom.operators import sections

URL = "https://a.org/page"


def classes(page, url=URL):
    return {r["href"]: r["class"] for r in structure.link_rows(page, url)}


def test_an_anchor_is_taken_out_once():
    assert classes("<p>go go <a href='/g'>go</a></p>")["/g"] == "contextual"
    assert classes("<p>Go <a href='/g'>go</a></p><p><a href='/c'>cat</a>egory one</p>") == {"/g": "link_list", "/c": "contextual"}


def test_without_a_marked_root_the_section_around_the_first_heading_is_it():
    page = "<body><section><h1>T</h1><p>some words and <a href='/in'>here</a> it is</p></section><div><p>some words and <a href='/out'>there</a> it is</p></div></body>"
    assert classes(page) == {"/in": "contextual", "/out": "template"}
    assert classes(page.replace("section>", "div>"))["/out"] == "contextual"  # then the body is
    assert structure.Tree("<p>x").root() == 0 and structure.Tree("").root() == 0


def test_blocks_end_what_stands_before_them():
    tree = structure.Tree("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><th>e</table><p>f<div>g</div></p>h<br/>i</q>")
    assert [tree.tag[k] for k in range(1, len(tree.tag))] == "ul li li table tr td td tr th p div br".split()
    assert [tree.up[k] for k in range(1, len(tree.tag))] == [0, 1, 1, 0, 4, 5, 5, 4, 8, 0, 0, 0] and tree.text(0) == "a b c d e f g h i"


def test_kinds_of_text_blocks():
    page = "<main><dl><dt>a few words <a href='/d'>x</a></dt></dl><pre>three words are <a href='/p'>x</a></pre><h3>A <a href='/h'>x</a></h3></main>"
    assert classes(page) == {"/d": "other", "/p": "other", "/h": "heading_link"}


def test_a_page_of_many_links_ends():
    page = "<main><div>" + "".join(f"<a href='/{k}'>link {k}</a> " for k in range(30000)) + "</div></main>"
    got = structure.link_rows(page, URL)
    assert len(got) == 30000 and {r["class"] for r in got} == {"contextual"}
    deep = "<div>" * 3000 + "<p>two more <a href='/x'>y</a></p>"
    assert classes(deep) == {"/x": "contextual"} and structure.section_blocks(deep, URL)[0]["text"] == "two more y"


PAGE = """<html><head><title>T</title></head><body><header>no</header><main><p>Intro by Dr. Who. It ends.</p><h2>First <b>head</b></h2>
<p>See <a href="/one#x">one thing</a> and then <a href="/two">two</a>. "Two" is here again. We say e.g. No. 5 holds.</p><div class="toc-box"><p>gone</p></div>
<ul><li>Item a<ul><li>Inner b</li></ul></li><li><a href="/three">Only link</a></li></ul><h2>Empty</h2><h3>Sub</h3><div>Loose <i>words</i> here</div><div><p>Inside</p></div><form>no</form><h5>never</h5><blockquote>Quote. (Next) one</blockquote></main></body></html>"""


def test_sections_and_sentences(spark):
    pages = spark.createDataFrame([(1, URL, PAGE), (2, URL, None), (3, URL, "")], "id int, url string, html string")
    s = sections.section_sentences(pages, key="id", url="url", source="html")
    got = [(r.section, r.heading, r.level, r.sentence, r.tag, r.text, [(l.href, l.anchor) for l in r.links], r.link_only) for r in s.orderBy("sentence").collect()]
    assert got == [
        ("S01", "", "intro", "S01.01", "p", "Intro by Dr. Who.", [], False), ("S01", "", "intro", "S01.02", "p", "It ends.", [], False),
        ("S02", "First head", "h2", "S02.01", "p", "See one thing and then two .", [("https://a.org/one", "one thing"), ("https://a.org/two", "two")], False),
        ("S02", "First head", "h2", "S02.02", "p", '"Two" is here again.', [], False), ("S02", "First head", "h2", "S02.03", "p", "We say e.g. No. 5 holds.", [], False),
        ("S02", "First head", "h2", "S02.04", "li", "Item a", [], False), ("S02", "First head", "h2", "S02.05", "li", "Inner b", [], False), ("S02", "First head", "h2", "S02.06", "li", "Only link", [("https://a.org/three", "Only link")], True),
        ("S03", "Sub", "h3", "S03.01", "div", "Loose words here", [], False), ("S03", "Sub", "h3", "S03.02", "p", "Inside", [], False),
        ("S03", "Sub", "h3", "S03.03", "blockquote", "Quote.", [], False), ("S03", "Sub", "h3", "S03.04", "blockquote", "(Next) one", [], False),
    ]
    assert sorted((r.section, r.sentences, r.words) for r in sections.sections(s, key="id").collect()) == [("S01", 2, 6), ("S02", 6, 21), ("S03", 4, 7)]
    assert sorted((r.anchor, r.sentence) for r in sections.section_anchors(s, key="id").collect()) == [("Only link", "S02.06"), ("one thing", "S02.01"), ("two", "S02.01")]


def plain_sections(tree):
    """The blocks of a page said by recursion."""
    out, state = [], ["", "intro"]

    def said(k, own):
        parts = []
        for c in tree.children[k]:
            if isinstance(c, str):
                parts.append(c)
            elif tree.tag[c] == "br":
                parts.append(" ")
            elif tree.tag[c] not in structure.SILENT and (tree.tag[c] not in ("ul", "ol", "table") or tree.tag[c] == own):
                parts.append(f" {tree.text(c, structure.SILENT)} " if tree.tag[c] == "a" else said(c, own))
        return "".join(parts)

    def go(k):
        for c in tree.children[k]:
            if isinstance(c, str) or tree.tag[c] in structure.SILENT or "sidebar" in tree.mark[c] or tree.tag[c] in ("h1", "h5", "h6"):
                continue
            if tree.tag[c] in ("h2", "h3", "h4"):
                state[:] = [tree.text(c, structure.SILENT), tree.tag[c]]
                continue
            inner = [x for x in tree.children[c] if not isinstance(x, str)]
            if tree.tag[c] in ("p", "li", "td", "th", "dd", "dt", "blockquote", "figcaption", "pre") or (tree.tag[c] == "div" and not any(tree.tag[x] in structure.BLOCK for x in inner)):
                if text := " ".join(said(c, tree.tag[c]).split()):
                    out.append((*state, tree.tag[c], text))
                if tree.tag[c] != "div":
                    for x in inner:
                        if tree.tag[x] in ("ul", "ol", "table") and "sidebar" not in tree.mark[x]:
                            go(x)
                continue
            go(c)

    go(tree.root())
    return out


def test_blocks_of_random_pages_are_those_of_the_plain_walk():
    rng = random.Random(7)
    tags = "p div ul li table tr td h2 h3 h5 b a section aside blockquote pre".split()
    for _ in range(400):
        page = "".join(rng.choice([f"<{rng.choice(tags)}>", f"<{rng.choice(tags)} class='sidebar'>" if rng.random() < 0.1 else "", f"</{rng.choice(tags)}>", f"</{rng.choice(tags)}>", "some ", "words.", "<br>", "<a href='/q'>"]) for _ in range(40))
        got = [(b["heading"], b["level"], b["tag"], b["text"]) for b in structure.section_blocks(page, URL)]
        assert got == plain_sections(structure.Tree(page))


def test_chunks_carry_heading_path_and_lists(spark):
    page = """<title>The &amp; title</title><h1>Main</h1><p>Before</p><ul><li>a<ul><li>b</li></ul></li></ul><nav><h2>No</h2></nav><h2>One</h2><p>text</p><div>more<script>var x</script></div><h3>Sub</h3>deep<h1>Again</h1>still<h2></h2>
    <script type="application/ld+json">{"@type": ["A", "B"], "x": {"@type": "C", "y": [{"@type": "A"}]}}</script><script type="application/ld+json">{bad</script><ol><li>c</ol><h2>Two</h2>""" + "z" * 600
    rows = spark.createDataFrame([(1, page), (2, None), (3, page.replace("deep", "deeper")), (4, page + "<footer>x</footer>")], "id int, html string")
    got = {r.id: r for r in sections.chunked(rows, key="id", source="html").collect()}
    r = got[1]
    assert (r.title, r.h1, r.lists, r.types) == ("The & title", "Main", ["- a- b", "- c"], ["A", "B", "C"])
    assert [(c.level, c.path, c.text, c.content) for c in r.chunks] == [("h2", "", "One", "text more"), ("h3", "One", "Sub", "deep" + "still c"), ("h2", "", "Two", "z" * 500)]
    assert got[1].digest == got[4].digest != got[3].digest and got[2].chunks == [] and got[2].words == 0
    assert len(structure.chunks("".join(f"<ul><li>{k}</ul>" for k in range(9)))["lists"]) == 5
