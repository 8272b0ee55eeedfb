"""Choices made in rounds give the rows of the rule said one step after the other."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from cartoloom.operators import clusters, graph, links, voice


def plain_linkage(nodes, links_, threshold, coverage, fits=lambda g: True, sizes=None):
    """The rule said again: of all pairs of groups that may merge the best one merges, until none may."""
    groups = [{n} for n in sorted(nodes)]
    count = lambda g: sum((sizes or {}).get(n, 1) for n in g)
    while True:
        best = None
        for x in range(len(groups)):
            for y in range(x + 1, len(groups)):
                met = [links_[p] for p in links_ if (p[0] in groups[x] and p[1] in groups[y]) or (p[0] in groups[y] and p[1] in groups[x])]
                if not met or any(v for _, v in met) or not fits(groups[x] | groups[y]) or len(met) < max(1, -(-coverage * min(len(groups[x]), len(groups[y])) // 1)):
                    continue
                mean = round(sum(p for p, _ in met) / len(met), 9)
                if mean >= threshold and (best is None or mean > best[0]):
                    best = (mean, x, y)
        if best is None:
            return [sorted(g) for g in groups]
        groups[best[1]] |= groups.pop(best[2])



def linkage_rows(got):
    out = collections.defaultdict(list)
    for r in got.collect():
        out[r.cluster].append(r.node)
    assert all(k == min(v) for k, v in out.items())
    return sorted(sorted(v) for v in out.values())


@pytest.mark.parametrize("threshold,coverage", [(0.5, 0.5), (0.3, 1.0), (0.7, 0.1)])
def test_linkage_is_the_plain_rule(spark, threshold, coverage):
    rng = random.Random(17)
    nodes, links_, want = [], [], []
    for t, size in enumerate((1, 2, 3, 5, 7, 9, 9, 11, 12)):  # tables side by side, told by the first letters
        names = [f"{t:02d}-{rng.randrange(1000):03d}-{k}" for k in range(size)]
        steps = rng.choice((10, 4, 97))
        known = {(a, b): (rng.randrange(steps + 1) / steps, rng.random() < 0.07) for a in names for b in names if a < b and rng.random() < rng.choice((0.3, 0.6, 0.9))}
        wall, kind = {n: rng.choice("aaab") if t % 3 == 0 else "a" for n in names}, {n: rng.choice(["x", "y", None, None]) if t % 2 else None for n in names}
        fits = lambda g, wall=wall, kind=kind: len({wall[n] for n in g}) == 1 and len({kind[n] for n in g} - {None}) <= 1
        want += plain_linkage(names, known, threshold, coverage, fits)
        nodes += [(n, wall[n], [kind[n]] if kind[n] else []) for n in names]
        links_ += [(*(p if rng.random() < 0.5 else p[::-1]), v, 1, veto) for p, (v, veto) in known.items()]
    links_ += [("ghost", nodes[0][0], 1.0, 1, False), (nodes[0][0], nodes[0][0], 1.0, 1, False), (None, nodes[1][0], 1.0, 1, False)]
    got = graph.linkage(spark.createDataFrame(nodes, "node string, wall string, kinds array<string>"), spark.createDataFrame(links_, "a string, b string, total double, n int, veto boolean"), threshold=threshold, coverage=coverage)
    assert linkage_rows(got) == sorted(want)


def test_linkage_of_nothing(spark):
    nodes, none = spark.createDataFrame([("a",), ("b",)], "node string"), spark.createDataFrame([], "a string, b string, total double, n int, veto boolean")
    assert linkage_rows(graph.linkage(nodes, none)) == [["a"], ["b"]] and graph.linkage(nodes.limit(0), none).count() == 0


def test_components_of_chains_hubs_and_loops(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(7, 7), (300, 301), (301, 302), (302, 300)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    rng.shuffle(pairs)
    label = {}
    for a, b in pairs:
        if a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(200):
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == label


def test_ties_take_no_rounds(spark, monkeypatch):
    """30 groups of six equal judgements each, and unions in a chain of 40: decided inside tasks, and in rounds with the same rows."""
    nodes = [(f"{t:02d}-{k}", "b" if k == 5 else "a") for t in range(30) for k in range(6)]
    links_ = [(f"{t:02d}-{a}", f"{t:02d}-{b}", 0.75, 1, t % 3 == 0 and (a, b) == (0, 1)) for t in range(30) for a in range(6) for b in range(a + 1, 6)]
    nodes_, pairs = spark.createDataFrame(nodes, "node string, wall string"), spark.createDataFrame(links_, "a string, b string, total double, n int, veto boolean")
    chain = spark.createDataFrame([(k, [] if k % 9 else ["x" if k % 2 else "y"]) for k in range(41)], "node long, kinds array<string>")
    wanted = spark.createDataFrame([(k, k + 1, k, k + 1) for k in range(40)], "a long, b long, i long, j long")
    written = []
    monkeypatch.setattr(graph, "settled", lambda frame, own=graph.settled: written.append(1) or own(frame))
    got, joined = linkage_rows(graph.linkage(nodes_, pairs)), linkage_rows(graph.ordered_union(chain, wanted))
    assert len(written) < 60
    rows = [(n, w) for n, w in nodes if n < "03"]
    monkeypatch.setattr(graph, "SMALL", 3)
    few = linkage_rows(graph.linkage(spark.createDataFrame(rows, "node string, wall string"), pairs))
    assert few == [g for g in got if g[0] < "03"] and linkage_rows(graph.ordered_union(chain.where("node < 12"), wanted)) == [[*range(9)], [9, 10, 11]]
    assert len(got) == 70 and joined == [[*range(9)], [*range(9, 18)], [*range(18, 27)], [*range(27, 36)], [*range(36, 41)]]


def test_components_name_each_node_once(spark):
    pairs = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert sorted((r.node, r.component) for r in graph.components(pairs).collect()) == [(k, 0) for k in range(61)]


def test_numbers_without_one_task_for_all(spark):
    rows = spark.range(5000).select(F.col("id"), F.pmod(F.hash("id"), F.lit(40)).alias("k")).repartition(7)
    got = [r.id for r in clusters.numbered(rows, [F.desc("k"), F.asc("id")]).orderBy("place").collect()]
    assert got == [r.id for r in rows.orderBy(F.desc("k"), "id").collect()] and clusters.numbered(rows.limit(0), [F.asc("id")]).count() == 0


# --- clusters, the whole command


def plain_clusters(words, edges, merges, least):
    by = {w["id"]: w for w in words if w["partition"] != "own-brand"}
    at = {frozenset((a, b)): (p, d) for a, b, p, d in edges}
    fits = lambda g: len({(by[i]["partition"], by[i]["local"]) for i in g}) == 1 and len({by[i]["intent"] for i in g} - {"mixed"}) <= 1
    groups = [set(g) for g in plain_linkage(sorted(by), {(a, b): (p, d >= 0.5) for a, b, p, d in edges if a in by and b in by}, 0.5, 0.5, fits)]
    for a, b in sorted(set(merges)):
        x, y = (next((g for g in groups if i in g), None) for i in (a, b))
        if x and y and x is not y and fits(x | y):
            groups.remove(y)
            x |= y
    groups = sorted(groups, key=min)
    head = lambda g: min(g, key=lambda i: (-by[i]["demand"], -by[i]["clicks"], by[i]["keyword"]))
    heads, after, evicted = [head(g) for g in groups], [set(g) for g in groups], {}
    good = lambda e: e is not None and e[0] >= 0.5 and e[1] < 0.5
    for k, g in enumerate(groups):
        for m in g - {heads[k]}:
            e = at.get(frozenset((heads[k], m)))
            if e is None or good(e):
                continue
            evicted[m] = e[0]
            after[k].discard(m)
            offers = [(-at[frozenset((h, m))][0], n) for n, h in enumerate(heads) if n != k and good(at.get(frozenset((h, m)))) and fits(groups[n] | {m})]
            if offers:
                after[min(offers)[1]].add(m)
    found = sorted((-sum(by[i]["demand"] for i in g), by[head(g)]["keyword"], head(g), sorted(g)) for g in after if g and (len(g) > 1 or by[min(g)]["demand"] >= least))
    name = {i: (f"C{n:03d}", h, -d, k) for n, (d, k, h, g) in enumerate(found, 1) for i in g}
    return sorted((i, *name.get(i, (None,) * 4), evicted.get(i)) for i in by)


def test_cluster_command_is_the_plain_one(spark):
    rng = random.Random(8)
    words = [{"id": f"k{n:03d}", "keyword": f"word {rng.randrange(900)} {n}", "demand": rng.randrange(40), "clicks": rng.randrange(3), "partition": rng.choice(["generic"] * 12 + ["branded", "own-brand"]), "local": rng.choice([""] * 9 + ["perth"]), "intent": rng.choice(["mixed"] * 8 + ["informational", "commercial"])} for n in range(90)]
    edges = {}
    for _ in range(1100):
        a, b = sorted(rng.sample(range(90), 2))
        if b - a < 12:
            edges[f"k{a:03d}", f"k{b:03d}"] = (rng.randrange(1, 101) / 100, rng.choice([0.0] * 20 + [0.8]))
    rows = [(a, b, p, d) for (a, b), (p, d) in edges.items()]
    merges = [tuple(sorted((f"k{rng.randrange(90):03d}", f"k{rng.randrange(90):03d}"))) for _ in range(60)]
    got = clusters.form_clusters(spark.createDataFrame(words), spark.createDataFrame(rows, "a string, b string, p_same double, p_different double"), spark.createDataFrame(merges, "a string, b string"), least_single=12)
    have = sorted((r.id, r.cluster, r["head"], r.demand, r.name, r.evicted) for r in got.collect())
    want = plain_clusters(words, rows, merges, 12)
    assert have == want and sum(w[5] is not None for w in want) > 3 and sum(w[1] is None for w in want) > 3 and len({w[1] for w in want}) > 5


def test_topics_from_cluster_links(spark):
    c = spark.createDataFrame([("a", 2, 50.0, "a"), ("b", 2, 90.0, "b"), ("c", 2, 10.0, "c"), ("d", 1, 60.0, "d")], "cluster string, n int, demand double, name string")
    pairs = spark.createDataFrame([("a", "b", 1.8, 2), ("b", "c", 0.9, 1), ("a", "c", 0.1, 1), ("c", "d", 0.2, 1)], "a string, b string, total double, n int")
    got = {r.cluster: (r.topic, r.pillar, r.demand) for r in clusters.form_topics(c, pairs).collect()}
    assert got == {"a": ("T001", False, 140.0), "b": ("T001", True, 140.0), "c": ("T003", True, 10.0), "d": ("T002", True, 60.0)}


# --- links


def plain_selection(rows, per_source, per_target):
    """One candidate after the other."""
    pairs, lines, owner, spent, out = set(), set(), {}, collections.Counter(), {}
    for r in sorted(rows, key=lambda r: (-r["score"], r["source"], r["target"], r["anchor"], r["sentence"], r["id"])):
        site, s, t, a = r["site"], r["source"], r["target"], r["anchor"].strip().lower()
        rules = [
            (r["first_reason"], r["first_reason"]), (s == t, "self"), ((site, s, t) in pairs, "duplicate pair"), (r["second_reason"], r["second_reason"]), ((owner.get((site, a)) or r["owner"] or t) != t, "anchor owned"),
            ((site, s, r["sentence"]) in lines, "sentence used"), (spent[site, "s", s] >= per_source, "source budget"), (spent[site, "t", t] >= per_target, "target budget"),
        ]
        out[r["id"]] = next((why for broken, why in rules if broken), None)
        if out[r["id"]] is None:
            pairs.add((site, s, t)), lines.add((site, s, r["sentence"]))
            owner[site, a] = t
            spent[site, "s", s] += 1
            spent[site, "t", t] += 1
    return out


@pytest.mark.parametrize("per_source,per_target", [(2, 3), (1, 1), (5, 10)])
def test_links_are_selected_as_one_after_the_other(spark, per_source, per_target):
    rng = random.Random(per_source)
    rows = []
    held = {f"a{k}": "hub" for k in range(0, 60, 9)}
    for k in range(900):
        site = rng.choice(["s", "s", "t"])
        rows.append({"id": k, "site": site, "source": f"p{rng.randrange(25)}", "target": rng.choice(["hub", f"p{rng.randrange(25)}"]), "anchor": rng.choice(["Way out", "way out ", f"a{rng.randrange(60)}"]), "sentence": rng.randrange(12), "score": rng.randrange(60) / 60,
                     "first_reason": rng.choice([None] * 12 + ["source not eligible"]), "second_reason": rng.choice([None] * 12 + ["", "no anchor"])})
        rows[-1]["owner"] = held.get(rows[-1]["anchor"])
    schema = "id int, site string, source string, target string, anchor string, sentence int, score double, first_reason string, second_reason string, owner string"
    table = spark.createDataFrame([tuple(r.values()) for r in rows], schema).coalesce(1)
    got = {r.id: r.drop_reason for r in graph.select_links(table, per_source=per_source, per_target=per_target).collect()}
    want = plain_selection(rows, per_source, per_target)
    assert got == want and len(set(want.values())) >= 8
    assert graph.select_links(table.limit(0)).count() == 0


# --- quotes and phrases


def test_quotes_are_assigned_as_one_after_the_other(spark):
    rng = random.Random(5)
    rows = [(f"r{run}", rank, f"i{rank}", place, f"q{rng.randrange(25)}") for run in range(4) for rank in range(1, 9) for place in range(rng.randrange(0, 7))]
    want = []
    for run in sorted({r[0] for r in rows}):
        used = set()
        for rank in range(1, 9):
            own = sorted(r for r in rows if r[0] == run and r[1] == rank)
            picks = [r for r in own if r[4] not in used][:2] or own[:1]
            used |= {r[4] for r in picks}
            want += picks
    got = voice.assigned_quotes(spark.createDataFrame(rows, "run string, rank int, issue string, place int, review string").repartition(3), most=2)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def plain_phrases(rows):
    def touch(a, b):
        if a.find(b) >= 0 or b.find(a) >= 0:
            return True
        for x, y in ((a.split(), b.split()), (b.split(), a.split())):
            for k in range(1, len(x)):
                if k < len(y) and x[len(x) - k :] == y[:k]:
                    return True
        return False

    out = []
    for side in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == side), key=lambda r: (-r[2], -len(r[1].split()), -len(set(r[3])), r[1]))
        kept = []
        for r in own:
            mine = set(r[3])
            if any(len(q[1].split()) > len(r[1].split()) and touch(r[1], q[1]) and len(mine & set(q[3])) >= 0.8 * len(mine) for q in own):
                continue
            if not any(touch(r[1], q[1]) and len(mine & set(q[3])) >= 0.5 * len(mine | set(q[3])) for q in kept):
                kept.append(r)
        out += [(side, r[1]) for r in kept]
    return sorted(out)


def test_phrases_that_say_the_same_go_as_one_after_the_other(spark):
    rng = random.Random(9)
    words = "day off work take another wait well workers".split()
    rows = {}
    for _ in range(160):
        side, phrase = rng.choice("pn"), " ".join(rng.choices(words, k=rng.choice((2, 2, 3, 4))))
        rows[side, phrase] = (side, phrase, rng.randrange(20) / 4, rng.sample(range(14), rng.randint(1, 6)))
    rows = list(rows.values())
    got = voice.distinct_phrases(spark.createDataFrame(rows, "side string, phrase string, score double, reviews array<int>"))
    want = plain_phrases(rows)
    assert sorted((r.side, r.phrase) for r in got.collect()) == want and 10 < len(want) < len(rows)
