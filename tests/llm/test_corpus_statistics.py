"""Phrases, quality and the audit of filters against plain versions and SQL."""

import collections
import itertools
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cartoloom.llm import filter_audit, phrases, quality, queries

SF = "/root/testdata/sf0.001"
SOME = "red green blue Stone river glass".split()


def rows_of(got, *columns):
    return sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_collocations", "op13_filter_audit"])
def test_same_rows_as_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    want = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    want = want.fetchall()
    assert len(want) > 10 and rows_of(got, *names) == sorted(map(tuple, want), key=str)


# --- phrases


def plain_phrases(rows, least, longest, percent, top):
    counts, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    candidates = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    out = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        if any(g == lang and len(q) > len(p) and inside(p, q) and 100 * b >= percent * a for (g, q), b in candidates.items()):
            continue
        cuts = [(1000 * a * total[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]], total[lang]))
    return sorted(((lang, i + 1, p.decode(), -a, l, r, n, -s) for lang, found in out.items() for i, (s, a, p, l, r, n) in enumerate(sorted(found)[:top])), key=str)


def phrase_rows():
    rng = random.Random(2)
    signs = [" ", " ", " ", "\t", ". ", ",", "\n", "\x0b", "\x85", "\xa0", "  "]
    line = lambda n, words: "".join(rng.choice(words) + rng.choice(signs) for _ in range(n))
    rows = [(rng.choice(["en", "en", "en", "de", None]), line(rng.randint(0, 60), SOME)) for _ in range(80)]
    rows += [("en", "red Red RED red red red red " * 3), ("en", "é ß é ß\x00 é ß"), ("de", None), (None, ""), ("fr", " . ,\t"), ("en", "river glass " * 3000), ("x y", "red green " * 30)]
    return rows + rows[:4]


@pytest.mark.parametrize("least, longest, percent, top", [(3, 5, 100, 2000), (10, 4, 60, 7), (300, 2, 100, 5), (1, 3, 100, 50)])
def test_phrases_against_counting_all(spark, monkeypatch, least, longest, percent, top):
    monkeypatch.setattr(phrases, "SHARD", 2000)  # many shards
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, g, 1, "n") for g, t in rows], "text string, lang string, n int, phrase string").repartition(3)
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert rows_of(phrases.collocations(docs, least=least, longest=longest, percent=percent, top=top), *names) == plain_phrases(rows, least, longest, percent, top)
    assert phrases.collocations(docs.where("1 = 0")).count() == 0


def test_a_full_sketch_loses_nothing(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(4000)]
    rows = [("en", " ".join(rng.choices(words, k=3000))) for _ in range(80)] + [("en", "alpha beta gamma. " * 12)]
    docs = spark.createDataFrame([(t, g) for g, t in rows], "text string, lang string")
    got = phrases.phrase_counts(docs, least=5, most_bits=16)
    texts = docs.select("text", "lang")
    assert phrases.sketch(texts, [], 16, 5, 5).astype(bool).mean() > 0.5  # nearly every byte of the map has a bit
    counts = collections.Counter()
    for _, t in rows:
        for piece in t.split("."):
            w = piece.split()
            for n in range(1, 6):
                counts.update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    assert {r.phrase: r.n for r in got.where("phrase <> ''").collect()} == {p: n for p, n in counts.items() if n >= 5}


def test_scores_of_large_counts_are_exact(spark):
    n, a, l, r = 9 * 10**17, 4 * 10**12 + 7, 5 * 10**14 + 1, 3 * 10**13 + 11
    counts = spark.createDataFrame([("en", "", n), ("en", "p", l), ("en", "q", r)], "lang string, phrase string, n long")
    got = phrases.scored(spark.createDataFrame([("en", "p q", a)], "lang string, phrase string, a long"), counts, 5).first()
    assert got.score == 1000 * a * n // (l * r) and (got.l, got.r, got.n) == (l, r, n)


# --- quality


def test_features_are_those_of_each_text_alone():
    texts = ["Red GREEN blue, blue! 42%", "", "   ", "***", "a" * 5000, "é ß 中文 " * 50, "Red GREEN blue, blue! 42%"]
    text, feature, value = quality.features(texts)
    for k, t in enumerate(texts):
        _, f, v = quality.features([t])
        assert np.array_equal(f, feature[text == k]) and np.allclose(v, value[text == k])
        assert not len(v) or abs((v * v).sum() - 1) < 1e-9
    assert not len(quality.features([])[0])


def test_the_leader_follows_the_textbook_rule():
    rng = np.random.default_rng(1)
    leader = quality.Leader(rate=0.3, damping=1.0, lasso=0.05, ridge=0.2)
    z, n, w = collections.defaultdict(float), collections.defaultdict(float), {}
    for _ in range(60):
        at, x, y = rng.choice(12, 4, replace=False), rng.normal(size=4), float(rng.integers(2))
        for i in at:  # the closed form of the regularised minimum
            w[i] = 0.0 if abs(z[i]) <= 0.05 else -(z[i] - np.sign(z[i]) * 0.05) / ((1.0 + n[i] ** 0.5) / 0.3 + 0.2)
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(at, x))))
        for i, v in zip(at, x):
            g = (p - y) * v
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.3 * w[i]
            n[i] += g * g
        leader.learn(at, x, y)
    assert np.allclose([leader.z[i] for i in range(12)], [z[i] for i in range(12)])


def test_quality_learns_and_scores_whole_tables(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choices(SOME, k=rng.randint(5, 60))) for _ in range(120)]
    bad = [" ".join(f"{w}###" for w in rng.choices(SOME, k=rng.randint(5, 60))) for _ in range(60)]
    texts = [*good, *bad]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, "zz", "y"), (None, "red", "x"), (900, None, "x"), (901, "", "x"), (902, "red ### " * 50000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(180)] + [(None, 1), (5, None), (5, 1), (950, 1)], "doc_id long, quality int")
    fold = lambda c: F.crc32(c.cast("string").cast("binary")) % 5 == 0
    model = quality.fit_on_sample(docs, labels.where(~F.coalesce(fold(F.col("doc_id")), F.lit(False))))
    got = quality.score(docs, model).collect()
    assert got and len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and 0 < r.doc_id < 180 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 20 and all((r.score > 0.5) == (r.doc_id < 120) for r in held)
    plain = {r.doc_id: r.score for r in got if r.doc_id in (900, 901)}
    assert plain[900] == plain[901] == pytest.approx(1 / (1 + np.exp(-model.bias)))
    again = quality.fit_on_sample(docs.orderBy(F.desc("doc_id")).repartition(5), labels.where(~F.coalesce(fold(F.col("doc_id")), F.lit(False))))
    assert np.array_equal(again.weights, model.weights)
    few = quality.fit_on_sample(docs, labels, most_per_label=5)
    assert (few.weights != 0).sum() < (model.weights != 0).sum()
    none = quality.fit_on_sample(docs, labels.where("1 = 0"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.where("1 = 0"), model).count() == 0


# --- audit


def plain_audit(docs, labels):
    texts = collections.defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            texts[t or ""].append(i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    facts = collections.defaultdict(list)
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and min(texts[t]) < i}
        facts[part or ""].append(({f for f, x in fails.items() if x}, i in good, i in toxic))
    out = []
    for part, rows in facts.items():
        own, total = [], collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for s, f in enumerate(order):
                before = set(order[:s])
                gone = [r for r in rows if f in r[0] and not r[0] & before]
                total[f] += len(gone)
                own.append([part, order, s + 1, sum(not r[0] & (before | {f}) for r in rows), len(gone), sum(f in r[0] and bool(r[0] & before) for r in rows), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)])
        out += [(*x, total[x[1][x[2] - 1]]) for x in own]
    return sorted(out, key=str)


def audit_rows():
    rng = random.Random(6)
    text = lambda n, words, end: " ".join(rng.choice(words) + end for _ in range(n))
    many = [f"w{k}" for k in range(900)]
    docs = [(i, text(rng.choice((0, 20, 199, 200, 400)), rng.choice((many, SOME, ["ABC"])), rng.choice(("", "", "#", "\x0c"))), rng.choice(["a", "b", None])) for i in range(150)]
    docs += [(200 + i, docs[i % 7][1], "a") for i in range(120)]  # hot copies
    docs += [(3, docs[3][1], "b"), (None, docs[1][1], "b"), (None, None, None), (500, None, "a"), (501, "", ""), (502, "a\xa0b " * 100, "é"), (503, "x " * 90000, "a")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 240, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("rows", [filter_audit.ROWS, 40])
def test_audit_against_plain_filters(spark, monkeypatch, rows):
    monkeypatch.setattr(filter_audit, "ROWS", rows)
    docs, labels = audit_rows()
    table = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, source string, part string").repartition(5)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert rows_of(filter_audit.interactions(filter_audit.failures(table, told)), *names) == plain_audit(docs, labels)
    assert filter_audit.interactions(filter_audit.failures(table.where("1 = 0"), told)).count() == 0
    bare = filter_audit.interactions(filter_audit.failures(table, told.where("1 = 0")))
    assert bare.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_lookups_keep_all_rows_whatever_is_hot(spark):
    rows = spark.createDataFrame([(None, 0)] * 50 + [(1, 0)] * 3000 + [(k, 0) for k in range(2, 3000)], "k long, x int")
    keys = spark.createDataFrame([(k, k * 10) for k in range(0, 3000, 3)] + [(1, 10)], "k long, v long")
    got = {(r.k, r.v): r.n for r in filter_audit.looked_up(rows, keys, "k").groupBy("k", "v").agg(F.count("*").alias("n")).collect()}
    want = {(None, None): 50, (1, 10): 3000} | {(k, k * 10 if k % 3 == 0 else None): 1 for k in range(2, 3000)}
    assert got == want
