"""The stages on a small table."""

import random
import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from cartoloom.llm import decontamination
from cartoloom.llm.pieces import PieceIds
from cartoloom.llm.queries import vocabulary
from test_text_operators import plain_base


def test_stages_keep_clean_documents(spark, tmp_path):
    rng = random.Random(5)
    words = {"en": "the and of with this that from have stone river".split(), "fr": "le la des avec dans pour être été rivière pierre".split()}
    text = lambda c: " ".join(rng.choice(words[c]) + rng.choice(["", "", "x", "y", "z"]) for _ in range(80))
    rows = [(i, text(c), c, "s", 0) for i, c in enumerate(["en", "fr"] * 20)]
    passage = " ".join(f"q{i}" for i in range(15))
    rows += [(100, rows[0][1], "en", "s", 0), (101, "42 !!", "en", "s", 0), (102, None, "en", "s", 0), (103, rows[2][1][:150] + " " + passage + " " + rows[4][1][:150] + " mail a@b.com", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    after = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, after, folder).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r.doc_id for r in after.select("doc_id").collect()}
    clean = set(range(40))
    assert seen["language"] == clean | {100, 103} and seen["near duplicates"] == clean | {103}
    final = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/personal data").collect()}
    assert passage not in final[103] and "[EMAIL]" in final[103] and all(final[i] == rows[i][1] for i in clean)
    assert seen["packing"] == clean | {103} and after.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_stages_of_an_empty_table_and_of_nulls(spark, tmp_path):
    folder = str(tmp_path)
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, rows in (("empty", []), ("nulls", [(None, None, None, None, None), (None, "", None, None, 0), (1, "the river", None, None, None), (1, "the river", None, None, None)])):
        after = spark.createDataFrame(rows, kind)
        for step, stage in corpus_pipeline.STAGES:
            stage(spark, after, folder).write.parquet(f"{folder}/{name}-{step}")
            after = spark.read.parquet(f"{folder}/{name}-{step}")
            assert after.columns == list(corpus_pipeline.COLUMNS) or step == "packing"
        assert after.count() == 0  # nothing is labelled, so no language is known


def plain_language(rows):
    """Texts of this test are in the language they are marked with, or have no letter."""
    return [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]


def plain_deduplicated(rows):
    """The least id of each set of rows that links of five-word Jaccard 0.8 connect."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (r[1].lower().split() for r in rows)]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if len(a & b) / len(a | b) >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
    best = {}
    for r, k in zip(rows, label):
        best[k] = min(best.get(k, r), r, key=lambda x: x[0])
    return sorted(best.values())


def plain_decontaminated(rows, passages):
    cut = lambda t: list(re.finditer(decontamination.WORD, t.translate(str.maketrans(decontamination.UPPER, decontamination.LOWER))))
    windows = {tuple(x[0] for x in cut(p)[i : i + 10]) for p in passages for i in range(len(cut(p)) - 9)}
    out = []
    for r in rows:
        w = cut(r[1])
        hit = {j for i in range(len(w) - 9) if tuple(x[0] for x in w[i : i + 10]) in windows for j in range(i, i + 10)}
        ends = [*(x.start() for x in w[1:]), len(r[1])]
        text = r[1][: w[0].start()] + "".join(r[1][x.start() : e] for k, (x, e) in enumerate(zip(w, ends)) if k not in hit)
        if len(hit) < 0.5 * len(w):
            out.append((r[0], text))
    return out


def plain_masked(rows):
    out = []
    for i, text in rows:
        masked, end = "", 0
        for kind, a, b in sorted(plain_base(text), key=lambda s: (s[1], -s[2])):
            if a >= end:
                masked += text[end:a] + f"[{kind.upper()}]"
            end = max(end, b)
        out.append((i, masked + text[end:]))
    return out


def test_pipeline_against_plain_versions(spark, tmp_path):
    rng = random.Random(9)
    words = {"en": "the and of with this that from have stone river".split(), "fr": "le la des avec dans pour être été rivière pierre".split()}
    text = lambda c, n=80: [rng.choice(words[c]) + rng.choice(["", "", "x", "y", "z"]) for _ in range(n)]
    passages = [" ".join(f"q{k}{i}" for i in range(14)) for k in range(3)]
    rows = []
    for k in range(24):
        c = "en" if k % 2 else "fr"
        base = text(c)
        rows.append((10 * k, " ".join(base), c))
        if k % 3 == 0:
            rows.append((10 * k + 1, " ".join(base), c))
        if k % 4 == 0:
            near = list(base)
            near[rng.randrange(80)] = "changed"
            rows.append((10 * k + 2, " ".join(near), c))
        if k % 5 == 0:
            far = list(base)
            for _ in range(12):
                far[rng.randrange(80)] = "other"
            rows.append((10 * k + 3, " ".join(far), c))
    rows += [(300 + k, " ".join(text("en", 30)) + f", {p.upper()}; " + " ".join(text("en", 30)), "en") for k, p in enumerate(passages)]
    rows += [(310, passages[0] + " and the", "en"), (320, " ".join(text("en", 40)) + " ann@x.org, 10.0.0.255 +1 (555) 123-4567 " + " ".join(text("en", 20)), "en"), (330, "12 34", "en"), (331, None, "en"), (332, "", "fr")]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, c, "s", 0) for i, t, c in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    want = dict(plain_masked(plain_decontaminated(plain_deduplicated(plain_language(rows)), passages)))
    got = corpus_pipeline.run(spark, folder).collect()
    ids = PieceIds(vocabulary("byte_bpe_50k.json"))
    lengths = {i: len(ids.by_library(t)) + 1 for i, t in want.items()}
    assert {r.doc_id for r in got} == set(want) and all(lengths[r.doc_id] == r.length for r in got)
    after = {}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    after = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert after == {i: (t, len(t)) for i, t in want.items()}
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        ends = np.cumsum([n for _, n in sorted(own)]).tolist()
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(bins) == -(-sum(lengths.values()) // 2048)
