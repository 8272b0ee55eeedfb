"""The ten operators against plain versions on small, awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartoloom.llm import decontamination, fingerprints, language, near_duplicates, packing, personal_data, repeats, suffixes, tagger, token_counts, token_files, toxicity
from cartoloom.llm.pieces import PieceCounts, PieceIds
from cartoloom.llm.queries import vocabulary

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
WORD_LIST = "red green blue stone river cloud glass iron paper salt wind fire moon star leaf bird".split()


def texts(seed=1, n=60):
    rng = random.Random(seed)
    line = lambda k: " ".join(rng.choice(WORD_LIST) + str(rng.randrange(40)) for _ in range(k))
    base = [line(rng.randint(5, 220)) for _ in range(n)]
    out = [*base, *base[:6], base[0] + " tail", base[1][:900] + " cut " + base[1][900:], None, "", "   ", "\n\t x", "éß 中文 😀 " * 9, "a" * 3000, "<|endoftext|> it's 42"]
    return [(i, t) for i, t in enumerate(out)] + [(None, base[2]), (3, base[3])]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    own = [(i, t, "en", "s", 0, "clash") for i, t in rows]
    return spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long, n_tokens string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


def odd_texts(n, seed=0):
    rng = random.Random(seed)
    letters = list(" \n\t\r aAé'sΣ1,.!#\xa0　\x1c\x0b\x85\u200b́İ<|>中😀½²") + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", " the", "'ll", "'S"]
    return ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(n)]


def test_piece_engines_agree_with_the_library(monkeypatch):
    ids, counts = PieceIds(BYTES), PieceCounts(WORDS)
    some = odd_texts(3000)
    assert all(ids.by_ranks(s).tolist() == ids.by_library(s).tolist() for s in some)
    found = [(s, counts.frequencies(s)) for s in some]
    plain = [(s, f) for s, f in found if f is not None]
    table = dict(zip(chunks := sorted({c for _, f in plain for c in f}), counts.counts(chunks)))
    assert len(plain) > 500 and all(sum(n * table[c] for c, n in f.items()) == counts.whole(s) for s, f in plain)
    monkeypatch.setattr(PieceIds, "by_ranks", lambda self, t: np.zeros(1, "<u4"))
    with pytest.raises(ValueError):
        ids.ids(["a text that differs"])


@pytest.mark.parametrize("frequent", [0, 20, 1 << 17])
def test_token_counts(spark, docs, rows, empty, frequent):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    more = [*rows, *enumerate(odd_texts(300, 5), 1000), (2000, "<|ENDOFTEXT|>"), (2001, "x<|EndOfText|>y <|endoftext|>"), (2002, "word " * 60000), (2003, "w" * 30000), *((2100 + k, "http://a.org/" + "q" * 90 + " x") for k in range(40))]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more[len(rows) :], "doc_id long, text string"))
    want = sorted(((i if i is not None else -1), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in more)
    got = token_counts.count_tokens(table, WORDS, frequent=frequent).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts.count_tokens(empty, WORDS).count() == 0


def test_most_frequent_pre_tokens_are_bounded(spark, monkeypatch):
    p = spark.createDataFrame([(f"w{k}", 1 + 1000 // (k + 1), 1) for k in range(300)] + [("x" * 100, 10**6, 9)], "chunk string, n long, pieces int")
    for most in (0, 1, 10, 100, 1000):
        got = {r.chunk for r in token_counts.most_frequent(p, most).collect()}
        hot = {"x" * 100} if most else set()
        assert len(got) <= most and got == hot | {f"w{k}" for k in range(len(got - hot))} and (len(got) == 301 if most == 1000 else most < 10 or len(got) >= most // 2)
    monkeypatch.setattr(token_counts, "MOST_BYTES", 120)
    got = [r.chunk for r in token_counts.most_frequent(p, 1000).collect()]
    assert "x" * 100 in got and sum(map(len, got)) <= 120 and len(got) > 3
    monkeypatch.setattr(token_counts, "MOST_BYTES", 90)  # the long one alone does not fit
    got = [r.chunk for r in token_counts.most_frequent(p, 1000).collect()]
    assert "x" * 100 not in got and 10 < sum(map(len, got)) <= 90


def test_suffix_array_and_prefixes():
    rng = random.Random(4)
    for _ in range(300):
        b = bytes(rng.randrange(rng.choice((1, 2, 4, 200))) for _ in range(rng.randint(0, 50))) * rng.choice((1, 1, 3))
        d = np.frombuffer(b, np.uint8)
        sa = suffixes.suffix_array(np.append(d.astype(np.uint16) + 1, 0).astype(np.uint16), 257)
        ref = sorted(range(len(b) + 1), key=lambda i: b[i:])
        assert sa.tolist() == ref
        lcp = [0] * len(b)
        for x, y in zip(ref, ref[1:]):
            k = 0
            while x + k < len(b) and y + k < len(b) and b[x + k] == b[y + k]:
                k += 1
            lcp[y] = k
        assert suffixes.permuted_common_prefixes(d, sa).tolist() == lcp


def plain_repeats(rows, n):
    data = [(x or "").encode() for _, x in rows]
    seen = collections.Counter(d[s : s + n] for d in data for s in range(len(d) - n + 1))
    out = []
    for (i, _), d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - n + 1):
            if seen[d[s : s + n]] > 1:
                gone[s : s + n] = True
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(d) else 0
        out.append((-1 if i is None else i, len(d), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("bound", [repeats.CLASS, 3000, 1000, 100])
def test_repeats(docs, rows, empty, bound, monkeypatch):
    monkeypatch.setattr(repeats, "CLASS", bound)  # larger classes are split, down to single windows
    got = repeats.digest(repeats.remove_repeats(docs, length=400)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain_repeats(rows, 400)
    assert repeats.remove_repeats(empty).count() == 0


def test_large_classes_leave_the_other_strings_where_they_are(docs, rows, monkeypatch):
    plans = []
    stored = repeats.stored

    def seen(frame, **kwargs):
        if "large" in frame.columns:
            plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return stored(frame, **kwargs)

    monkeypatch.setattr(repeats, "CLASS", 1000)
    monkeypatch.setattr(repeats, "stored", seen)
    twice = docs.unionByName(docs)  # each string is fetched more than once
    got = repeats.digest(repeats.remove_repeats(twice, length=400)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain_repeats(rows * 2, 400)
    assert len(plans) == 1 and not re.search(r"hashpartitioning\(g#\d+L, r#\d+L", plans[0].partition("Generate")[0])


def test_halves_keep_every_window_once():
    rng = random.Random(1)
    for _ in range(300):
        length, gram = rng.choice(((40, 12), (40, 39), (41, 12), (40, 33)))
        at = rng.randrange(0, length - gram + 1)  # of the gram in the last window
        before = rng.randrange(0, length - gram - at + 1)
        data = bytes(rng.randrange(256) for _ in range(length + before))
        place = before + at
        more = -(-(length - gram) // 2)
        seen = []
        for shift, p, part in repeats.halves(data, place, gram, length):
            wide = part[p : p + gram + more]
            assert len(wide) == gram + more and part == data[shift : shift + len(part)] and len(part) >= length
            for s in range(len(part) - length + 1):
                assert s <= p and p + len(wide) <= s + length  # every window holds the longer gram
                seen.append(shift + s)
        assert sorted(seen) == list(range(before + 1))


def test_repeats_in_long_texts(spark):
    rng = random.Random(12)
    passage = bytes(rng.randrange(97, 123) for _ in range(700)).decode()
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    a = noise(repeats.STRETCH - 300) + "A" + passage + "B" + noise(5000) + "C" + passage + "D" + noise(900)
    b = noise(2000) + "E" + passage[:399] + "F"
    d = spark.createDataFrame([(1, a), (2, b), (3, noise(3000))], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(d).collect()}
    assert got[1] == (1400, 2, a.replace(passage, "").encode()) and got[2] == (0, 0, b.encode()) and got[3][0] == 0


def test_fingerprints(docs, rows, empty):
    got = fingerprints.compare_edited(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    by = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        by.setdefault(i, set()).add(hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest())
    ids = [i for i, _ in rows]
    assert len(got) == len(rows)
    assert all(r.edited_sha256 in by[r.doc_id] for r in got if ids.count(r.doc_id) == 1 and ids.count(r.doc_id - 1 if r.doc_id else None) == 1)
    assert {r.fingerprint for r in got if r.doc_id in (0, 60)} and len({r.fingerprint for r in got if r.doc_id in (0, 60)}) == 1
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert fingerprints.compare_edited(empty).count() == 0


def plain_fingerprint(text):
    """Byte by byte: a window's hash ends a chunk, chunks become letters, the block doubles until 64 chunks do."""
    data, m = text.encode(), (1 << 32) - 1
    if not data:
        return "4::"
    rolls = []
    for i in range(len(data)):
        h = 0
        for k in range(min(fingerprints.WINDOW, i + 1)):
            h += (data[i - k] + 1) * pow(0x9E3779B1, k + 1, 1 << 32)
        h &= m
        h ^= h >> 15
        h = h * 0x85EBCA6B & m
        rolls.append(h ^ (h >> 13))
    block = 4
    while sum(h % block == 0 for h in rolls) >= 64:
        block *= 2

    def signature(size):
        out, start = "", 0
        for i, h in enumerate(rolls):
            if h % size == 0 or i == len(data) - 1:
                total = sum((c + 1) * pow(fingerprints.BASE, k, 1 << 64) for k, c in enumerate(data[start : i + 1])) % (1 << 64)
                total ^= total >> 29
                total = total * 0x9E3779B97F4A7C15 % (1 << 64)
                out += fingerprints.ALPHABET[total >> 58]
                start = i + 1
        return out

    return f"{block}:{signature(block)}:{signature(2 * block)}"


def plain_likeness(a, b):
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            before, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
        return row[-1]

    def alike(x, y):
        runs = lambda s: {s[i : i + 7] for i in range(len(s) - 6)}
        if not x and not y:
            return 1.0
        if min(len(x), len(y)) >= 7 and not runs(x) & runs(y):
            return 0.0
        return 1 - distance(x, y) / max(len(x), len(y))

    (p, x1, x2), (q, y1, y2) = a.split(":"), b.split(":")
    p, q = int(p), int(q)
    if a == b:
        return 1.0
    return max(alike(x1, y1), alike(x2, y2)) if p == q else alike(x1, y2) if p == 2 * q else alike(x2, y1) if q == 2 * p else 0.0


def test_fingerprints_are_the_plain_ones(spark, rows):
    rng = random.Random(6)
    some = [(i, t) for i, (_, t) in enumerate(rows)] + [(100 + k, "".join(rng.choices("ab é\n", k=n))) for k, n in enumerate((1, 5, 6, 7, 8, 64, 300, 5000))] + [(200, "lorem " * 20000)]
    d = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in fingerprints.compare_edited(d).collect()}
    order = sorted(some, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, new, their = map(plain_fingerprint, (t, edited, after))
        r = got[i]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint, r.edited_sha256) == (len(t), own, new, hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - plain_likeness(own, new)) < 1e-9 and abs(r.near_next - plain_likeness(own, their)) < 1e-9


def test_decontamination(spark, docs, rows, empty):
    items = [(1, rows[4][1]), (2, "River5 STONE3"), (3, None), (4, ""), (5, "zz"), (6, rows[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    win = collections.defaultdict(set)
    import re

    cut = lambda t: re.findall(decontamination.WORD, (t or "").translate(str.maketrans(decontamination.UPPER, decontamination.LOWER)))
    for i, t in items:
        w = cut(t)
        for k in [w[j : j + 10] for j in range(len(w) - 9)] or ([w] if w else []):
            win[tuple(k)].add(i)
    want = []
    for i, t in rows:
        w, hit, met = cut(t), set(), set()
        for k, of in win.items():
            for j in range(len(w) - len(k) + 1):
                if tuple(w[j : j + len(k)]) == k:
                    hit |= set(range(j, j + len(k)))
                    met |= of
        want.append((-1 if i is None else i, len(w), len(hit), len(met), ",".join(sorted(map(str, met)))))
    for bound in (decontamination.MOST_BROADCAST, 0):
        decontamination.MOST_BROADCAST, was = bound, decontamination.MOST_BROADCAST
        got = decontamination.contamination(docs, bench).collect()
        decontamination.MOST_BROADCAST = was
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r.item_ids)) for r in got) == sorted(want)
    cleaned = decontamination.decontaminate(docs, bench)
    assert cleaned.columns == docs.columns and decontamination.decontaminate(empty, bench).count() == 0
    left = decontamination.contamination(cleaned, bench.where("item_id = 1"))
    assert left.where("contaminated").count() == 0
    assert docs.join(cleaned.select("doc_id", F.col("text").alias("t")), "doc_id").where("doc_id = 9 and text <> t").count() == 0
    assert decontamination.contamination(docs, bench.where("1 = 0")).where("n_hit > 0").count() == 0


def test_words_are_those_of_the_pattern(spark):
    import re

    rng = random.Random(21)
    some = ["".join(rng.choices([chr(c) for c in range(128)] + list("éß中😀İ\u2028"), k=60)) for _ in range(300)] + ["", " ", "a", "\x00a\x7fB"]
    lower = [t.translate(str.maketrans(decontamination.UPPER, decontamination.LOWER)) for t in some]
    got = spark.createDataFrame([(t,) for t in some], "text string").select(decontamination.words(F.col("text")).alias("w"), F.regexp_count("text", F.lit(decontamination.RUN)).alias("n")).collect()
    assert [r.w for r in got] == [re.findall(decontamination.WORD, t) for t in lower] and all(len(r.w) == r.n for r in got)


def test_decontaminate_joins_rows_and_not_ids(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(10))
    clean = " ".join(f"c{i}" for i in range(40))
    later = clean.replace("c20", f"c20 {passage}")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    own = [(None, f"{passage} {clean}"), (None, clean), (7, f"{passage} {clean}"), (7, later), (7, clean), (7, passage), (8, None), (8, ""), (9, clean), (9, clean), (9, later), (9, later)]
    docs = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    got = {}
    for bound in (decontamination.MOST_BROADCAST, 0):
        monkeypatch.setattr(decontamination, "MOST_BROADCAST", bound)
        out = decontamination.decontaminate(docs, items)
        assert out.columns == docs.columns
        got[bound] = sorted(map(str, map(tuple, out.collect())))
    # only the passage alone goes as a whole; all others come out without it
    assert got[0] == sorted(map(str, [(i, clean if t else t) for i, t in own if t != passage]))
    assert got[0] == got[max(got)]


def test_near_duplicates(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 3)  # groups in several blocks
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    links = [sum(bool(a) and len(a & b) / len(a | b) >= 0.8 for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    got = near_duplicates.near_duplicates(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_links) for r in got) == sorted((-1 if i is None else i, n) for (i, _), n in zip(rows, links))
    cls = {r.doc_id: r.class_id for r in got}
    assert cls[60] == 0 and cls[66] == 0 and cls[None] == 2 and cls[5] == 5
    kept = near_duplicates.deduplicate(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (0, 60, 66)").count() == 1 and kept.where("doc_id = 3").count() == 1
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_large_family(spark, monkeypatch):
    """Sixty variants of a text, of which some pairs pass the threshold and some don't, in blocks of seven."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    rng = random.Random(31)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(60):
        own = list(base)
        for _ in range(rng.choice((0, 1, 2, 4, 6, 9))):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    rows += [(100 + k, " ".join(f"y{k}{j}" for j in range(50))) for k in range(20)]
    sets = [frozenset(zip(*[t.split()[i:] for i in range(5)])) for _, t in rows]
    links = [sum(len(a & b) / len(a | b) >= 0.8 for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert [got[i].n_links for i, _ in rows] == links and len(set(links[:60])) > 5
    assert all(got[i].class_id == i for i in range(100, 120)) and len({got[i].class_id for i in range(60) if links[i]}) == 1


def test_hot_null_ids_are_split_and_keep_their_order(spark, tmp_path):
    rows = [(None, f"{chr(97 + k % 26)} text {k}") for k in range(200)] + [(k, f"t{k}") for k in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ids = PieceIds(BYTES)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"  # else so small a table is one task again
    spark.conf.set(setting, "false")
    manifest = token_files.write_token_files(d, BYTES, f"file://{tmp_path}/n")
    spark.conf.unset(setting)
    assert sum(r.n_docs > 0 for r in manifest.collect()) > 1 and max(r.n_docs for r in manifest.collect()) < 200
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == [(i, [*ids.by_library(t).tolist(), 0]) for i, t in order]
    assert fingerprints.compare_edited(d).count() == 220


def test_least_matches_never_drops_a_sure_link():
    assert all(m <= 0.55 * n for n, m in near_duplicates.least_matches(0.8, 1e-6)[:1]) and near_duplicates.least_matches(0.8, 1e-6)[-1][1] < 144


def test_token_files(docs, rows, empty, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "BATCH_SEQUENCES", 2)
    ids = PieceIds(BYTES)
    got = token_files.read_token_files(token_files.write_token_files(docs, BYTES, f"file://{tmp_path}/a", length=16)).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (i, t) in zip(got, order, strict=True):
        want = ids.by_library(t or "").tolist() + [0]
        assert (r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) == (i, at, want)
        at += len(want)
    assert token_files.token_files(empty, BYTES).count() == 0


@pytest.mark.parametrize("parts", [1, 51, 211])
def test_packing_does_not_depend_on_partitions(spark, parts, monkeypatch):
    monkeypatch.setattr(packing, "_pieces", lambda docs, *_: docs)
    rng = random.Random(8)
    sizes = [min(2048, max(1, int(rng.lognormvariate(5.5, 1.3)))) for _ in range(1500)]
    rows = [((k % parts) << packing.LOWER | k // parts, k, 0, 0, n, b"") for k, n in enumerate(sizes)]
    own = spark.createDataFrame([(f"{x}",) for x in ["a"]], "text string").select(F.lit(None).cast("long").alias("doc_id"), "text")
    pieces = spark.createDataFrame(rows, "key long, doc_id long, piece int, start long, length long, ids binary").repartition(parts)
    monkeypatch.setattr(packing, "keyed_text", lambda *_: pieces)
    got = packing.pack_documents(own, BYTES).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(got) == len(sizes) and len(bins) <= -(-sum(sizes) // 2048) * 1.01
    for own_parts in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own_parts)]).tolist()]
        assert [o for o, _ in sorted(own_parts)] == ends[:-1] and ends[-1] <= 2048


def test_sum_of_squares_takes_the_least_change():
    rng = random.Random(3)
    for eager in (True, False):
        own = packing.SumOfSquares(20, eager=eager)
        gaps = {}
        for _ in range(300):
            size = rng.randint(1, 20)
            total = lambda g: sum(v * v for v in collections.Counter(x for x in g.values() if 0 < x < 20).values())
            change = {b: total({**gaps, b: g - size}) for b, g in gaps.items() if g >= size}
            new = total({**gaps, -1: 20 - size})
            least = min([*change.values(), *([new] if eager or not change else [])])
            b, offset = own.place(size)
            assert offset == 20 - gaps.get(b, 20)
            gaps[b] = gaps.get(b, 20) - size
            assert total(gaps) == least
            gaps = {k: g for k, g in gaps.items() if g}
    assert len({b for b, _ in packing.pack([700] * 100, 2048)}) == 50


def test_packing(docs, rows, empty):
    got = packing.pack_documents(docs.coalesce(1), BYTES, capacity=64).collect()
    ids, total = PieceIds(BYTES), 0
    whole = collections.defaultdict(list)
    for r in got:
        whole[r.doc_id].append((r.start, r.ids))
    for i, t in rows:
        want = ids.by_library(t or "").astype("<u4").tobytes() + b"\0\0\0\0"
        total += len(want) // 4
        if [x for x, _ in rows].count(i) == 1:
            assert b"".join(b for _, b in sorted(whole[i])) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert len(bins) <= -(-total // 64) * 1.05 + 2
    assert packing.digest(packing.pack_documents(empty, BYTES)).count() == 0
    assert packing.digest(docs.limit(1).select(F.lit(b"abc").alias("ids"))).first().ids_crc32 == zlib.crc32(b"abc")


def test_language(spark, docs, empty):
    rng = random.Random(2)
    words = {"en": "the and of with this that from have".split(), "fr": "le la des avec dans pour être été".split(), "de": "der die und nicht mit über schön auch".split()}
    rows = [(i, " ".join(rng.choice(words[c]) for _ in range(30)), c) for i, c in enumerate(list(words) * 40)]
    d = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34!", "en"), (902, "", None)], "doc_id long, text string, lang string")
    held = language.in_fold(F.col("doc_id"), 5, 0)
    model = language.fit_on_sample(d.where(~held))
    got = {r.doc_id: r for r in language.identify(d, model).collect()}
    assert all(got[i].lang_pred == c for i, _, c in rows) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert language.identify(empty, model).count() == 0 and language.identify(docs, language.fit([], [])).where("lang_pred <> 'und'").count() == 0
    assert language.identify(docs, model, keep=True).columns[: len(docs.columns)] == docs.columns
    clash = d.select("doc_id", F.col("text").alias("body"), F.lit(7).alias("score"), F.lit("x").alias("Lang_Pred"), F.lit(1).alias("text"))
    kept = language.identify(clash, model, text_col="body", keep=True)
    assert kept.columns == ["doc_id", "body", "text", "lang_pred", "score", "ambiguous"]
    assert {r.doc_id: r.lang_pred for r in kept.collect()} == {i: r.lang_pred for i, r in got.items()}
    signs = spark.createDataFrame([(1, "\u00bd"), (2, "\u00b2 \u2460"), (3, "_9_"), (4, "\u00aa the"), (5, "the " * 50000)], "doc_id long, text string")
    assert [r.lang_pred for r in language.identify(signs, model).orderBy("doc_id").collect()] == ["und", "und", "und", "en", "en"]


def test_language_sample_is_bounded_and_even(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("lang"))
    seen = []

    def spy(rows, languages):
        seen.append(collections.Counter(languages))
        return language.LanguageModel([], language.codewords(0), np.zeros((1, 1)))

    was, language.fit_features = language.fit_features, spy
    try:
        language.fit_on_sample(d, most_per_language=40)
        language.fit_on_sample(d, most_per_language=40, most_docs=50)
        language.fit_on_sample(d.where("1 = 0"))
    finally:
        language.fit_features = was
    assert seen == [{"x": 40, "y": 40}, {"x": 25, "y": 25}, {}]


def test_plain_decoding_of_codewords():
    rng = np.random.default_rng(4)
    for n in (1, 2, 4, 6, 9):
        code = language.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n
        model = language.LanguageModel([str(k) for k in range(n)], code, np.zeros((1, 1)))
        margins = rng.normal(0, 2, (20, code.shape[1]))
        best, top, second = model.decode(margins)
        for m, b, p, q in zip(margins, best, top, second):
            loss = [sum(np.log1p(np.exp(-x * c)) for x, c in zip(m, row)) for row in code]
            share = sorted((np.exp(-x) / sum(np.exp(-y) for y in loss) for x in loss), reverse=True)
            assert b == int(np.argmin(loss)) and abs(p - share[0]) < 1e-6 and (n == 1 or abs(q - share[1]) < 1e-6)


def test_toxicity_learns_the_same_from_repeated_ids_in_any_order(spark):
    rng = random.Random(2)
    rows = [(k % 40, " ".join(rng.choices(WORD_LIST, k=8))) for k in range(80)]
    labels = spark.createDataFrame([(k, k % 3 == 0) for k in range(40)], "doc_id long, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    models = [toxicity.fit_on_sample(spark.createDataFrame(r, "doc_id long, text string").coalesce(1), labels) for r in (rows, rows[::-1])]
    assert models[0].terms == models[1].terms and np.allclose(models[0].weight, models[1].weight) and models[0].ids.tolist() == models[1].ids.tolist() and np.allclose(models[0].curve, models[1].curve)


def test_toxicity(spark, docs, empty):
    rng = random.Random(3)
    bad = ["foo", "bar", "baz"]
    rows = [(i, " ".join(rng.choices(WORD_LIST, k=40) + (rng.choices(bad, k=3) if i % 5 == 0 else []))) for i in range(600)]
    d = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(None, 1), (901, None)], "doc_id long, toxic int")
    held = language.in_fold(F.col("doc_id"), 4, 2)
    model = toxicity.fit_on_sample(d.where(~held), lab.where(~held))
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert all((got[i].score >= 0.3) == (i % 5 == 0) for i in range(600)) and got[900].score == got[901].score
    _, at, postings = model.index.blocks()
    dense = np.concatenate([p[at[:, b]] for b, p in enumerate(postings)], 1)
    assert set(model.terms) >= {*WORD_LIST, *bad} and (model.weight > 0).all()  # no term is left out
    for _, t in [*rows[:40], (0, "unknown words"), (0, "red")]:
        terms, v = model.vector(toxicity.frequencies(t))
        full = sum((w * dense[k] for k, w in zip(terms, v)), np.zeros(dense.shape[1]))
        best = np.sort(full[full > 0])[::-1][: toxicity.NEAREST]
        near, cosines = model.index.nearest(terms, v, toxicity.NEAREST)
        assert np.allclose(cosines, best, atol=1e-5)
        score, ids, _ = model.score(toxicity.frequencies(t))
        if not len(best):
            assert score == model.without
            continue
        w = [1 / (1.05 - min(c, 1.0)) for c in cosines]
        share = sum(a * model.labels[i] for a, i in zip(w, near)) / sum(w)
        z = model.curve @ [share, float(np.mean(cosines)), 1.0]
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-6 and list(ids) == list(near)
    same = toxicity.fit(["foo foo red"] * 70 + ["red blue"] * 70, [1] * 70 + [0] * 70, list(range(140)), 0.5)
    ids, cosines = same.index.nearest(*same.vector(toxicity.frequencies("foo foo red")), 15)
    assert len(ids) == 15 and ids.tolist() == sorted(ids.tolist()) and np.allclose(cosines, 1, atol=1e-5)  # ties go by number
    assert toxicity.score(empty, model).count() == 0 and toxicity.score(docs, toxicity.fit([], [], [], 0.0)).where("score > 0").count() == 0


CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    import re

    out = []
    for kind, pattern in CONTRACT.items():
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(x if k % 2 == 0 else 2 * x - 9 * (2 * x > 9) for k, x in enumerate(reversed(d))) % 10 == 0
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}
            if fine[kind]:
                out.append((kind, *m.span()))
    return out


def test_patterns_are_those_of_the_contract():
    rng = random.Random(13)
    bits = ["@", ".", "-", " ", "a", "Z9", "+", "(", ")", "0", "1", "25", "255", "256", "0000000001", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 123-4567", "é", "\n", "a@b.c", "..", "@@", "x.y@z-1.de", "%", "10.0.0.1"]
    some = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(20000)] + ["0000000001.1.1.1", "1" * 4000 + ".1.1.1", "a" * 50000 + "@b.cc " + "1 " * 30000]
    found = [0] * 4
    for t in some:
        got = personal_data.base_spans(t)
        assert sorted(got) == sorted(plain_base(t)), t
        for k, _, _ in got:
            found[personal_data.KINDS.index(k)] += 1
    assert min(found) > 100 and personal_data.base_spans("0000000001.1.1.1") == [("ip", 0, 16)]


def test_the_tagger_reads_every_place_where_a_span_could_be_accepted():
    rng = random.Random(21)
    name = lambda most: "".join(rng.choice("abz09-") for _ in range(rng.randint(1, most)))
    some = ["write to joe at example.com today", "mail ann at foo.co.uk now", "bob at " + "h" * 60 + " dot " + "g" * 200 + " dot com"]
    for _ in range(3000):
        at, dot = rng.choice(["@", " @ ", " at ", "[at]", " (AT) ", "{at} "]), rng.choice([".", " . ", " dot ", "[dot]", " (dot)", " ."])
        address = f"{name(9)}{at}{name(90)}" + "".join(dot + name(90) for _ in range(rng.randint(0, 3))) + dot + rng.choice(["com", "de", "Museum"])
        number = "".join(rng.choice("0123456789") + rng.choice(["", "", " ", " . ", "-", ") ("]) for _ in range(rng.randint(4, 20))) + "7"
        some.append(rng.choice(["", " ", "x" * 80 + " ", "é at "]) + rng.choice([address, number]) + rng.choice(["", " at home", ". The end", "." * 70]))
    met = 0
    for text in some:
        read = personal_data._stretches(text)
        for m in [*personal_data._ADDRESS.finditer(text), *personal_data._NUMBER.finditer(text)]:
            met += 1
            assert any(lo <= max(0, m.start() - 1) and m.end() <= hi for lo, hi in read), (text, m)
    assert met > 3000
    long = "1 2 " * 30000 + "x" * 500 + " joe at mail.org"
    read = personal_data._stretches(long)
    assert len(read) > 3 and max(b - a for a, b in read) <= personal_data.LONG and all(x[1] - y[0] >= personal_data.OVERLAP for x, y in zip(read, read[1:]) if y[0] < 120000)


def test_spans_that_overlap_give_way():
    base = [("email", 10, 20)]
    found = [("card", 0, 5), ("phone", 3, 9), ("ip", 5, 10), ("card", 19, 30), ("card", 20, 25), ("card", 20, 25), ("phone", 20, 28)]
    assert personal_data._apart(found, base) == [("card", 0, 5), ("ip", 5, 10), ("phone", 20, 28)]


def test_spelled_addresses_are_found():
    model = personal_data.fit(sorted({w for _, t in texts() if t for w in t.split() if len(w) < 20 and not any(c in "@0123456789" for c in w)} | set(WORD_LIST)))
    for text, wanted in (("write to joe at example.com today", "joe at example.com"), ("mail ann at foo.co.uk now", "ann at foo.co.uk")):
        found = [(k, a + lo, b + lo) for lo, hi in personal_data._stretches(text) for k, a, b in personal_data.tag(model, [text[lo:hi]])[0]]
        got = [text[a:b] for _, a, b in personal_data._added(text, personal_data.base_spans(text), found)]
        assert got == [wanted]
    for text in ("we look at home. The end", "they met at noon. Then they left"):
        assert not personal_data._added(text, [], personal_data.tag(model, [text])[0])


def test_tagger_adds_spans_of_held_out_lines(spark):
    model = personal_data.fit(["the", "and", "river", "stone", "ist", "pour", "le", "glass"])
    rng, rows, gold = random.Random(77), [], []
    for k in range(400):
        text, spans = personal_data._example(rng, ["moon", "paper", "avec", "und", "salt", "tree"])
        rows.append((k, text))
        gold += [(k, *s) for s in set(spans) - set(plain_base(text))]
    got = personal_data.find(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    added = {(r.doc_id, s.kind, s.start, s.end) for r in got for s in r.spans} - {(r.doc_id, s.kind, s.start, s.end) for r in got for s in r.base}
    right = len(added & set(gold))
    assert len(gold) > 200 and right >= 0.8 * len(gold) and right >= 0.9 * len(added), (right, len(added), len(gold))
    assert all((s.kind, s.start, s.end) in {(x.kind, x.start, x.end) for x in r.spans} for r in got for s in r.base)


def test_personal_data_keeps_columns_that_clash(spark):
    model = personal_data.fit(WORD_LIST, lines=300, epochs=1)
    d = spark.createDataFrame([(1, "a@b.de", 5, "x"), (None, None, 6, "y")], "doc_id long, body string, base int, text string")
    got = personal_data.find(d, model, text_col="body", keep=True)
    assert got.columns == ["doc_id", "body", "text", "base", "spans"]
    assert sorted((str(r.body), r.text, len(r.base)) for r in got.collect()) == [("None", "y", 0), ("[EMAIL]", "x", 1)]


def test_deduplicate_and_decontaminate_keep_columns_that_clash(spark):
    text = " ".join(f"w{k}" for k in range(60))
    passage = " ".join(f"p{k}" for k in range(10))
    rows = [(1, text, "a", "b", 1), (2, text, "c", "d", 2), (3, f"{passage} {text}", "e", "f", 3), (None, None, "g", "h", 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, t string, __t string, gone int").withColumnRenamed("doc_id", "Doc.Id")
    kept = near_duplicates.deduplicate(d, id_col="Doc.Id")
    assert kept.columns == d.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in d.collect() if r["Doc.Id"] != 2 and r["Doc.Id"] != 3)
    left = decontamination.decontaminate(d, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert left.columns == d.columns and sorted((str(r["Doc.Id"]), r.text, r.t, r["__t"], r.gone) for r in left.collect()) == sorted((str(i), text if i else None, a, b, g) for i, _, a, b, g in rows)


def test_tagger_gradient_and_personal_data(spark, docs, empty):
    t = tagger.Tagger.new(4, hidden=5)
    t.w = {k: v.astype(np.float64) for k, v in t.w.items()}
    x, y, live = personal_data.training_windows(["the", "of"], 4)
    _, g = t.gradient(x, y, live)
    for k in ("e", "xf", "hb", "o", "t"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        was, both = t.w[k][i], []
        for e in (1e-3, -1e-3):
            t.w[k][i] = was + e
            both.append(t.gradient(x, y, live)[0])
        t.w[k][i] = was
        assert abs((both[0] - both[1]) / 2e-3 - g[k][i]) < 1e-2 * max(1, abs(g[k][i]))
    model = personal_data.fit(WORD_LIST, lines=300, epochs=1)
    d = spark.createDataFrame([(1, "mail a.b@c.de and +1 (555) 123-4567, 10.0.0.1 and 4111 1111 1111 1111"), (2, None), (3, "4111 1111 1111 1112")], "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data.digest(personal_data.find(d, model)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1) and got[3].n_card == 0 and got[2].spans == ""
    assert got[1].base_sha256 == hashlib.sha256(b"email:5:13,ip:37:45,card:50:69,phone:18:35").hexdigest()
    masked = {r.doc_id: r.text for r in personal_data.find(d, model, keep=True).collect()}
    assert masked[1] == "mail [EMAIL] and [PHONE], [IP] and [CARD]" and masked[2] is None
    assert personal_data.find(empty, model).count() == 0 and personal_data.find(docs, model).count() == docs.count()
