"""Near duplicates: an n-gram Jaccard join with Bayesian pruning of MinHash candidates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoloom.llm.common import arrow_rows, keyed_text, slices, stored, text_list, unused
from cartoloom.llm.components import components
from cartoloom.llm.hashing import mixed

#: MinHash values: BANDS bands of ROWS.  Two texts of similarity 0.8 share no band with probability 6e-7.
BANDS, ROWS = 36, 5
#: Values compared at a time, and the posterior probability below which a pair is dropped.
STRIDE, TOLERANCE = 30, 1e-6
#: Members of a bucket or group that are compared at once; larger ones are split in blocks, compared two by two.
BLOCK = 400

_rng = np.random.default_rng(20)
_FLIP = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_words: dict[str, int] = {}


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of k words (lower case, split at white space).

    A text of fewer words, but any, is one run; a text without words has none.
    """
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > 400_000:
        _words.clear()
    for w in set(words):
        if w not in _words:
            _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ h[j : len(h) - k + 1 + j]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(mixed(out))


def signature(grams: np.ndarray) -> np.ndarray:
    """MinHash values of a set of hashes."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for lo in range(0, len(x), 2048):
        part = x[lo : lo + 2048]
        np.minimum(out, ((part[None, :] ^ _FLIP[:, None]) * _TIMES[:, None]).min(1), out=out)
    return out


def band_keys(sig: np.ndarray) -> list[int]:
    key = np.arange(BANDS, dtype=np.uint64)
    for column in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = mixed(key * np.uint64(0xFF51AFD7ED558CCD) ^ column)
    return key.view(np.int64).tolist()


@lru_cache
def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """After n values, how many must agree for a pair to stay.

    With a uniform prior the similarity given m agreements of n is Beta(m + 1, n - m + 1), and reaches t with the
    probability that a binomial of n + 1 trials at t comes to m at most.
    """
    out = []
    for n in range(STRIDE, BANDS * ROWS + 1, STRIDE):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def _pruned(sigs: np.ndarray, a: int, others: np.ndarray, threshold: float) -> np.ndarray:
    """Those of the others that may reach the threshold, a few values compared at a time."""
    agree, done = np.zeros(len(others), np.int64), 0
    for n, least in least_matches(threshold, TOLERANCE):
        agree += (sigs[others, done:n] == sigs[a, done:n]).sum(1)
        stay = agree >= least
        others, agree, done = others[stay], agree[stay], n
        if not len(others):
            break
    return others


def linked(sets: list[np.ndarray], sigs: np.ndarray, a: int, others: np.ndarray, threshold: float) -> np.ndarray:
    """Those of the others whose similarity to a reaches the threshold: pruned by agreement, then exact."""
    others = _pruned(sigs, a, others, threshold)
    if not len(others):
        return others
    own, sizes = sets[a], np.array([len(sets[b]) for b in others])
    joined = np.concatenate([sets[b] for b in others])
    at = np.searchsorted(own, joined)
    common = np.add.reduceat((own[np.minimum(at, len(own) - 1)] == joined).astype(np.int64), np.append(0, np.cumsum(sizes)[:-1]))
    return others[common >= threshold * (len(own) + sizes - common) - 1e-9]


class Forest:
    """Trees over numbers; the root of a tree is its least member."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)


def _chained(sigs: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
    """Pairs that survive pruning within a block, or between two, as one edge to the least member of each tree.

    Members that are connected already are not compared again.
    """
    tree = np.arange(len(sigs))
    alone = len(second) == 0
    for k, a in enumerate(first):
        others = first[k + 1 :] if alone else second
        for b in _pruned(sigs, a, others[tree[others] != tree[a]], threshold):
            x, y = tree[a], tree[b]
            if x != y:
                tree[tree == max(x, y)] = min(x, y)
    for i in np.flatnonzero(tree != np.arange(len(sigs))):
        yield int(i), int(tree[i])


def _group(weights: np.ndarray, sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """Links within a block, or between two, as sums for each member and one edge to the least of its tree."""
    sigs = np.stack([signature(s) for s in sets])
    forest = Forest(len(sets))
    links, texts = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    alone = len(second) == 0
    for k, a in enumerate(first):
        near = linked(sets, sigs, a, first[k + 1 :] if alone else second, threshold)
        if not len(near):
            continue
        links[a] += weights[near].sum()
        texts[a] += len(near)
        links[near] += weights[a]
        texts[near] += 1
        for b in near.tolist():
            forest.join(a, b)
    for i in np.flatnonzero(texts).tolist():
        yield i, int(links[i]), int(texts[i]), forest.root(i)


def _in_blocks(members: DataFrame, key: str, parts: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """Members of each key in blocks of bounded size; every two blocks of a key, and each block alone, meet in one call.

    ``work`` gets the members' rows as lists by column, sorted by node, and the places of the first and the second
    block (none for a block alone).
    """
    placed = members.join(parts, key).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    spread = placed.select(key, "part", "node", *columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    spread = spread.select(key, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple] = []
        now: tuple | None = None

        def done() -> Iterator[dict]:
            part = np.array([h[1] for h in held])
            first = np.flatnonzero(part == now[1])
            second = np.flatnonzero(part == now[2]) if now[1] != now[2] else np.zeros(0, np.int64)
            if len(held) > 1 and len(first) and (len(second) or now[1] == now[2]):
                yield from work([h[0] for h in held], [h[2:] for h in held], first, second)

        rows: list[tuple] = []
        for batch in batches:
            at = [batch.column(c).to_pylist() for c in (key, "i", "j", "node", "part", *columns)]
            for k, i, j, *row in zip(*at, strict=True):
                if (k, i, j) != now:
                    rows += done() if now else ()
                    held, now = [], (k, i, j)
                if not held or row[0] != held[-1][0]:  # a repeated row brings its node again
                    held.append(row)
            if rows:
                yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))
                rows = []
        rows += done() if now else ()
        if rows:
            yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    names = [c.split()[0] for c in schema.split(", ")]
    return arrow_rows(spread.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "node"), run, schema)


def _signed(own: DataFrame, words: int) -> DataFrame:
    """``doc_id, d, t, node, bands, low``: the set's 128-bit hash, its band keys and the low bytes of its MinHash values."""
    import xxhash

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches):
            out: dict[str, list] = {"node": [], "bands": [], "low": []}
            for text in text_list(batch):
                grams = shingles(text, words)
                sig = signature(grams) if len(grams) else None
                out["node"].append(xxhash.xxh3_128_digest(grams.tobytes()) if sig is not None else None)
                out["bands"].append(band_keys(sig) if sig is not None else None)
                out["low"].append(sig.astype(np.uint8).tobytes() if sig is not None else None)
            yield {c: batch.column(c) for c in ("doc_id", "d", "t")} | out

    return arrow_rows(own, sign, "doc_id long, d long, t long, node binary, bands array<long>, low binary")


def candidate_groups(nodes: DataFrame, threshold: float) -> DataFrame:
    """``node, label`` of every node that may have a link; linked nodes that share a band have the same label.

    nodes: ``node, bands, low``.  Nodes with an equal band of MinHash values meet in its bucket; buckets with the same
    members are visited once, large ones in blocks.  Pairs are compared a few values at a time (their low bytes, which
    only ever agree more often) and dropped once the posterior probability of reaching the threshold falls below the
    tolerance.  What is left makes the groups: a chance band or a common line connects nothing.  A task passes on one
    edge for each member, never pairs.
    """
    buckets = nodes.select("node", F.explode("bands").alias("band"))
    each = buckets.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    once = each.where("n > 1").groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    once = stored(once)

    def compare(ids: list[bytes], rows: list[tuple], first: np.ndarray, second: np.ndarray) -> Iterator[tuple]:
        sigs = np.frombuffer(b"".join(low for (low,) in rows), np.uint8).reshape(len(rows), -1)
        for i, j in _chained(sigs, first, second, threshold):
            yield ids[i], ids[j]

    # the buckets' members first, then their values, so that values travel for candidates only
    members = buckets.join(once.select("band"), "band").join(nodes.select("node", "low"), "node")
    group = components(_in_blocks(members, "band", once, ["low"], compare, "a binary, b binary"))
    return group.unionByName(group.select(F.col("label").alias("node"), "label").distinct())


def near_duplicates(docs: DataFrame, *, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, n_copies, n_links, n_texts, first`` for every document.

    Documents are linked if the Jaccard similarity of their sets of ``words``-word shingles is ``threshold`` or more.
    ``class_id`` is the least id of the documents that links connect, ``n_copies`` how many documents have the same set,
    ``n_links`` how many other documents are linked (copies too), ``n_texts`` how many other sets; ``first`` marks
    one document of each class.

    Equal sets become one node (a 128-bit hash of the set).  :func:`candidate_groups` connects nodes that share a band
    and survive Bayesian pruning of their MinHash values.  The members of a group meet once, in blocks of bounded size,
    two blocks to a task; each pair is pruned by the full values and what is left is verified exactly.  A task gives
    sums and one edge for each member, never pairs.

    A text without words is linked to nothing.  A repeated row is a copy of itself.  A null id is no class id unless
    all of its class are null.  Other columns are not read.
    """
    own = keyed_text(docs, id_col, text_col)
    own = own.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("doc_id", "text").alias("t"), "text")
    signed = stored(_signed(own, words))
    nodes = signed.where("node is not null").groupBy("node").agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("least"), F.min(F.struct("d", "t")).alias("x"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    nodes = stored(nodes.select("node", "n_copies", "least", "x.*", "bands", "low"))
    group = stored(candidate_groups(nodes, threshold))
    parts = group.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = group.join(nodes.select("node", "n_copies", "d", "t"), "node")
    members = own.select("d", "t", "text").join(placed, ["d", "t"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches):
            yield {c: batch.column(c) for c in ("label", "node", "n_copies")} | {"grams": [shingles(x, words).tobytes() for x in text_list(batch)]}

    members = arrow_rows(members, cut, "label binary, node binary, n_copies long, grams binary")

    def compare(ids: list[bytes], rows: list[tuple], first: np.ndarray, second: np.ndarray) -> Iterator[tuple]:
        weights = np.array([n for n, _ in rows], np.int64)
        sets = [np.frombuffer(g, np.uint64) for _, g in rows]
        for i, links, texts, root in _group(weights, sets, first, second, threshold):
            yield ids[i], links, texts, ids[root]

    found = stored(_in_blocks(members, "label", parts, ["n_copies", "grams"], compare, "node binary, links long, texts long, root binary"))
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("n_texts"))
    classes = nodes.select("node", "n_copies", "least", "d", "t").join(labels, "node", "left").join(sums, "node", "left")
    classes = classes.withColumn("label", F.coalesce("label", "node"))
    least = classes.groupBy("label").agg(F.min("least").alias("class_id"), F.min(F.struct("d", "t")).alias("kept"))
    classes = classes.drop("d", "t").join(least, "label").select("node", "class_id", "kept", "n_copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"))
    rows = signed.select("doc_id", "d", "t", "node").join(classes, "node", "left")
    return rows.select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce(F.col("links") + F.col("n_copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce(F.struct("d", "t") == F.col("kept"), F.lit(True)).alias("first"), "t",
    )


def deduplicate(docs: DataFrame, *, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their own columns, one of each class; of rows with equal id and text one stays."""
    found = near_duplicates(docs, words=words, threshold=threshold, id_col=id_col, text_col=text_col)
    i, t, j, u = (unused(docs, x) for x in ("i", "t", "j", "u"))
    stay = found.where("first").select(F.col("doc_id").alias(j), F.col("t").alias(u)).distinct()
    id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    marked = docs.select("*", id_.alias(i), F.xxhash64(id_, text).alias(t))
    once = marked.join(stay, F.col(i).eqNullSafe(F.col(j)) & (F.col(t) == F.col(u)), "left_semi")
    return once.dropDuplicates([i, t]).select(*[F.col(f"`{c}`") for c in docs.columns])
