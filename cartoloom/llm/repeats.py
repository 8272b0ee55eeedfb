"""Removal of byte strings that occur more than once, by suffix arrays of shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoloom.llm.common import arrow_rows, keyed_text, slices, stored, text_list
from cartoloom.llm.hashing import gram_hashes
from cartoloom.llm.suffixes import permuted_common_prefixes, suffix_array

#: Bytes of the gram that decides where a string belongs.
GRAM = 128
#: Texts are read in stretches of this many starts, so that a very long one needs no more memory.
STRETCH = 1 << 20
#: A shard's strings are sorted in lots of about this many bytes; a class beyond the second bound is split.
LOT, CLASS = 1 << 20, 8 << 20


def owned(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which gram each window of ``length`` bytes belongs to: first and last window of each run, its gram's hash and place.

    A window belongs to the gram of least hash in it, the leftmost of equal ones.  That depends on the window's bytes
    alone, so equal windows anywhere belong to equal grams.
    """
    hashes = gram_hashes(data, gram)
    n, w = len(data) - length + 1, length - gram + 1
    place = np.arange(len(hashes), dtype=np.uint64)
    key = (hashes & ~np.uint64((1 << 24) - 1)) | place
    rows = -(-len(key) // w)
    grid = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(key)] = key
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    owner = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    last = np.append(first[1:], n) - 1
    return first, last, hashes[owner[first]].view(np.int64), owner[first]


def regions(docs: DataFrame, length: int) -> DataFrame:
    """``d, t, at, len, g, r``: the stretch of each document that belongs to one gram, and the hash of its bytes.

    The windows of a stretch are exactly the windows that belong to the gram; every window of a document is in one
    stretch, and equal windows are in stretches of equal ``g``.
    """
    import xxhash

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches, 256):
            out: dict[str, list] = {k: [] for k in ("d", "t", "at", "len", "g", "r")}
            for d, t, text in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist(), text_list(batch), strict=True):
                whole = text.encode()
                for lo in range(0, len(whole) - length + 1, STRETCH):
                    part = whole[lo : lo + STRETCH + length - 1]
                    first, last, g, _ = owned(np.frombuffer(part, np.uint8), length, min(GRAM, length))
                    sizes = last - first + length
                    out["d"] += [d] * len(g)
                    out["t"] += [t] * len(g)
                    out["at"] += (first + lo).tolist()
                    out["len"] += sizes.tolist()
                    out["g"] += g.tolist()
                    out["r"] += [xxhash.xxh3_64_intdigest(part[a : a + n]) - (1 << 63) for a, n in zip(first.tolist(), sizes.tolist(), strict=True)]
            if out["d"]:
                yield out

    return arrow_rows(docs, work, "d long, t long, at int, len int, g long, r long")


def _spans(starts: np.ndarray, length: int) -> list[dict]:
    """Byte spans covered by windows at sorted starts."""
    cut = np.flatnonzero(np.diff(starts) > length)
    lo, hi = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + length
    return [{"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]


def repeated_windows(strings: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each string the starts of its windows that occur more than once in all strings, a string counting by its weight.

    One suffix array over the strings; neighbours that agree in ``length`` bytes form groups.  An agreement never
    reaches beyond the end of a string.
    """
    sizes = np.array([len(x) + 1 for x in strings])
    data = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)  # no UTF-8 text has this byte
    ends = np.cumsum(sizes)
    left = np.repeat(ends - 1, sizes) - np.arange(len(data))
    symbols = np.append(data.astype(np.uint16) + 1, 0).astype(np.uint16)
    sa = suffix_array(symbols, 257)
    common = permuted_common_prefixes(data, sa)
    order = sa[1:]
    agree = np.minimum(common[order], left[order])
    agree[1:] = np.minimum(agree[1:], left[order[:-1]])
    agree[0] = 0
    group = np.cumsum(agree < length)
    own = left[order] >= length
    weight = np.repeat(np.array(weights, np.int64), sizes)[order] * own
    total = np.bincount(group, weight)
    again = np.zeros(len(data), bool)
    again[order] = own & (total[group] >= 2)
    starts = ends - sizes
    return [np.flatnonzero(again[a : a + n]) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _sorted_classes(members: DataFrame, length: int, shards: int) -> DataFrame:
    """Shards of whole classes, each sorted lot by lot: ``g, r, spans`` of every string with repeated windows.

    members: ``k`` (the class), ``g, r, shift`` (the string: part of which stretch, and where in it), ``m, bytes``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple] = []
        size = 0

        def lot() -> Iterator[dict]:
            found = repeated_windows([h[5] for h in held], [h[4] for h in held], length)
            rows = [(h[1], h[2], _spans(x + h[3], length)) for h, x in zip(held, found, strict=True) if len(x)]
            if rows:
                yield dict(zip(("g", "r", "spans"), map(list, zip(*rows, strict=True)), strict=True))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("k", "g", "r", "shift", "m", "bytes")), strict=True):
                if held and row[:4] == held[-1][:4]:
                    continue  # from a repeated row, weighed already
                if held and size >= LOT and row[0] != held[-1][0]:
                    yield from lot()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield from lot()

    dealt = members.repartition(shards, "k").sortWithinPartitions("k", "g", "r", "shift")
    return arrow_rows(dealt, work, "g long, r long, spans array<struct<lo:int,hi:int>>")


def halves(data: bytes, at: int, gram: int, length: int) -> Iterator[tuple[int, int, bytes]]:
    """A string in two, by what its windows hold beside the gram at a place: shift, the gram's new place, the bytes.

    Half of the bytes that a window has beside its gram are on one side at least: windows with as many to the left
    get a gram longer by these, the others one longer by those to the right.  Equal windows stay together.
    """
    more = -(-(length - gram) // 2)
    last = len(data) - length
    cut = at - more  # windows up to this start have `more` bytes before the gram
    if cut >= 0:
        yield 0, at - more, data[: min(last, cut) + length]
    if cut < last:
        first = max(0, cut + 1)
        yield first, at - first, data[first:]


def _split_classes(members: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Classes too large for a task, split until they fit: strings to be sorted, and spans of those that need no sorting.

    members: ``g, r, m, bytes``.  Each round makes the gram longer by half of what a window has beside it and splits
    every string in two, so classes part by their neighbourhood; after some rounds a string is one window and its class
    are equal windows, which are counted.
    """
    import xxhash

    gram = min(GRAM, length)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches, 64):
            data = batch.column("bytes").to_pylist()
            at = [int(owned(np.frombuffer(x, np.uint8), length, gram)[3][0]) for x in data]
            yield {c: batch.column(c) for c in ("g", "r", "m", "bytes")} | {"shift": [0] * len(data), "at": at}

    def split(width: int):
        more = -(-(length - width) // 2)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            names = ("g", "r", "m", "shift", "at", "bytes", "k")
            for batch in slices(batches, 64):
                rows = []
                for g, r, m, shift, at, data in zip(*(batch.column(c).to_pylist() for c in names[:-1]), strict=True):
                    for moved, place, part in halves(data, at, width, length):
                        rows.append((g, r, m, shift + moved, place, part, xxhash.xxh3_64_intdigest(part[place : place + width + more], 1) - (1 << 63)))
                if rows:
                    yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

        return work

    fields = "g long, r long, m long, bytes binary, shift int, at int"
    rest, ready = arrow_rows(members, whole, fields), None
    while gram < length:
        rest = stored(arrow_rows(rest, split(gram), fields + ", k long"))
        gram += -(-(length - gram) // 2)
        sizes = rest.groupBy("k").agg(F.sum(F.length("bytes")).alias("size"))
        sized = stored(rest.join(sizes, "k"))
        fit = sized.where(F.col("size") <= CLASS).select("k", "g", "r", "shift", "m", "bytes")
        ready = fit if ready is None else ready.unionByName(fit)
        rest = sized.where(F.col("size") > CLASS).drop("size", "k")
        if rest.isEmpty():
            break
    one = rest.select("g", "r", "shift", "m", F.xxhash64("bytes").alias("a"), F.xxhash64(F.lit(1), "bytes").alias("b"))
    again = one.groupBy("a", "b").agg(F.sum("m").alias("total")).where("total > 1")
    equal = one.join(again, ["a", "b"]).select("g", "r", F.array(F.struct(F.col("shift").alias("lo"), (F.col("shift") + length).alias("hi"))).alias("spans"))
    if ready is None:
        ready = members.select(F.lit(0).cast("long").alias("k"), "g", "r", F.lit(0).alias("shift"), "m", "bytes").where("1 = 0")
    return ready, equal


def repeated_spans(docs: DataFrame, *, length: int = 400) -> DataFrame:
    """``d, t, covers`` of every document with a string of ``length`` bytes that starts anywhere else too.

    docs: ``d, t, text`` (see :func:`keyed`).  Stretches of equal bytes become one string with a weight; they are told
    by two 64-bit hashes, of their gram and of all their bytes.  A class (the strings of one gram) that weighs one has
    no repeats; one string that weighs more repeats as a whole; all others are fetched and sorted, classes beyond
    ``CLASS`` bytes after they have been split.
    """
    parts = stored(regions(docs, length))
    per = parts.groupBy("g", "r").agg(F.count("*").alias("m"), F.min(F.struct("d", "t", "at", "len")).alias("first"))
    sums = per.groupBy("g").agg(F.sum("m").alias("total"), F.count("*").alias("kinds"), F.sum("first.len").alias("size")).where("total > 1")
    classes = stored(per.join(sums, "g").select("g", "r", "m", "first.*", "kinds", "size"))
    several = classes.where("kinds > 1")
    wanted = several.groupBy("d", "t").agg(F.collect_list(F.struct("g", "r", "m", "at", "len", "size")).alias("wanted"))
    cut = F.transform("wanted", lambda x: F.struct(x["g"].alias("g"), x["r"].alias("r"), x["m"].alias("m"), (x["size"] > CLASS).alias("large"), F.col("text").cast("binary").substr(x["at"] + 1, x["len"]).alias("bytes")))
    members = docs.join(wanted, ["d", "t"]).select(F.explode(cut).alias("x")).select("x.*")
    total = several.agg(F.sum("len").alias("all"), F.max("size").alias("most")).first()
    shards = int((total["all"] or 0) // (2 * LOT)) + 1
    sortable, equal = members.select(F.col("g").alias("k"), "g", "r", F.lit(0).alias("shift"), "m", "bytes", "large"), None
    if (total["most"] or 0) > CLASS:
        members = stored(members)  # repeated rows bring a string more than once; what is sorted passes over them
        split, equal = _split_classes(members.where("large").drop("large").dropDuplicates(["g", "r"]), length)
        sortable = members.where("not large").select(F.col("g").alias("k"), "g", "r", F.lit(0).alias("shift"), "m", "bytes").unionByName(split)
    found = _sorted_classes(sortable.drop("large"), length, shards)
    alone = classes.where("kinds = 1").select("g", "r", F.array(F.struct(F.lit(0).alias("lo"), F.col("len").alias("hi"))).alias("spans"))
    spans = alone.unionByName(found) if equal is None else alone.unionByName(found).unionByName(equal)
    # plain shuffles on both sides: the reader splits a stretch that a large part of all documents share
    hits = parts.join(spans, ["g", "r"])
    covers = F.transform("spans", lambda x: F.struct((F.col("at") + x["lo"]).alias("lo"), (F.col("at") + x["hi"]).alias("hi")))
    return hits.groupBy("d", "t").agg(F.flatten(F.collect_set(covers)).alias("covers"))  # repeated rows bring the same spans


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, d, t, text``; d and t, the id and a hash of id and text, are never null and name a row's contents."""
    own = keyed_text(docs, id_col, text_col)
    return own.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("doc_id", "text").alias("t"), "text")


def remove_repeats(docs: DataFrame, *, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document without the bytes that a repeated string of ``length`` bytes covers.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept``; ``kept`` are the remaining bytes (binary, since a cut may fall
    inside a character).  Overlaps count, strings are judged on the input, matches never cross documents.  Null text
    is empty, texts shorter than ``length`` stay whole, a repeated row counts as another document.  Other columns are
    neither read nor returned.
    """
    own = keyed(docs, id_col, text_col)
    covers = repeated_spans(own.select("d", "t", "text"), length=length)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches, 256):
            rows = []
            for text, spans in zip(text_list(batch), batch.column("covers").to_pylist(), strict=True):
                data = text.encode()
                kept, end, removed, runs = [], 0, 0, 0
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                    if lo > end or not runs:
                        kept.append(data[end:lo])
                        runs, removed, end = runs + 1, removed + hi - lo, hi
                    elif hi > end:
                        removed, end = removed + hi - end, hi
                kept.append(data[end:])
                rows.append((len(data), removed, runs, b"".join(kept)))
            yield {"doc_id": batch.column("doc_id")} | dict(zip(("n_bytes", "n_removed", "n_spans", "kept"), map(list, zip(*rows, strict=True)), strict=True))

    joined = own.join(covers, ["d", "t"], "left").select("doc_id", "text", "covers")
    return arrow_rows(joined, work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(rows: DataFrame) -> DataFrame:
    """The rows with a checksum in place of the bytes that stay."""
    return rows.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")

