"""Phrase collocations: candidates from sketch bounds, counted by automata, scored exactly."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartoloom.llm.common import arrow_rows, settled, text_list

#: Bytes that end a piece of text; blanks and tabs end a word.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + PIECE_ENDS + b"\t", bytes(range(97, 123)) + b"." * len(PIECE_ENDS) + b" ")
#: Bytes of text that one automaton scans (a longer text is one shard), and counters in a block of the sketch.
SHARD, BLOCK = 6 << 20, 1 << 16
#: Sums that a task holds before it passes them on, and candidates in a bucket.
HELD = 400_000
#: The sketch has at most so many counters (as a power of two); tasks and driver get one bit of each, 64 MB at most.
MOST_BITS = 29
#: Copies of what many candidates look up: the words of a language, and those of single words.
COPIES, WORD_COPIES = 64, 16


def folded(text: str) -> bytes:
    """Lower-case A-Z; every end of a piece is a full stop between blanks, every other divider a blank."""
    return text.encode().translate(_FOLD).replace(b".", b" . ")


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Shard:
    """The words of some texts of one language: their numbers (0 ends a piece), and sketch cells of their phrases."""

    def __init__(self, lang: str, texts: list[bytes], bits: int) -> None:
        self.lang, self.words = lang, b" . ".join([*texts, b""]).split()
        numbers = _Numbers({b".": 0})
        self.ids = np.fromiter(map(numbers.__getitem__, self.words), np.int64, len(self.words))
        self.distinct = len(numbers)
        ends = np.flatnonzero(self.ids == 0)
        self.room = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(self.ids))
        seed = xxhash.xxh3_64_intdigest(lang)
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in numbers), np.uint64, len(numbers))[self.ids]
        self.bits = bits

    def cells(self, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each number of words up to the longest, the cell of the phrase that starts at each word."""
        h = self.hashes
        for n in range(1, longest + 1):
            if n > 1:
                h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[n - 1 :]
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
            yield n, (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)

    def possible(self, maps: list[np.ndarray], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``n, starts, cells`` of the phrases whose own cell and whose shorter phrases' cells reach the bound.

        The first bit map is of phrases of one and two words, the second of longer ones; without the second the longer
        ones are judged by their shorter phrases alone, for that is what it is made from.
        """
        before = None
        for n, cell in self.cells(longest):
            ok = self.room[: len(cell)] >= n
            if maps and before is not None:
                ok &= before[:-1] & before[1:]
            at = np.flatnonzero(ok)
            known = maps[0] if n <= 2 and maps else maps[1] if n > 2 and len(maps) > 1 else None
            if known is not None:
                c = cell[at]
                at = at[(known[c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 > 0]
                ok = np.zeros(len(cell), bool)
                ok[at] = True
            before = ok
            yield n, at, cell[at]

    def counts(self, maps: list[np.ndarray], longest: int) -> tuple[list[bytes], np.ndarray]:
        """Candidates of the shard, and how often an automaton of them all finds each in it, overlaps included."""
        code, found = np.full(len(self.ids) + 1, -1, np.int64), []
        for n, at, _ in self.possible(maps, longest):
            if not len(at):
                break
            # a phrase is told by the number of its first words and its last word, so equal numbers are equal phrases
            key = self.ids[at] if n == 1 else code[at] * self.distinct + self.ids[at + n - 1]
            _, first, number = np.unique(key, return_index=True, return_inverse=True)
            code = np.full(len(self.ids) + 1, -1, np.int64)
            code[at] = number
            found += [b" ".join(self.words[i : i + n]) for i in at[first].tolist()]
        if not found:
            return [], np.zeros(0, np.int64)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, phrase in enumerate(found):
            automaton.add_word(f" {phrase.decode()} ", k)  # whole words only: blanks stand on both sides
        automaton.make_automaton()
        text = f" {b' '.join(self.words).decode()} "
        hits = np.fromiter((k for _, k in automaton.iter(text)), np.int64)
        return found, np.bincount(hits, minlength=len(found))


def shards(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[Shard]:
    """The texts of a task by language, in shards of a bounded size."""
    held: dict[str, list[bytes]] = {}
    size, total = {}, 0
    for batch in batches:
        for lang, text in zip(text_list(batch, "lang"), text_list(batch), strict=True):
            if not text:
                continue
            data = folded(text)
            held.setdefault(lang, []).append(data)
            size[lang] = size.get(lang, 0) + len(data)
            total += len(data)
            if size[lang] > SHARD or total > 4 * SHARD:
                most = max(size, key=size.__getitem__)
                total -= size.pop(most)
                yield Shard(most, held.pop(most), bits)
    for lang, texts in held.items():
        yield Shard(lang, texts, bits)


def sketch_bits(n_bytes: int, most_bits: int) -> int:
    """Size of the sketch: a counter for some 64 bytes of text, so that what is rare adds up to little in one."""
    return max(16, min(most_bits, math.ceil(math.log2(n_bytes / 64 + 1))))


def sketch(texts: DataFrame, maps: list[np.ndarray], bits: int, longest: int, least: int) -> np.ndarray:
    """Bit map of the counters of a hashed count sketch that reach ``least``.

    Without maps it counts phrases of one and two words, with the first map those of three words and more whose pairs
    reach the bound there.  Tasks pass on the counters of each shard by block, as places and counts; the blocks are
    summed in the stream of a task that holds only their counters.  A counter is never less than the true count of any
    phrase in it, so no candidate is lost, whatever the size.  The driver gets one bit of each counter.
    """
    kind = np.dtype(np.min_scalar_type(least))  # ``least`` and more is all the same
    sent = texts.sparkSession.sparkContext.broadcast(maps)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for shard in shards(batches, bits):
            got = [c for n, _, c in shard.possible(sent.value, longest if maps else min(2, longest)) if n > 2 or not maps]
            cell, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            n = np.minimum(n, least).astype(kind)
            block, start = np.unique(cell >> np.uint64(16), return_index=True)
            place, end = (cell & np.uint64(BLOCK - 1)).astype(np.uint16), [*start[1:], len(cell)]
            for k in range(0, len(block), 256):
                own = list(zip(start[k : k + 256], end[k : k + 256]))
                yield {"block": block[k : k + 256].astype(np.int64), "place": [place[a:b].tobytes() for a, b in own], "n": [n[a:b].tobytes() for a, b in own]}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, place, n in zip(*(batch.column(c).to_pylist() for c in ("block", "place", "n")), strict=True):
                row, at = sums.setdefault(block, np.zeros(BLOCK, kind)), np.frombuffer(place, np.uint16)
                row[at] = np.minimum(row[at].astype(np.int64) + np.frombuffer(n, kind), least)
        for block, row in sums.items():
            yield {"block": [block], "map": [np.packbits(row >= least, bitorder="little").tobytes()]}

    parts = arrow_rows(texts, count, "block long, place binary, n binary").repartition(min(1 << max(0, bits - 16), _partitions(texts)), "block")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in arrow_rows(parts, add, "block long, map binary").toLocalIterator():  # one bit of each counter: bounded by MOST_BITS
        out[r.block * (BLOCK // 8) : (r.block + 1) * (BLOCK // 8)] = np.frombuffer(r.map, np.uint8)
    return out


def _partitions(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def phrase_counts(docs: DataFrame, *, least: int = 100, longest: int = 5, most_bits: int = MOST_BITS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, phrase, n``: every phrase of up to ``longest`` words that occurs ``least`` times in a language, exactly.

    The empty phrase counts all words.  Three scans: the sketch of short phrases, that of longer ones whose parts reach
    the bound, and the automata: in each shard the phrases whose counters reach the bound make one automaton, which
    counts all their matches in the shard.  Tasks add up their shards and pass the sums on in buckets of phrases, as many
    as the sketch has counters at the bound, so that a bucket fits a task; the sums over all tasks decide.  Null
    languages are ``und``.
    """
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    bits = sketch_bits(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0, most_bits)
    maps: list[np.ndarray] = []
    for _ in range(2 if longest > 2 else 1):
        maps.append(sketch(texts, maps, bits, longest, least))
    sent = docs.sparkSession.sparkContext.broadcast(maps)
    most = sum(int(np.bitwise_count(m).sum(dtype=np.int64)) for m in maps)  # counters that reach the bound: some number of candidates
    buckets = max(_partitions(texts), most // HELD)

    def packed(sums: dict[tuple[str, str], int]) -> dict:
        rows: dict[int, list] = {}
        for (lang, phrase), n in sums.items():
            rows.setdefault(xxhash.xxh3_64_intdigest(phrase) % buckets, []).append((lang, phrase, n))
        return {"bucket": list(rows), "lang": [[x[0] for x in r] for r in rows.values()], "phrase": [[x[1] for x in r] for r in rows.values()], "n": [[x[2] for x in r] for r in rows.values()]}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums: Counter = Counter()
        for shard in shards(batches, bits):
            found, n = shard.counts(sent.value, longest)
            sums[shard.lang, ""] += int((shard.ids > 0).sum())
            for phrase, k in zip(found, n.tolist(), strict=True):
                sums[shard.lang, phrase.decode()] += k
            if len(sums) > HELD:
                yield packed(sums)
                sums = Counter()
        if sums:
            yield packed(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums: Counter = Counter()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase", "n")), strict=True):
                for lang, phrase, n in zip(*row, strict=True):
                    sums[lang, phrase] += n
        kept = [(lang, phrase, n) for (lang, phrase), n in sums.items() if n >= least or not phrase]
        yield {c: [r[k] for r in kept] for k, c in enumerate(("lang", "phrase", "n"))}

    parts = arrow_rows(texts, count, "bucket long, lang array<string>, phrase array<string>, n array<long>").repartition(buckets, "bucket")
    return settled(arrow_rows(parts, add, "lang string, phrase string, n long"))


def _words(phrase: str = "phrase") -> Column:
    return F.split(phrase, " ")


def independent(candidates: DataFrame, percent: int = 100) -> DataFrame:
    """Candidates (``lang, phrase, a``) without those inside a longer one with at least that percentage of their count.

    Whatever lies between two nested phrases is at least as frequent as the longer, so one word more is enough to look at.
    """
    w = _words()
    inner = F.array(F.array_join(F.slice(w, 1, F.size(w) - 1), " "), F.array_join(F.slice(w, 2, F.size(w) - 1), " "))
    around = candidates.where(F.size(w) > 2).select("lang", F.explode(inner).alias("phrase"), F.lit(None).cast("long").alias("a"), F.col("a").alias("around"))
    own = candidates.select("lang", "phrase", "a", F.lit(None).cast("long").alias("around"))
    both = own.unionByName(around).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("around").alias("around"))
    kept = F.col("around").isNull() | (F.col("around").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * percent)
    return both.where(F.col("a").isNotNull() & kept).select("lang", "phrase", "a")


def scored(candidates: DataFrame, counts: DataFrame, longest: int) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of the lowest-scoring cut, the first of equal ones.

    Every candidate looks up its parts and its language's words in ``counts``.  A single word is part of many
    candidates and a language of most, so these have copies of their counts, dealt by the candidate.
    """
    w = _words()
    cut = lambda k: F.array(F.struct((2 * k - 1).alias("slot"), F.array_join(F.slice(w, 1, k), " ").alias("part")), F.struct((2 * k).alias("slot"), F.array_join(F.slice(w, k + 1, F.size(w) - k), " ").alias("part")))
    parts = F.concat(F.array(F.struct(F.lit(0).alias("slot"), F.lit("").alias("part"))), F.flatten(F.transform(F.sequence(F.lit(1), F.size(w) - 1), cut)))
    copies = lambda part: F.when(F.col(part) == "", COPIES).when(~F.col(part).contains(" "), WORD_COPIES).otherwise(1)
    asked = candidates.select("lang", "phrase", "a", F.explode(parts).alias("x")).select("lang", "phrase", "a", "x.slot", "x.part")
    asked = asked.withColumn("copy", F.pmod(F.xxhash64("phrase"), copies("part")).cast("int"))
    there = counts.select("lang", F.col("phrase").alias("part"), "n").withColumn("copy", F.explode(F.sequence(F.lit(0), copies("part") - 1)))
    got = asked.join(there, ["lang", "part", "copy"])
    slots = range(1, 2 * longest - 1)
    wide = got.groupBy("lang", "phrase", "a").agg(F.max(F.when(F.col("slot") == 0, F.col("n"))).alias("words"), *[F.max(F.when(F.col("slot") == s, F.col("n"))).alias(f"n{s}") for s in slots])
    # decimals of 38 digits hold every product here, and div is the whole quotient
    score = "(1000 * cast(a as decimal(19,0)) * cast(words as decimal(19,0))) div (cast(n{0} as decimal(19,0)) * cast(n{1} as decimal(19,0)))"
    cuts = [F.when(F.col(f"n{2 * k}").isNotNull(), F.struct(F.expr(score.format(2 * k - 1, 2 * k)).alias("score"), F.lit(k).alias("k"), F.col(f"n{2 * k - 1}").alias("l"), F.col(f"n{2 * k}").alias("r"))) for k in range(1, longest)]
    best = F.array_min(F.array_compact(F.array(*cuts)))
    return wide.select("lang", "phrase", "a", best.alias("best"), F.col("words").alias("n")).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def collocations(docs: DataFrame, *, least: int = 100, longest: int = 5, percent: int = 100, top: int = 2000, most_bits: int = MOST_BITS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's best phrases: ``lang, rank, phrase, a, l, r, n, score``.

    Null text has no words, a null language is ``und``; repeated rows count each time; an empty table has no phrases.
    Ties in score go by count, then by phrase in byte order.  Other columns are not read.
    """
    counts = phrase_counts(docs, least=least, longest=longest, most_bits=most_bits, text_col=text_col, lang_col=lang_col)
    candidates = counts.where(F.col("phrase").contains(" ")).withColumnRenamed("n", "a")
    ranked = scored(independent(candidates, percent), counts, longest)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each share of a language first, so that its last step sees a bounded number of rows
    for share in (F.pmod(F.xxhash64("phrase"), F.lit(COPIES)), F.lit(0)):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
