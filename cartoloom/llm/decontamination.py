"""Benchmark decontamination with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoloom.llm.common import stored, unused

#: A word: neither ASCII punctuation, space nor control; the text is lower-cased (A to Z only) before.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing, and what lies between words.
CASED, BETWEEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All that stands between words but the space, and a word's characters said positively (the engine is faster at it).
SPLITS = "".join(chr(c) for c in (*range(32), *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 128)))
RUN = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
#: Tables of at most so many rows (windows, or positions under hits) are broadcast, larger ones are joined by shuffles.
MOST_BROADCAST = 200_000
#: A first filter has so many bits for each window, between bounds; any window passes it, and one in so many others.
BITS, LEAST_BITS, MOST_BITS = 64, 1 << 12, 1 << 23
#: A text's contents as a key: equal texts have equal hits, whatever their rows and ids.
KEY = ("t1", "t2")


def words(text: Column) -> Column:
    """Words in order, as :data:`WORD` finds them in lower-cased text; null text has none."""
    spaced = F.split(F.translate(text, UPPER + SPLITS, LOWER + " " * len(SPLITS)), " ")
    return F.coalesce(F.filter(spaced, lambda w: w != ""), F.array().cast("array<string>"))


def _folded(h: Column, at: Column, n: int) -> Column:
    """Three word hashes of a window, and its length, folded into a number."""
    return h[at].bitwiseXOR(F.shiftleft(h[at + n // 2], 1)).bitwiseXOR(F.shiftleft(h[at + n - 1], 2)).bitwiseXOR(F.lit(n).cast("long"))


def benchmark_windows(benchmark: DataFrame, *, length: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, window, length, key``: every run of ``length`` words, or the whole item where it has fewer, but any."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col).cast("string")).alias("w"))
    n = F.size("w")
    runs = F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length), lambda i: F.slice("w", i + 1, length))).when(n > 0, F.array("w"))
    cut = items.select("item_id", F.explode(runs).alias("run")).select("item_id", F.array_join("run", " ").alias("window"), F.size("run").alias("length"), F.transform("run", lambda x: F.xxhash64(x)).alias("h"))
    key = F.coalesce(*[F.when(F.col("length") == k, _folded(F.col("h"), F.lit(0), k)) for k in range(1, length + 1)])
    return cut.select("item_id", "window", "length", key.alias("key")).distinct()


def _slot(h: Column, at: Column, n: int, bits: int) -> tuple[Column, Column]:
    """A window's word in a bit map of so many bits, and the bit in it."""
    return F.shiftrightunsigned(_folded(h, at, n), 7).bitwiseAND(bits // 64 - 1).cast("int"), h[at + n - 1].bitwiseAND(63).cast("int")


def _bit_map(windows: DataFrame, bits: int, length: int) -> Column:
    """The windows' bits as a constant array; it grows with the benchmark up to a fixed size."""
    at = F.lit(0)
    slots = [(k, *_slot(F.col("h"), at, k, bits)) for k in range(1, length + 1)]
    word, bit = (F.coalesce(*[F.when(F.col("length") == k, x[i]) for k, *x in slots]) for i in (0, 1))
    own = windows.select("length", F.transform(F.split("window", " "), lambda x: F.xxhash64(x)).alias("h"))
    rows = own.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).collect()
    words = [0] * (bits // 64)
    for r in rows:
        words[r.word] = r.bit
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def _small(frame: DataFrame) -> bool:
    return frame.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def _sized(frame: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(frame) if small else frame


def content_key(text: Column) -> list[Column]:
    known = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(known).alias("t1"), F.xxhash64(F.lit(1), known).alias("t2")]


def occurrences(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """``t1, t2, pos, length, window``: where windows of the benchmark occur in whole texts.

    texts: ``text``; windows: from :func:`benchmark_windows`, read several times.  In the row, a word position stays if a
    bit map of the benchmark's windows has its bit.  These few become rows with their folded number, which meets the
    benchmark's numbers in a hash join; what is met is compared as text.  Up to ``MOST_BROADCAST`` windows the numbers and
    windows are broadcast, so nothing is shuffled.  Beyond it the numbers meet in a shuffled join without their
    texts, and texts with a hit are read again to cut out the windows.  The rows are the same either way.
    """
    few = _small(windows)
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())  # at most the words of a window
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS * windows.count() - 1).bit_length()))
    known = _bit_map(windows, bits, max(lengths, default=1))
    own = texts.select(*content_key(F.col("text")), "text")

    def places(h: Column) -> Column:
        def of(n: int) -> Column:
            def there(i: Column) -> Column:
                word, bit = _slot(h, i, n, bits)
                return F.getbit(known[word], bit) == 1

            some = F.filter(F.sequence(F.lit(0), F.size(h) - n), there)
            return F.when(F.size(h) >= n, F.transform(some, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("length"), _folded(h, i, n).alias("key"))))

        none = F.array().cast("array<struct<pos:int,length:int,key:bigint>>")
        return F.concat(none, *[F.coalesce(of(n), none) for n in lengths])

    kept = ["w"] if few else []
    split = own.select(*KEY, words(F.col("text")).alias("w")).select(*KEY, *kept, F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    every = split.select(*KEY, *kept, F.explode(places(F.col("h"))).alias("x")).select(*KEY, *kept, "x.*")
    met = every.join(_sized(windows.select("key").distinct(), few), "key", "left_semi")
    if not few:
        found = met.groupBy(*KEY).agg(F.collect_set(F.struct("pos", "length")).alias("x"))
        again = own.dropDuplicates(list(KEY)).join(found, list(KEY)).select(*KEY, words(F.col("text")).alias("w"), "x")
        met = again.select(*KEY, "w", F.explode("x").alias("x")).select(*KEY, "w", "x.*")
    cut = met.select(*KEY, "pos", "length", F.array_join(F.slice("w", F.col("pos") + 1, F.col("length")), " ").alias("window"))
    return cut.join(_sized(windows.select("window", "length").distinct(), few), ["window", "length"], "left_semi")


def _covered(hits: Column) -> Column:
    """Distinct word positions under hits."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["pos"], x["pos"] + x["length"] - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, *, length: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, item_ids, contaminated`` for every document.

    A document word inside any occurrence of a window is hit; ``item_ids`` are the items with occurring windows.
    Null and empty texts have no words.  Repeated rows and null ids give one row each; an empty benchmark hits
    nothing; a null item text has no windows.  Other columns are neither read nor returned.
    """
    windows = stored(benchmark_windows(benchmark, length=length))
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    met = occurrences(own.select("text"), windows)
    items = windows.groupBy("window", "length").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    met = met.join(_sized(items, _small(windows)), ["window", "length"])
    hits = met.groupBy(*KEY).agg(_covered(F.collect_set(F.struct("pos", "length"))).alias("gone"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    hits = stored(hits.select(*KEY, F.size("gone").cast("long").alias("n_hit"), "item_ids"))
    counted = F.coalesce(F.regexp_count("text", F.lit(RUN)), F.lit(0)).cast("long")
    rows = own.select("doc_id", *content_key(F.col("text")), counted.alias("n_words")).join(_sized(hits, _small(hits)), list(KEY), "left")
    none, n_hit = F.array().cast("array<string>"), F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), (n_hit > 0).alias("contaminated"))


def digest(rows: DataFrame) -> DataFrame:
    """The rows with a checksum in place of the list of items."""
    return rows.withColumn("items_sha256", F.sha2(F.array_join("item_ids", ","), 256)).drop("item_ids")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, length: int = 10, most: float = 0.5, text_col: str = "text") -> DataFrame:
    """Documents without the benchmark's windows, with their own columns, whatever their names.

    Hit words go, with what follows each up to the next word.  A document of which ``most`` of the words or more are
    hit goes as a whole.  Others keep their text as it is.  Null text stays null.  Hits are found per distinct text and
    joined to the documents by the text's contents, so ids play no part.
    """
    windows = stored(benchmark_windows(benchmark, length=length))
    t1, t2, gone, cut = (unused(docs, x) for x in ("t1", "t2", "gone", "cut"))
    met = occurrences(docs.select(F.col(f"`{text_col}`").cast("string").alias("text")), windows)
    hits = stored(met.groupBy(*KEY).agg(F.array_sort(_covered(F.collect_set(F.struct("pos", "length")))).alias("gone")))
    small = (hits.agg(F.sum(F.size("gone"))).first()[0] or 0) <= MOST_BROADCAST
    hits = _sized(hits.select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("gone").alias(gone)), small)
    text = F.col(f"`{text_col}`").cast("string")
    lead = F.when(text.rlike("^" + BETWEEN), 1).otherwise(0)

    def without(bound: Column) -> Column:
        # segment i belongs to word (i - lead) div 2, what comes before the first word to none
        kept = F.filter(
            F.regexp_extract_all(text, F.lit(f"{CASED}|{BETWEEN}"), F.lit(0)),
            lambda s, i: (i < bound["lead"]) | ~F.array_contains(bound["gone"], F.floor((i - bound["lead"]) / 2).cast("int")),
        )
        few = F.size(bound["gone"]) < F.greatest(F.lit(1), bound["n"]) * most
        return F.struct(few.alias("few"), F.array_join(kept, "").alias("text"))

    key = content_key(text)
    keyed = docs.select("*", key[0].alias(t1), key[1].alias(t2)).join(hits, [t1, t2], "left")
    # arrays of one element bind a value once; the generator drops the row whose document goes
    bound = F.transform(F.array(F.col(gone)), lambda g: F.struct(g.alias("gone"), lead.alias("lead"), F.regexp_count(text, F.lit(RUN)).alias("n")))
    whole = F.array(F.struct(F.lit(True).alias("few"), text.alias("text")))
    rows = keyed.withColumn(cut, F.explode(F.when(F.col(gone).isNull(), whole).otherwise(F.filter(F.transform(bound, without), lambda x: x["few"]))))
    return rows.select(*[F.col(cut)["text"].alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
