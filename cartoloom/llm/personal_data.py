"""Personal data: fixed patterns, and spans that a trained tagger adds."""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoloom.llm.common import arrow_rows, columns_of, keyed_text, slices, text_list, without_names
from cartoloom.llm.tagger import Tagger, classes

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What stands for the two signs of an address, spelled ones in brackets or between spaces; an address of them.
_AT, _DOT = r"(?: ?@ ?| ?[\[({]at[\])}] ?| at )", r"(?: ?\. ?| ?[\[({]dot[\])}] ?| dot )"
_REST = rf"{_AT}[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)*{_DOT}[a-z]{{2,}}"
_ADDRESS = re.compile(rf"[a-z0-9._%+-]+{_AT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*{_DOT}[a-z]{{2,}}", re.I)
#: Where an address may have its at sign, and how far it goes from there; digits with at most so many signs between them.
_AT_PLACE = re.compile(rf"(?<=[a-z0-9._%+-])(?=({_REST}))", re.I)
_GAP = 8
_NUMBER = re.compile(rf"[+(\[]{{0,3}}[0-9](?:[\x20.()\[\]/+-]{{0,{_GAP}}}[0-9])*[)\]]?")
#: Characters of context on either side of what may be a span, the window, and the step from window to window.
AROUND, WINDOW, STEP = 64, 64, 32
#: A longer stretch is read in pieces that overlap; the tagger adds no span longer than half an overlap.
LONG, OVERLAP = 1 << 15, 1024


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def fits(kind: str, s: str) -> bool:
    """What a string needs to pass as a kind, however it is written."""
    d = _digits(s)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "ip":
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts)
    return True


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind's pattern; those that fail its condition are dropped.

    An address is sought from its ``@``: the local part reaches back to the end of the match before, at most.
    """
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > end and _LOCAL.fullmatch(text[lo - 1]):
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", lo, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if fits("ip", m[0])]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if fits("card", m[0])]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if fits("phone", m[0])]
    return out


def _example(rng: random.Random, words: list[str]) -> tuple[str, list[Span]]:
    """A line with spans in plain and unusual writings among words and numbers that are none."""
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda: "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiou") + rng.choice(("", "", "n", "r", "s", "ll")) for _ in range(rng.randint(1, 3)))
    name = lambda: (re.sub("[^a-z]", "", rng.choice(words).lower()) if rng.random() < 0.6 else "") or letters()

    def card(sep: str) -> str:
        n = rng.choice((13, 15, 16, 16, 16, 19))
        d = digit(n - 1)
        d += next(c for c in "0123456789" if luhn(d + c))
        return sep.join(d[k : k + 4] for k in range(0, n, 4))

    def span() -> tuple[str, str]:
        kind = rng.choice(KINDS)
        if kind == "email":
            local = name() + rng.choice(("", rng.choice(".._-") + name(), rng.choice(("", ".", "_")) + digit(2)))
            at, dot = rng.choice((("@", "."),) * 4 + ((" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "."), (" @ ", "."), (" (at) ", " (dot) "), (" at ", " dot "), (" AT ", " DOT "), *((" at ", "."),) * 5, ("{at}", "{dot}")))
            end = rng.choice(("com", "org", "net", f"example{dot}com", "de", "fr", f"co{dot}uk"))
            return kind, f"{local}{at}{''.join(name() for _ in range(rng.choice((1, 1, 1, 1, 1, 6))))}{rng.choice(('', digit(1)))}{dot}{end}"
        if kind == "ip":
            return kind, rng.choice((".", ".", ".", ".", " . ", "[.]")).join(str(rng.randrange(256)) for _ in range(4))
        if kind == "card":
            return kind, card(rng.choice(("", "", " ", "-", ".", "/")))
        a, b, c = digit(3), digit(3), digit(4)
        return kind, rng.choice((f"+{digit(1)} ({a}) {b}-{c}", f"+{digit(2)} {a} {b} {c}", f"+{digit(1)}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digit(2)}{a}{b}{c}", f"00{digit(2)} {a} {b} {c}", f"{a}.{b}.{c}"))

    def other() -> str:
        if rng.random() < 0.3:
            return rng.choice((f"at {name()}", f"look at the dot {name()}", f"{name()} (at) home", f"at {digit(1)} {name()}", f"{name()}.{name()}", f"at the {name()}. {name()}", f"{name()} at {name()}. {name().capitalize()}", f"{name()} at {name()} {name()}"))
        return rng.choice((f"version {digit(1)}.{digit(1)}", f"token = \"{''.join(rng.choice('0123456789abcdef') for _ in range(40))}\"", f"19{digit(2)}", f"20{digit(2)}-0{rng.randint(1, 9)}-1{digit(1)}", f"{digit(2)}%", f"#{digit(3)}", f"{digit(1)}.{digit(1)}.{digit(1)}", f"@{name()}", f"{digit(1)},{digit(3)}", digit(rng.randint(1, 7)), f"{digit(2)}:{digit(2)}", f"CC BY-NC {digit(1)}.0", digit(20)))

    text, spans = "", []
    for _ in range(rng.randint(2, 4)):
        text += " ".join(rng.choice(words) if rng.random() < 0.6 else letters() for _ in range(rng.randint(1, 5))) + rng.choice((" ", " ", " ", "\n", ": "))
        if rng.random() < 0.6:
            kind, s = span()
            spans.append((kind, len(text), len(text) + len(s)))
            text += s
        else:
            text += other()
        text += rng.choice((" ", " ", " ", ". ", ", ", "&&& ", "\n"))
    return text, spans


def training_windows(words: list[str], n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, labels and live steps (time by window) of n labelled lines cut into windows."""
    rng = random.Random(seed)
    xs, ys, live = [], [], []
    for _ in range(n):
        text, spans = _example(rng, words)
        x, y = classes(text), np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            k = 1 + 2 * KINDS.index(kind)
            y[a:b] = k + 1
            y[a] = k
        lo = rng.randint(0, max(0, len(text) - WINDOW))
        x, y = x[lo : lo + WINDOW], y[lo : lo + WINDOW]
        pad = WINDOW - len(x)
        xs.append(np.pad(x, (0, pad)))
        ys.append(np.pad(y, (0, pad)))
        live.append(np.arange(WINDOW) < len(x))
    return np.array(xs).T, np.array(ys).T, np.array(live).T


@functools.lru_cache(maxsize=4)
def _fitted(words: tuple[str, ...], lines: int, epochs: int) -> Tagger:
    tagger = Tagger.new(len(KINDS))
    tagger.train(*training_windows(list(words) or ["the"], lines), epochs=epochs)
    return tagger


def fit(words: list[str], *, lines: int = 10000, epochs: int = 8) -> Tagger:
    """Train on labelled lines whose words are the given ones; the same words give the same tagger, trained once."""
    return _fitted(tuple(words), lines, epochs)


def fit_on_sample(docs: DataFrame, *, most_docs: int = 200, most_words: int = 200, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """Train with words of at most ``most_docs`` documents, those of least id hash, as surroundings.

    Of each document at most ``most_words`` distinct words from the whole text are taken, those of least hash.
    """
    own = keyed_text(docs, id_col, text_col)
    words = F.array_distinct(F.filter(F.split("text", r"\s+"), lambda w: (F.length(w) > 0) & (F.length(w) < 20) & ~w.rlike("[@0-9]")))
    some = F.slice(F.transform(F.array_sort(F.transform(words, lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w")))), lambda x: x["w"]), 1, most_words)
    least = own.where("doc_id is not null").select(F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(most_docs)
    picked = own.join(F.broadcast(least.select("doc_id").distinct()), "doc_id")  # ids first: texts of the picked ones only are cut
    got = picked.select("doc_id", some.alias("w")).groupBy("doc_id").agg(F.min("w").alias("w")).collect()
    return fit(sorted({w for r in got for w in r.w or ()}))


def _stretches(text: str) -> list[tuple[int, int]]:
    """Where the tagger reads: all that :func:`_added` could accept lies whole inside one of these, with its context.

    It accepts addresses by ``_ADDRESS`` and numbers by ``_NUMBER`` alone.  Each address has an at sign where ``_AT_PLACE``
    matches, and reaches from there at most to the start of its local part and to the end of that match; each number
    begins and ends with digits or brackets at them, and its digits lie no farther apart than the context.  A stretch
    beyond ``LONG`` comes in pieces, each span of which lies whole in one, so memory stays bounded.
    """
    places = [(m.start(), m.end()) for m in re.finditer("[0-9]+", text)]
    for m in _AT_PLACE.finditer(text):
        lo = m.start()
        while lo and _LOCAL.fullmatch(text[lo - 1]):
            lo -= 1
        places.append((lo, m.end(1)))
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(places):
        lo, hi = max(0, lo - AROUND), min(len(text), hi + AROUND)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return [(at, min(hi, at + LONG)) for lo, hi in out for at in range(lo, max(lo + 1, hi - OVERLAP), LONG - OVERLAP)]


def tag(tagger: Tagger, parts: list[str]) -> list[list[Span]]:
    """Spans of each text.  Windows overlap; their scores are averaged place by place (the middle of a window counts
    most) and one path is decoded over each whole text."""
    if not parts:
        return []
    coded = [classes(p) for p in parts]
    cuts = [(k, lo) for k, c in enumerate(coded) for lo in range(0, max(1, len(c) - WINDOW + STEP), STEP)]
    scores = [np.zeros((len(c), tagger.labels), np.float32) for c in coded]
    weight = [np.full(len(c), 1e-9, np.float32) for c in coded]
    middle = 1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.float32)
    for first in range(0, len(cuts), 2048):
        some = cuts[first : first + 2048]
        x = np.zeros((WINDOW, len(some)), np.uint8)
        for j, (k, lo) in enumerate(some):
            c = coded[k][lo : lo + WINDOW]
            x[: len(c), j] = c
        s = tagger.emissions(x)
        for j, (k, lo) in enumerate(some):
            n = min(WINDOW, len(coded[k]) - lo)
            scores[k][lo : lo + n] += s[:n, j] * middle[:n, None]
            weight[k][lo : lo + n] += middle[:n]
    out: list[list[Span]] = [[] for _ in parts]
    order = sorted(range(len(parts)), key=lambda k: len(coded[k]))
    first = 0
    while first < len(order):
        # like lengths together, at most about a million scores at once
        some = [order[first]]
        while first + len(some) < len(order) and (len(some) + 1) * len(coded[order[first + len(some)]]) <= 1 << 17:
            some.append(order[first + len(some)])
        first += len(some)
        steps = max(1, len(coded[some[-1]]))
        s, live = np.zeros((steps, len(some), tagger.labels), np.float32), np.zeros((steps, len(some)), bool)
        for j, k in enumerate(some):
            n = len(coded[k])
            s[:n, j], live[:n, j] = scores[k] / weight[k][:, None], True
        path = tagger.decode(s, live)
        for t, j in zip(*np.nonzero(path % 2), strict=True):
            k, end, inside = some[j], t + 1, path[t, j] + 1
            while end < steps and path[end, j] == inside:
                end += 1
            out[k].append((KINDS[(inside - 2) // 2], int(t), int(end)))
    return out


def _added(text: str, base: list[Span], found: list[Span]) -> list[Span]:
    """The tagger's spans that are new: trimmed, plausible for their kind, apart from the patterns' spans."""
    out = []
    for kind, a, b in found:
        while a < b and text[a].isspace():
            a += 1
        while b > a and (text[b - 1].isspace() or text[b - 1] in ".,;:-("):
            b -= 1
        if kind == "email" and (m := _ADDRESS.search(text, a, b)):
            a, b = m.span()  # the address alone, where the tagger took words before it too
        s = text[a:b]
        spaced = kind != "phone" or len(re.findall(r"[\x20().-]+", s)) >= 2
        address = (_ADDRESS if kind == "email" else _NUMBER).fullmatch(s)
        before, after = text[a - 1 : a], text[b : b + 1]
        whole = kind == "email" or not (before.isalnum() or after.isalnum())
        if b - a <= OVERLAP // 2 and fits(kind, s) and spaced and address and whole:
            out.append((kind, a, b))
    return _apart(out, base)


def _apart(found: list[Span], base: list[Span]) -> list[Span]:
    """Spans that overlap neither the patterns' nor one before them, from the left, the longest first."""
    out: list[Span] = []
    taken, end, k = sorted((a, b) for _, a, b in base), 0, 0
    for kind, a, b in sorted(set(found), key=lambda s: (s[1], -s[2])):
        while k < len(taken) and taken[k][0] < b:
            end, k = max(end, taken[k][1]), k + 1
        if a >= end:
            out.append((kind, a, b))
            end = b
    return out


def find(docs: DataFrame, tagger: Tagger, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Spans of personal data in whole texts: ``doc_id, base, spans`` (arrays of kind, start, end in code points).

    ``base`` are the patterns' spans; ``spans`` holds them and what the tagger adds, by kind, then start.  The tagger
    reads every place of the whole text where a span could be accepted, with its context (:func:`_stretches`).  Null text is empty.  Repeated rows give one row each.  With ``keep`` the table's columns come along and
    the text has the spans replaced by ``[KIND]`` (a null text stays null); columns named ``base`` or ``spans`` give
    way to the results.
    """
    rank = {k: i for i, k in enumerate(KINDS)}
    results = "base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>"
    own = without_names(docs, results) if keep else keyed_text(docs, id_col, text_col)
    read = text_col if keep else "text"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches):
            texts = text_list(batch, read)
            base = [base_spans(t) for t in texts]
            where = [(i, lo, hi) for i, t in enumerate(texts) for lo, hi in _stretches(t)]
            told: list[list[Span]] = [[] for _ in texts]
            for (i, lo, _), found in zip(where, tag(tagger, [texts[i][lo:hi] for i, lo, hi in where]), strict=True):
                told[i] += [(k, a + lo, b + lo) for k, a, b in found]
            spans = [b + _added(t, b, f) for t, b, f in zip(texts, base, told, strict=True)]
            rows = {c: batch.column(c) for c in batch.schema.names if keep or c != "text"}
            if keep:
                rows[read] = [None if t is None else redacted(x, s) for t, x, s in zip(batch.column(read).to_pylist(), texts, spans, strict=True)]
            for name, found in (("base", base), ("spans", spans)):
                rows[name] = [[{"kind": k, "start": a, "end": b} for k, a, b in sorted(set(f), key=lambda s: (rank[s[0]], s[1]))] for f in found]
            yield rows

    return arrow_rows(own, work, ", ".join([*(x for x in columns_of(own) if keep or not x.startswith("`text` ")), results]))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or chain of overlapping spans, as the kind of the first in brackets."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(rows: DataFrame) -> DataFrame:
    """Counts of the patterns' spans by kind, a checksum of them, and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
