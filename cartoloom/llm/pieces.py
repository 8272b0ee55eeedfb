"""Exact tokenisation, once per distinct pre-token or by an equal and faster engine."""

from __future__ import annotations

import functools
import json
import os
import re
from collections import Counter

import numpy as np

#: Separators that one regex dialect takes for white space and another does not: such texts are counted whole.
UNSURE = re.compile("[\x0b\x0c\x1c-\x1f\x85᠎﻿]")
#: Letters up to white space or punctuation, or any other run without white space.
CHUNK = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+(?![^\s!-/:-@\[-`{-~])|\S+")
#: The split before the merges of the byte-level vocabulary (a fixed value of the public vocabulary).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: One text in so many is encoded by both engines and compared, and the first one of each call.
COMPARED = 256


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a vocabulary file, once per worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(encoder) -> list[str]:
    """Strings that the library finds in a text before it lower-cases anything."""
    return [t.content for t in encoder.get_added_tokens_decoder().values()]


class PieceCounts:
    """Pre-tokens of a text and their pieces, for a vocabulary that lower-cases and drops white space.

    A pre-token never crosses white space nor the end of a run of letters, so a text falls apart into chunks that can
    be counted alone.
    """

    def __init__(self, path: str) -> None:
        self.encoder = tokenizer(path)
        self.special = special_strings(self.encoder)

    def frequencies(self, text: str) -> Counter | None:
        """How often each pre-token occurs; None for a text that must be counted whole.

        Those are texts with rare separators, and texts in which lower-casing makes a special string that was none.
        """
        if UNSURE.search(text):
            return None
        if text.isascii():
            low = text.lower()
            if any(low.count(s) != text.count(s) for s in self.special):
                return None
            text = low
        return Counter(CHUNK.findall(text))

    def whole(self, text: str) -> int:
        return len(self.encoder.encode(text, add_special_tokens=False))

    def counts(self, chunks: list[str]) -> list[int]:
        out: list[int] = []
        for lo in range(0, len(chunks), 8192):
            out += map(len, self.encoder.encode_batch_fast(chunks[lo : lo + 8192], add_special_tokens=False))
        return out


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def rank_encoding(path: str):
    """A byte-level BPE file as an encoding by ranks, or None where its ids are not its merge ranks."""
    import tiktoken

    with open(path, encoding="utf-8") as source:
        spec = json.load(source)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    odd = any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "dropout", "ignore_merges"))
    if model.get("type", "BPE") != "BPE" or not plain or odd or spec.get("normalizer"):
        return None
    byte = _byte_of()
    vocabulary, special = model["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if [vocabulary[t] for t in joined] != list(range(256, 256 + len(joined))) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        return None
    ranks = {bytes(byte[c] for c in t): k for t, k in vocabulary.items() if t not in special}
    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)


class PieceIds:
    """Ids of texts as the tokenizers library gives them, as little-endian unsigned 32-bit bytes.

    A byte-level vocabulary whose ids are its merge ranks is loaded from the same file into an engine that is many
    times faster.  All along, one text in ``COMPARED`` goes through both; a difference is an error, never passed over.
    Any other vocabulary is encoded by the library.
    """

    def __init__(self, path: str) -> None:
        self.library, self.ranks = tokenizer(path), rank_encoding(path)

    def by_library(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def by_ranks(self, text: str) -> np.ndarray:
        return self.ranks.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.ranks:
            return [self.by_library(t).tobytes() for t in texts]
        out = [self.by_ranks(t) for t in texts]
        for t, ids in list(zip(texts, out, strict=True))[::COMPARED]:
            if not np.array_equal(self.by_library(t), ids):
                raise ValueError(f"the two engines differ on a text of {len(t)} characters that begins {t[:60]!r}")
        return [ids.tobytes() for ids in out]


@functools.lru_cache(maxsize=2)
def piece_ids(path: str) -> PieceIds:
    """One per worker process, kept from task to task."""
    return PieceIds(path)


@functools.lru_cache(maxsize=2)
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)
