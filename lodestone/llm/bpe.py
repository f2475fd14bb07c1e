"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

A word's tokens are found left to right. An Aho-Corasick automaton over the vocabulary lists all tokens
in the word; at each place the longest is tried first. A token may follow the one before it only if the
merges could leave just these two side by side, which a table of pair compatibility (filled on demand)
answers. If no token fits, the place is marked as unreachable and the last token gives way to its next
shorter one. Every place is given up at most once, so the work is linear in the word and the result is the
one that applying the merges in order gives.

The vocabulary file is the JSON of a byte-level BPE with an end-of-word suffix: lower-cased NFC text, cut
into words by the file's pattern. The driver reads it from a path and broadcasts it; its size is fixed.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Stands for the end-of-word suffix inside words; byte-level text never holds it.
END = "\ue000"
#: Words whose tokens are remembered, and known pairs; both are dropped when full.
CACHE_WORDS = 200_000
CACHE_PAIRS = 1 << 20

# The words of the word-level pattern for code points below U+0100, lower-cased.
LATIN_WORDS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    "|[^\t-\r \x85\xa00-9a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+"
)


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Bpe:
    """Codec for one tokenizer file; ``encode`` and ``decode`` match the library that the file belongs to."""

    def __init__(self, source: str):
        spec = json.loads(source)
        self.source = source
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.suffix = suffix
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        inner = {t.replace(suffix, END) if suffix and t.endswith(suffix) else t: i for t, i in model["vocab"].items()}
        size = max([*inner.values(), *self.special.values()]) + 1
        self.lengths = [0] * size
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in inner.items():
            self.lengths[i] = len(token)
            self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        ranks = []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = (x.replace(suffix, END) if suffix and x.endswith(suffix) else x for x in (a, b))
            i = inner[a + b]
            if (inner[a], inner[b]) not in self.merged:
                self.merged[inner[a], inner[b]] = i
                ranks.append(i)
            if self.left[i] == i:
                self.left[i], self.right[i] = inner[a], inner[b]
        if ranks != sorted(ranks):
            raise ValueError("token ids must be in merge order")
        table = byte_chars()
        self.from_byte = {b: c for b, c in enumerate(table)}
        self.to_byte = {c: b for b, c in enumerate(table)}
        names = [""] * size
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            names[i] = t
        # Offset table for decoding: every token's text and the blank that joins it to the next.
        texts = [f"{t} ".encode() for t in names]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self.blob = np.frombuffer(b"".join(texts), np.uint8)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}

    @cached_property
    def library(self) -> Tokenizer:
        """The library's tokenizer, for its normaliser; most workers never need it."""
        return Tokenizer.from_str(self.source)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges can leave tokens a and b side by side."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._check(a, b, len(self.lengths))
        return known

    def _check(self, a: int, b: int, limit: int) -> bool:
        """Undo the later of the two tokens' last merges again and again; a merge across the border that comes
        before the one just undone (or before ``limit``) would have been applied instead."""
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            a_whole, b_whole = self.right[a] == a, self.left[b] == b
            if a_whole and b_whole:
                return True
            if b_whole or (not a_whole and a > b):
                limit, a = min(limit, a), self.right[a]
            else:
                limit, b = min(limit, b + 1), self.left[b]

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one word of byte-level characters, END included where the file has a suffix."""
        size = len(word)
        fits: list[list[int]] = [[] for _ in range(size)]
        lengths = self.lengths
        for end, i in self.automaton.iter(word):
            fits[end + 1 - lengths[i]].append(i)
        if size > 1 and len(fits[0]) and lengths[fits[0][-1]] == size:
            whole = fits[0][-1]
            if self._intact(whole):
                return [whole]
        reachable = [True] * (size + 1)
        if self.suffix:
            reachable[size - 1] = False
        tokens: list[int] = []
        turn = [len(fits[0]) - 1]  # which of the tokens at each place is tried next
        at = 0
        while at < size:
            options, k = fits[at], turn[-1]
            last = tokens[-1] if tokens else -1
            while k >= 0:
                token = options[k]
                if reachable[at + lengths[token]] and (last < 0 or self.compatible(last, token)):
                    break
                k -= 1
            if k >= 0:
                turn[-1] = k - 1
                tokens.append(token)
                at += lengths[token]
                if at < size:
                    turn.append(len(fits[at]) - 1)
            elif tokens:
                reachable[at] = False
                turn.pop()
                at -= lengths[tokens.pop()]
            else:
                raise ValueError(f"no encoding of {word!r}")
        return tokens

    def _intact(self, token: int) -> bool:
        """Whether the merges turn a token's own text into it: its two halves must arise and stand side by side until its last merge."""
        a, b = self.left[token], self.right[token]
        if a == token:
            return True
        known = self.pairs.get((token, -1))
        if known is None:
            known = self.pairs[token, -1] = self._intact(a) and self._intact(b) and self._check(a, b, token)
        return known

    def split(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens, in ordinary characters."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            whole = self.library.normalizer.normalize_str(text)
            return [bytes(self.to_byte[c] for c in w).decode("utf-8", "replace") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(whole)]
        return LATIN_WORDS.findall(text.lower())

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers; special tokens' own texts become those tokens."""
        parts = self.specials.split(text) if self.specials and "<" in text else [text]
        out: list[bytes] = []
        words, from_byte = self.words, self.from_byte
        for part in parts:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            for w in self.split(part):
                ids = words.get(w)
                if ids is None:
                    if len(words) >= CACHE_WORDS:
                        words.clear()
                    level = w if w.isascii() and w.isprintable() else "".join([from_byte[b] for b in w.encode()])
                    ids = words[w] = np.array(self.encode_word(level + END if self.suffix else level), "<u4").tobytes()
                out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of the tokens, joined by blanks, special tokens included."""
        if not len(ids):
            return b""
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        at = np.cumsum(size)
        return self.blob[np.repeat(start - at + size, size) + np.arange(at[-1])].tobytes()[:-1]


_codecs: dict[int, Bpe] = {}


def _codec(source: str) -> Bpe:
    """One codec a Python worker, so that its caches last from task to task."""
    key = hash(source)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Bpe(source)
    return _codecs[key]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", payload: str = "ids") -> DataFrame:
    """One row per input row: id and, for ``payload="ids"``, ``ids`` (array of int) and ``decoded``; for
    ``"digest"``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    Null texts count as empty: no tokens. Whole texts are encoded. Extra columns are ignored.
    """
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared.value)
        for b in batches:
            out = []
            for text in b["__text"]:
                raw = codec.encode(text) if isinstance(text, str) else b""
                ids = np.frombuffer(raw, "<u4")
                text = codec.decode(ids.astype(np.int64))
                out.append((ids.astype(np.int32), text.decode()) if payload == "ids" else (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text).hexdigest()))
            columns = ["ids", "decoded"] if payload == "ids" else ["n_tokens", "ids_sha256", "decoded_sha256"]
            made = pd.DataFrame(out, columns=columns)
            made.insert(0, id_col, b["__id"].to_numpy())
            yield made

    # Ids travel as text, since pandas has no integers with nulls.
    rows = docs.select(F.col(id_col).cast("string").alias("__id"), F.col(text_col).alias("__text"))
    kinds = "ids array<int>, decoded string" if payload == "ids" else "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    made = rows.mapInPandas(run, f"`{id_col}` string, {kinds}")
    return made.withColumn(id_col, F.col(f"`{id_col}`").cast(docs.schema[id_col].dataType))
