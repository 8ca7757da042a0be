"""BPE encoding and decoding with a contiguous rank array.

A word is a list of parts with the merge rank of each adjacent pair beside it.
The smallest rank is found by scanning, its boundary is deleted and the two
neighbouring ranks are looked up again, until no pair has a rank.  Words are
short, so scanning beats a queue; one of over SHORT parts (a run of a hundred
thousand letters, say) is merged with a heap to the same result.  Distinct
words are kept in a bounded cache for the length of a task.

The text rules are those of the tokenizer file (public "word BPE": NFC, white
space dropped, lower case letter by letter, contractions, runs of letters,
single numerals, runs of the rest, bytes as symbols, an end mark on the last).

Defined cases: null text is empty text; empty text has no tokens; the strings
of the special tokens are those tokens wherever they stand; ids that the
vocabulary lacks decode to nothing; equal ranks are merged from the left;
repeated rows are each encoded; a very long text is cut into words first; an
empty table gives no rows; columns with the names of results are replaced,
others stay.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .arrow import with_columns

SHORT = 192
CACHE_WORDS = 1 << 16
NONE = 1 << 60

#: White space as the tokenizer's regular expressions see it. Fixed values.
SPACE = r"\t-\r \x85\xa0  -     　"
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
_SPLIT = regex.compile(rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
_SPLIT_ASCII = re.compile(rf"{CONTRACTIONS}|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b) if b in shown else chr(spare))
        spare += b not in shown
    return letters


class WordBpe:
    """The tokenizer of a word-BPE JSON file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        vocab: dict[str, int] = dict(model["vocab"])
        end = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + end] for c in letters]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 32 | vocab[b]] = len(self.made)
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.piece = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, tuple[bytes, str]] = {}
        self._older: dict[str, tuple[bytes, str]] = {}
        self._content, self._library, self._known = content, None, set()

    def merged(self, word: str) -> list[int]:
        """Ids of one word."""
        raw = word.encode("utf-8", "surrogatepass")
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.final[raw[-1]]
        if len(parts) > SHORT:
            return self._merged_long(parts)
        find, made = self.rank.get, self.made
        ranks = [find(a << 32 | b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            at = ranks.index(least)
            parts[at] = made[least]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = find(parts[at] << 32 | parts[at + 1], NONE)
            if at:
                ranks[at - 1] = find(parts[at - 1] << 32 | parts[at], NONE)
        return parts

    def _merged_long(self, parts: list[int]) -> list[int]:
        """The same merges, smallest rank and then leftmost first, from a heap over a linked list."""
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        find = self.rank.get
        heap = [(r, i) for i in range(n - 1) if (r := find(parts[i] << 32 | parts[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or find(parts[i] << 32 | parts[j], NONE) != r:
                continue
            parts[i], parts[j] = self.made[r], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (s := find(parts[x] << 32 | parts[after[x]], NONE)) != NONE:
                    heapq.heappush(heap, (s, x))
        return [p for p in parts if p >= 0]

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return _SPLIT_ASCII.findall(text.lower())
        new = set(text) - self._known
        if any(unicodedata.category(c) == "Cn" for c in new):
            return self._library_words(text)
        self._known |= new
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return _SPLIT.findall(text.replace("Σ", "σ").lower())

    def _library_words(self, text: str) -> list[str]:
        """For characters newer than this Python's Unicode tables: cut by the library's own tables."""
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        if self._library is None:
            split = pre_tokenizers.Split(Regex(rf"{CONTRACTIONS}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+"), "removed", invert=True)
            self._library = Tokenizer.from_str(self._content.decode()).normalizer, split
        normal, split = self._library
        return [w for w, _ in split.pre_tokenize_str(normal.normalize_str(text))]

    def _add(self, words: set[str]) -> None:
        """Fill the cache of two generations: a full one becomes the older, whose words come back when met."""
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.cache, self._older = {}, self.cache
        for w in words:
            if (known := self._older.get(w)) is None:
                ids = self.merged(w)
                known = (b"".join([i.to_bytes(4, "little") for i in ids]), " ".join([self.piece[i] for i in ids]))
            self.cache[w] = known

    def pieces(self, text: str | None) -> list[tuple[bytes, str]]:
        """For each word in order its ids (unsigned, 32 bits, little-endian) and their decoded text."""
        out: list[tuple[bytes, str]] = []
        for part in self._cut.split(text) if text and self._cut and "<" in text else [text or ""]:
            if part in self.special:
                out.append((self.special[part].to_bytes(4, "little"), part))
                continue
            words = self._words(part)
            for at in range(0, len(words), CACHE_WORDS // 2):
                some = words[at : at + CACHE_WORDS // 2]
                found = [*map(self.cache.get, some)]
                if None in found:
                    self._add({w for w, f in zip(some, found, strict=True) if f is None})
                    found = [f or self.cache.get(w) or self._older[w] for w, f in zip(some, found, strict=True)]
                out += found
        return out

    def close(self) -> None:
        """Forget the words; the vocabulary stays."""
        self.cache, self._older = {}, {}

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join([p[0] for p in self.pieces(text)]), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.piece[i] for i in ids if i in self.piece])


_loaded: dict[str, WordBpe] = {}


def _loaded_from(content: bytes) -> WordBpe:
    key = hashlib.sha256(content).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(content)
    return _loaded[key]


def _file(df: DataFrame, path: str):
    """The tokenizer file (its size does not depend on the data), for every executor."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _lists(raws: list[bytes]) -> pa.Array:
    """Lists of ids from their bytes."""
    offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raws])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raws), "<i4")))


def bpe_encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with `tokens` (array<int>). Null text has no tokens. A narrow map."""
    file = _file(df, path)

    def kernel(bpe, texts):
        return {"tokens": _lists([b"".join([p[0] for p in bpe.pieces(t)]) for t in texts])}

    return with_columns(df, text, kernel, "tokens array<int>", lambda: _loaded_from(file.value))


def bpe_decode(df: DataFrame, path: str, tokens: str = "tokens") -> DataFrame:
    """df with `decoded`; null tokens decode to the empty text. A narrow map."""
    file = _file(df, path)

    def kernel(bpe, rows):
        return {"decoded": pa.array([bpe.decode([i for i in r or [] if i is not None]) for r in rows], pa.string())}

    return with_columns(df, tokens, kernel, "decoded string", lambda: _loaded_from(file.value))


def bpe_digests(df: DataFrame, path: str, text: str = "text", tokens: bool = False) -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256 of what bpe_encode and bpe_decode return.

    With `tokens` also the ids themselves; texts are encoded once for all of it.
    """
    file = _file(df, path)

    def kernel(bpe, texts):
        raws, ids, decoded = [], [], []
        for t in texts:
            found = bpe.pieces(t)
            raws.append(b"".join([p[0] for p in found]))
            ids.append(hashlib.sha256(raws[-1]).hexdigest())
            decoded.append(hashlib.sha256(" ".join([p[1] for p in found]).encode("utf-8", "surrogatepass")).hexdigest())
        out = {"n_tokens": pa.array([len(r) // 4 for r in raws], pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
        return out | ({"tokens": _lists(raws)} if tokens else {})

    schema = "tokens array<int>, " * tokens + "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return with_columns(df, text, kernel, schema, lambda: _loaded_from(file.value))
