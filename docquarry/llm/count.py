"""Token counts: the piece count of the best unigram segmentation, nothing else.

An Aho-Corasick automaton over the vocabulary lists, at each place of a word,
the pieces that end there, longest first.  A forward pass carries the best
score and the number of pieces of the path that has it; no path is kept.  The
tie rules are the tokenizer's: of equal scores the piece that begins first
wins; a character that is no piece is unknown, at 10 below the least score of
the vocabulary; neighbouring unknown characters are one piece.

A text is cut as the tokenizer does: spaces become U+2581, one is put before a
text that does not begin with it, and every one begins a word.  Words are
counted once and kept in a bounded cache for the length of a task; those of more
than CACHED characters are not kept.  A long word is passed PIECE characters at
a time, and only the places of one longest piece are carried on.

Defined cases: null and empty texts have no tokens; a very long text without a
space is one word; repeated rows are each counted; an empty table gives no rows;
a column n_tokens is replaced, others stay.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import with_columns

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 1 << 18
CACHED = 64
#: Characters of a word that are passed at once.
PIECE = 1 << 12


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        """pieces: text and score; those with the same text count with the last score."""
        self._find = ahocorasick.Automaton()
        for text, score in pieces:
            if text:
                self._find.add_word(text, (len(text), score))
        self._find.make_automaton()
        self._empty = len(self._find) == 0
        self._longest = max((len(t) for t, _ in pieces), default=0)
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}
        self._older: dict[str, int] = {}

    def word(self, word: str) -> int:
        best, count, unknown = [0.0], [0], [False]
        if len(word) <= PIECE:
            self._carry(word, best, count, unknown)
        else:
            for start in range(0, len(word), PIECE):
                over = min(start, self._longest)  # no vocabulary piece that ends behind start begins before that
                best, count, unknown = best[-over - 1 :], count[-over - 1 :], unknown[-over - 1 :]
                self._carry(word[start - over : start + PIECE], best, count, unknown)
        return count[-1]

    def _carry(self, word: str, best: list[float], count: list[int], unknown: list[bool]) -> None:
        """Carry the lists, which hold the first places of a word, on to all of its places."""
        n, done = len(word), len(best) - 1
        best += [0.0] * (n - done)
        count += [0] * (n - done)
        unknown += [False] * (n - done)
        at = done  # places up to here have their best
        waiting = -1

        def close(end: int, single: bool, known: bool) -> None:
            if not single:
                s = best[end - 1] + self.unknown
                if not known or s > best[end]:
                    best[end], count[end], unknown[end] = s, count[end - 1] + (not unknown[end - 1]), True

        known = single = False
        for last, (size, score) in () if self._empty else self._find.iter(word):
            end = last + 1
            if end <= done:
                continue
            if end != waiting:
                if waiting > 0:
                    close(waiting, single, known)
                    at = waiting
                for gap in range(at + 1, end):
                    close(gap, False, False)
                waiting, known, single = end, False, False
            s = best[end - size] + score
            if not known or s > best[end]:
                best[end], count[end], unknown[end] = s, count[end - size] + 1, False
                known = True
            single = single or size == 1
        if waiting > 0:
            close(waiting, single, known)
            at = waiting
        for gap in range(at + 1, n + 1):
            close(gap, False, False)

    def close(self) -> None:
        """Forget the words; the vocabulary stays."""
        self.cache, self._older = {}, {}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        words = text.split(MARK)
        if text[0] == MARK:
            words = words[1:]
        found = [*map(self.cache.get, words)]
        if None in found:
            missing = {w for w, f in zip(words, found, strict=True) if f is None and len(w) <= CACHED}
            if len(self.cache) + len(missing) > CACHE_WORDS:
                self.cache, self._older = {}, self.cache
            for w in missing:
                n = self._older.get(w)
                n = self.word(MARK + w) if n is None else n
                self.cache[w] = n
            found = [self.word(MARK + w) if len(w) > CACHED else self.cache.get(w, f) for w, f in zip(words, found, strict=True)]
        return sum(found)


def pieces_of(model_path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a sentencepiece file, in order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [(sp.id_to_piece(i), float(sp.get_score(i))) for i in plain]


_made: dict[int, UnigramCounter] = {}


def _counter(pieces: list[tuple[str, float]]) -> UnigramCounter:
    key = hash(tuple(pieces))
    if key not in _made:
        _made.clear()
        _made[key] = UnigramCounter(pieces)
    return _made[key]


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], text: str = "text") -> DataFrame:
    """docs with `n_tokens`. A narrow map; what is broadcast is the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def kernel(counter: UnigramCounter, texts: list) -> dict[str, pa.Array]:
        return {"n_tokens": pa.array([counter.count(t) for t in texts], pa.int64())}

    return with_columns(docs, text, kernel, "n_tokens bigint", lambda: _counter(shared.value))
