import random
import re

import numpy as np

from docquarry.llm import text as tk


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def test_hashes_stand_for_words_however_texts_are_grouped(monkeypatch):
    rng = random.Random(8)
    alphabet = "ab1 \u00e9Z,.\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 60, 900]))) for _ in range(200)] + [None, "x" * 5000 + " y", "\u65e5\u672c \U0001f642"]
    whole = list(tk.word_hashes(texts))
    known: dict[str, int] = {}
    for t, hashes in zip(texts, whole, strict=True):
        own = words(t)
        assert len(own) == len(hashes)
        for w, h in zip(own, hashes.tolist(), strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    monkeypatch.setattr(tk, "GROUP_BYTES", 1)
    monkeypatch.setattr(tk, "PIECE_BYTES", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, tk.word_hashes(texts), strict=True))


def test_shingles():
    w = next(tk.word_hashes(["a b c d e f a b c d e"]))
    s = tk.shingle_hashes(w, 5)
    assert len(s) == 7 and s[0] == s[6] and len(set(s.tolist())) == 6
    assert len(tk.shingle_hashes(w[:3], 5)) == 1 and len(tk.shingle_hashes(w[:0], 5)) == 0
