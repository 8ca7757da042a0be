"""Text analysis: NFKC, words, lower case, and English stems.

The stemmer follows the published English (Porter2) algorithm.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex

from ..plans.errors import EngineError, invalid

MAX_TOKEN_BYTES, MAX_DOCUMENT_TOKENS, MAX_QUERY_BYTES, MAX_QUERY_TOKENS = 240, 65_536, 4096, 64
_WORD = regex.compile(r"[\p{Alphabetic}\p{N}]+")


_ASCII_WORD = re.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return [w.lower() for w in _WORD.findall(unicodedata.normalize("NFKC", text))]


def analyse(analyzer: str, text: str) -> tuple[list[str], list[str]]:
    """(ranked, surface) tokens in order: the same, but for English stems."""
    surface = words(text)
    if analyzer == "unicode_v1":
        return surface, surface
    if analyzer == "english_v1":
        return [stem(w) for w in surface], surface
    raise EngineError("UNAVAILABLE", "japanese_v1 needs a morphological dictionary, which is not installed")


def tokens(analyzer: str, text: str, surface: bool) -> list[str]:
    """One of the two."""
    return words(text) if surface or analyzer == "unicode_v1" else analyse(analyzer, text)[0]


def query_tokens(analyzer: str, text: str, surface: bool) -> list[str]:
    if len(text.encode()) > MAX_QUERY_BYTES:
        raise invalid(f"a text query has at most {MAX_QUERY_BYTES} bytes")
    found = analyse(analyzer, text)[surface]
    if not found:
        raise invalid("the text query has no searchable token")
    if len(found) > MAX_QUERY_TOKENS or any(len(t.encode()) > MAX_TOKEN_BYTES for t in found):
        raise invalid(f"a text query has at most {MAX_QUERY_TOKENS} tokens of {MAX_TOKEN_BYTES} bytes")
    return found


def distance(a: str, b: str, most: int) -> int:
    """Edits between a and b, adjacent transpositions being one; more than `most` is most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


# The word and suffix lists of the English stemming algorithm.
_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _VOWELS and w[i - 1] in _VOWELS:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-3] not in _VOWELS and w[-2] in _VOWELS and w[-1] not in _VOWELS and w[-1] not in "wxY"


def _has_vowel(w: str) -> bool:
    return any(ch in _VOWELS for ch in w)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = "".join("Y" if ch == "y" and (i == 0 or word[i - 1] in "aeiou") else ch for i, ch in enumerate(word))
    r1, r2 = _regions(w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w.lower()
    # past and progressive
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if not w.endswith(end):
            continue
        if end in ("eed", "eedly"):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + "ee"
        elif _has_vowel(w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
        break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # suffixes, longest first
    for end in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                if end == "ogi":
                    w = w[:-1] if w[-4:-3] == "l" else w
                elif end == "li":
                    w = w[:-2] if w[-3:-2] and w[-3] in _LI else w
                else:
                    w = w[: -len(end)] + _STEP2[end]
            break
    for end in sorted([*_STEP3, "ative"], key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                if end == "ative":
                    w = w[:-5] if len(w) - 5 >= r2 else w
                else:
                    w = w[: -len(end)] + _STEP3[end]
            break
    for end in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(end)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
