"""Shared text kernels: ASCII-folded words as positions, hashes and shingles.

A word is a maximal run of digits, ASCII letters (folded to lower case) and
any characters beyond ASCII.  On UTF-8 bytes that is a table lookup, so whole
groups of texts are cut and hashed at once with numpy.  Memory is bounded by
the group: texts are joined up to GROUP_BYTES, and a longer text is hashed in
pieces of about PIECE_BYTES that end where a word does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

GROUP_BYTES = 1 << 18
PIECE_BYTES = 1 << 20

FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (murmur's), element by element."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_POWER = mix(np.arange(7, 7 + 4096, dtype=_U) * _U(0xD1B54A32D192ED03)) | _U(1)


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _hash_words(folded: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the byte at which it starts."""
    a = np.frombuffer(folded, np.uint8)
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = _IS_WORD[a]
    turn = np.flatnonzero(np.diff(inside))
    starts, ends = turn[0::2], turn[1::2]
    if not len(starts):
        return np.zeros(0, _U), starts
    size = ends - starts
    first = np.cumsum(size) - size
    letters = a[_IS_WORD[a]]
    place = np.arange(len(letters)) - np.repeat(first, size)
    sums = np.add.reduceat(_BYTE[letters] * _POWER[place & 4095], first)
    return mix(sums + size.astype(_U)), starts


def word_hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """For each text the 64-bit hashes of its words, in order."""
    group: list[bytes] = []
    held = 0
    for text in texts:
        raw = encoded(text).translate(FOLD)
        if group and held + len(raw) > GROUP_BYTES:
            yield from _cut(group)
            group, held = [], 0
        group.append(raw)
        held += len(raw) + 1
    if group:
        yield from _cut(group)


def _cut(group: list[bytes]) -> Iterator[np.ndarray]:
    if len(group) == 1:
        yield _hash_long(group[0])
        return
    hashes, starts = _hash_words(b"\n".join(group))
    limits = np.cumsum([len(g) + 1 for g in group])
    yield from np.split(hashes, np.searchsorted(starts, limits[:-1]))


def _hash_long(folded: bytes) -> np.ndarray:
    found, at = [], 0
    while at < len(folded):
        end = at + PIECE_BYTES
        while end < len(folded) and _IS_WORD[folded[end]]:
            end += 1
        found.append(_hash_words(folded[at:end])[0])
        at = end
    return np.concatenate(found) if found else np.zeros(0, _U)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words; fewer words, but not none, make one run."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, _U)
    for j in range(n):
        out = out * _U(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j]
    return mix(out + _U(n))
