"""License scans: MinHash bands retrieve templates, exact shingle containment verifies them.

Words are those of text.py, shingles SHINGLE of them.  For each template length
(in shingles) a document is covered with windows of that length, each an eighth
of it further on; every window gets HASHES minima and BANDS band keys, which
are looked up in the broadcast table of the templates' keys.  A text that holds
CONTAINMENT = 0.8 of a template lies with 15/16 of that in some window, where
its Jaccard similarity with the template is at least 0.6: it shares a band with
probability 1 - (1 - 0.6**2)**16 > 0.999 (and always if it is the template
itself and its windows advance by one).  Each retrieval is verified on words:
some run of as many shingles as the template has, within a template's length of
the window, must hold at least CONTAINMENT of the template's distinct shingles.

A narrow map; what is broadcast is the templates, a parameter.  Defined cases:
null, empty and short texts have no licenses; templates of fewer than SHINGLE
words make one shingle of their words; of notices of one template that overlap
the first is kept; repeated rows are each scanned; the time of a very long text
is in proportion to its length, however many notices it holds; an empty table
gives no rows; a column named licenses is replaced, others stay.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import with_columns
from .text import FOLD, encoded, mix, shingle_hashes, word_hashes

SHINGLE = 5
CONTAINMENT = 0.8
BANDS, ROWS = 16, 2
#: Up to so many templates of a length, their bands are compared one by one; more are looked up by key.
FEW = 8
FILTER_BITS = 18

# Standard notices of common licenses.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    ],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
}

_U = np.uint64
_SEEDS = mix(np.arange(11, 11 + BANDS * ROWS, dtype=_U) * _U(0x9FB21C651E98DF25))[:, None]
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOUND = "licenses array<struct<license:string,start:bigint,end:bigint,containment:double>>"


def _words(raw: bytes) -> list[tuple[int, int, bytes]]:
    return [(m.start(), m.end(), m.group()) for m in _WORD.finditer(raw.translate(FOLD))]


def _shingles(words: list[bytes]) -> list[tuple[bytes, ...]]:
    n = min(SHINGLE, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


def _minhashes(shingles: np.ndarray) -> np.ndarray:
    """All HASHES of each shingle, 32 bits each."""
    z = (shingles ^ _SEEDS) * _U(0xE7037ED1A0B428DB)
    return (z >> _U(32)).astype(np.uint32)


def _keys(minima: np.ndarray) -> np.ndarray:
    """Band keys (BANDS, windows) of minima (BANDS * ROWS, windows)."""
    parts = minima.reshape(BANDS, ROWS, -1).astype(_U)
    out = np.arange(1, BANDS + 1, dtype=_U)[:, None] * _U(0xD6E8FEB86659FD93)
    for j in range(ROWS):
        out = (out ^ parts[:, j]) * _U(0x9E3779B97F4A7C15)
        out = out ^ (out >> _U(32))
    return out


class Templates:
    def __init__(self, texts: dict[str, list[str]]):
        self.names: list[str] = []
        self.shingles: list[list[tuple[bytes, ...]]] = []
        keys: list[tuple[int, int]] = []
        minima_of: list[np.ndarray] = []
        for name, notices in sorted(texts.items()):
            for notice in notices:
                words = next(word_hashes([notice]))
                if not len(words):
                    continue
                minima = _minhashes(shingle_hashes(words, SHINGLE)).min(axis=1, keepdims=True)
                minima_of.append(minima[:, 0])
                keys += [(int(k), len(self.names)) for k in _keys(minima)[:, 0]]
                self.names.append(name)
                self.shingles.append(_shingles([w for _, _, w in _words(encoded(notice))]))
        keys.sort()
        self.keys = np.array([k for k, _ in keys], _U)
        self.owner = np.array([t for _, t in keys], np.int64)
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(self.keys >> _U(64 - FILTER_BITS)).astype(np.int64)] = True
        self.lengths = sorted({len(s) for s in self.shingles})
        #: Few templates by length in shingles and words of a shingle: their numbers and minima.
        self.few: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for key in {(len(s), len(s[0])) for s in self.shingles}:
            own = np.array([i for i, s in enumerate(self.shingles) if (len(s), len(s[0])) == key])
            if len(own) <= FEW:
                self.few[key] = own, np.stack([minima_of[i] for i in own])
        self.short = {len(s[0]) for s in self.shingles if len(s[0]) < SHINGLE}

    def retrieved(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(template, first shingle of the window) of all windows that share a band key."""
        out: set[tuple[int, int]] = set()
        for n in [*self.short, SHINGLE]:
            if len(words) < n:
                continue
            hashes = _minhashes(_runs(words, n))
            count = hashes.shape[1]
            levels = [hashes]  # minima over windows of 1, 2, 4, ... shingles, shared by all lengths
            for m in self.lengths if n == SHINGLE else [1]:
                step = max(1, m // 8)
                if count <= m:
                    minima, starts = hashes.min(axis=1, keepdims=True), np.zeros(1, int)
                else:
                    starts = np.append(np.arange(0, count - m, step), count - m)
                    minima = _window_minima(levels, m, starts, step)
                if (m, n) in self.few:
                    own, bands = self.few[m, n]
                    same = (minima[None] == bands[:, :, None]).reshape(len(own), BANDS, ROWS, -1).all(axis=2)
                    which, _, at = np.nonzero(same)
                    out.update(zip(own[which].tolist(), starts[at].tolist(), strict=True))
                    continue
                keys = _keys(minima)
                band, at = np.nonzero(self.maybe[(keys >> _U(64 - FILTER_BITS)).astype(np.int64)])
                for k, s in zip(keys[band, at], starts[at].tolist(), strict=True):
                    i = int(np.searchsorted(self.keys, k))
                    while i < len(self.keys) and self.keys[i] == k:
                        out.add((int(self.owner[i]), s))
                        i += 1
        return out

    def scan(self, text: str | None, words: np.ndarray) -> list[dict]:
        """Verified notices, per template from left to right without overlap."""
        hits = self.retrieved(words)
        if not hits:
            return []
        places = _words(encoded(text))
        plain = [w for _, _, w in places]
        out = []
        for template in sorted({t for t, _ in hits}):
            wanted = set(self.shingles[template])
            m, n = len(self.shingles[template]), len(self.shingles[template][0])
            # places of the template's shingles near the windows, each looked at once
            at: list[int] = []
            seen = 0
            for s in sorted(s for t, s in hits if t == template):
                upto = min(len(plain) - n + 1, s + 2 * m + 1)
                at += [p for p in range(max(seen, s - m), upto) if tuple(plain[p : p + n]) in wanted]
                seen = max(seen, upto)
            held: Counter[tuple] = Counter()  # shingles from a place on, less than the template's length behind it
            done, ahead = -1, 0
            for first in at:
                while ahead < len(at) and at[ahead] < first + m:
                    held[tuple(plain[at[ahead] : at[ahead] + n])] += 1
                    ahead += 1
                if first > done and len(held) >= CONTAINMENT * len(wanted):
                    done = at[ahead - 1]
                    out.append({"license": self.names[template], "start": places[first][0], "end": places[done + n - 1][1], "containment": len(held) / len(wanted)})
                own = tuple(plain[first : first + n])
                held[own] -= 1
                if not held[own]:
                    del held[own]
        return sorted(out, key=lambda f: (f["start"], f["end"], f["license"]))


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(words) - n + 1, _U)
    for j in range(n):
        out = out * _U(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j]
    return mix(out + _U(n))


def _window_minima(levels: list[np.ndarray], m: int, starts: np.ndarray, step: int) -> np.ndarray:
    """Minima over the windows of m columns at starts (every step, and the last): of two overlapping windows whose length is a power of two."""
    k = m.bit_length() - 1
    while len(levels) <= k:
        half = 1 << len(levels) - 1
        levels.append(np.minimum(levels[-1][:, :-half], levels[-1][:, half:]))
    best, shift = levels[k], m - (1 << k)
    if step == 1:
        return np.minimum(best[:, : len(starts)], best[:, shift : shift + len(starts)])
    return np.minimum(best[:, starts], best[:, starts + shift])


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, text: str = "text") -> DataFrame:
    """docs with `licenses`: verified notices with byte spans of the UTF-8 text."""
    shared = docs.sparkSession.sparkContext.broadcast(Templates(templates or TEMPLATES))
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def kernel(known: Templates, texts: list) -> dict[str, pa.Array]:
        return {"licenses": pa.array([known.scan(t, w) for t, w in zip(texts, word_hashes(texts), strict=True)], kind)}

    return with_columns(docs, text, kernel, FOUND, lambda: shared.value)


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: how many licenses its text names, and which."""
    found = scan(docs.select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda f: f["license"])))
    return found.select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"))


def oracle(templates: dict[str, list[str]] | None = None) -> str:
    """The same by brute force: every run of a template's length that begins with one of its shingles."""
    rows, t = [], 0
    for name, notices in sorted((templates or TEMPLATES).items()):
        for notice in notices:
            s = _shingles([w for _, _, w in _words(encoded(notice))])
            rows += [f"({t}, '{name}', {len(s)}, {len(set(s))}, '{b' '.join(x).decode()}')" for x in sorted(set(s))]
            t += 1
    fold = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH t(tid, name, m, k, sh) AS (VALUES {', '.join(rows)}),
d AS (SELECT row_number() OVER () AS r, doc_id, {fold} AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS p FROM d WHERE len(w) >= {SHINGLE}),
s AS (SELECT r, p, array_to_string(w[p:p + {SHINGLE - 1}], ' ') AS sh FROM p),
h AS (SELECT r, p, tid, name, m, k, t.sh FROM s JOIN t ON s.sh = t.sh),
v AS (SELECT a.r, a.name FROM h a JOIN h b ON a.r = b.r AND a.tid = b.tid AND b.p >= a.p AND b.p < a.p + a.m
  GROUP BY a.r, a.name, a.tid, a.p, a.k HAVING count(DISTINCT b.sh) >= {CONTAINMENT} * a.k),
n AS (SELECT r, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, name FROM v) GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(names, '') AS licenses FROM d LEFT JOIN n USING (r)
"""


ORACLE = oracle()
