import random

import numpy as np

from docquarry.llm import licenses as lic


def brute(text, templates):
    words = [w for _, _, w in lic._words((text or "").encode())]
    out = set()
    for name, notices in templates.items():
        for notice in notices:
            want = lic._shingles([w for _, _, w in lic._words(notice.encode())])
            m, n = len(want), len(want[0]) if want else 0
            own = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []
            if any(len(set(own[p : p + m]) & set(want)) >= lic.CONTAINMENT * len(set(want)) for p in range(len(own)) if own[p] in set(want)):
                out.add(name)
    return ",".join(sorted(out))


def test_edited_notices_against_brute_force(spark):
    rng = random.Random(1)
    notices = [(k, n) for k, v in lic.TEMPLATES.items() for n in v]
    rows = []
    for i in range(400):
        name, notice = rng.choice(notices)
        w = notice.split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(["", "changed"])
        noise = lambda n: " ".join(rng.choice("the of a license under work version software".split()) for _ in range(n))
        rows.append((i, f"{noise(rng.randrange(60))}\n{' '.join(w).upper() if i % 2 else ' '.join(w)}\n{noise(rng.randrange(60))}"))
    rows += [(1000, None), (1001, ""), (1002, "MIT License"), (None, "Released under the MIT License. É")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, licenses int")
    got = {r.doc_id: r.licenses for r in lic.digests(df).collect()}
    want = {i: brute(t, lic.TEMPLATES) for i, t in rows}
    assert got == want
    spans = lic.scan(df.where("doc_id is null")).first().licenses
    assert [(s["license"], s["start"], s["end"], s["containment"]) for s in spans] == [("MIT", 0, 30, 1.0)]
    assert lic.digests(df.limit(0)).count() == 0


def test_own_templates_and_window_minima():
    known = lic.Templates({"tiny": ["Free Art"], "none": ["..."]})
    text = "this is free art indeed"
    assert [f["license"] for f in known.scan(text, next(lic.word_hashes([text])))] == ["tiny"]
    h = np.random.default_rng(0).integers(0, 99, (3, 40)).astype(np.uint32)
    levels = [h]
    for m, step in ((1, 1), (11, 3), (4, 1), (29, 3), (16, 2)):
        starts = np.append(np.arange(0, 40 - m, step), 40 - m)
        assert (lic._window_minima(levels, m, starts, step) == np.stack([h[:, s : s + m].min(axis=1) for s in starts], axis=1)).all()


def test_keys_and_direct_comparison_retrieve_alike(monkeypatch):
    text = "x y z released under the MIT license and this work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0"
    words = next(lic.word_hashes([text]))
    few = lic.Templates(lic.TEMPLATES)
    assert few.few
    monkeypatch.setattr(lic, "FEW", 0)
    many = lic.Templates(lic.TEMPLATES)
    assert not many.few and few.retrieved(words) <= many.retrieved(words)
    assert {t for t, _ in few.retrieved(words)} == {t for t, _ in many.retrieved(words)}
    assert few.scan(text, words) == many.scan(text, words) and len(few.scan(text, words)) == 3


def test_long_text_of_repeated_notices(spark):
    notice = "Released under the MIT License. "
    text = ("word " * 40 + notice) * 3000
    found = lic.scan(spark.createDataFrame([(1, text), (2, "released under the " * 30_000)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert len(found[0].licenses) == 3000 and {text[s["start"] : s["end"]] for s in found[0].licenses} == {"Released under the MIT License"}
    assert found[1].licenses == []
