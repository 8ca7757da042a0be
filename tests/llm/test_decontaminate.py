import hashlib
import re

from docquarry.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, n=10):
    out = []
    for doc_id, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, it in items:
            v = words(it)
            m = min(n, len(v))
            for p in range(len(v) - m + 1 if m else 0):
                for q in range(len(w) - m + 1):
                    if w[q : q + m] == v[p : p + m]:
                        hit |= set(range(q, q + m))
                        ids.add("null" if i is None else str(i))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


TEXT = " ".join(f"w{i}" for i in range(40))
DOCS = [(1, TEXT), (2, ""), (3, None), (4, "x " + TEXT[:60] + " É-é W3"), (4, "short One!"), (None, "a short one b"), (6, "Été,ÉTÉ 9")]
ITEMS = [(7, " ".join(f"W{i}," for i in range(5, 20))), (7, "short one"), (None, "nothing here"), (10, None), (9, ""), (2, "a SHORT one"), (3, "Été")]


def test_against_brute_force_in_one_and_many_blocks(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for size in (1 << 20, 40):
        assert sorted(map(tuple, dc.digests(docs, items, index_bytes=size).collect()), key=repr) == brute(DOCS, ITEMS)


def test_empty_tables_and_removal(spark):
    docs = spark.createDataFrame([(*d, 1, "z") for d in DOCS], "doc_id long, text string, n_hit int, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dc.digests(docs.limit(0), items).count() == 0
    assert dc.digests(docs, items.limit(0)).where("contaminated").count() == 0
    left = dc.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect())) == [2, 3]
    cut = {r.text for r in dc.decontaminate(docs, items, remove="spans").collect()}
    assert "a  b" not in cut and " b" in cut and len(cut) == 7
