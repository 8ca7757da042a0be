import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from docquarry.llm import bpe, decontaminate, near, pii, toxicity
from docquarry.llm.storage import written

D = "/root/testdata/sf0.001"


def test_stages_against_plain_computation(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    first = docs.columns
    kept = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "bpe"]

    labels = spark.read.parquet(f"{D}/labels.parquet")
    model = toxicity.fit(docs.where(toxicity.fold() != 0), labels)
    a = written(cp.drop_toxic(spark, docs, D), "a")
    assert a.columns == first
    want = {i for i, r in kept.items() if model is None or model.scores([r.text])[0] < 0.5}
    assert {r.doc_id for r in a.collect()} == want

    b = written(cp.drop_near_duplicates(spark, a, D), "b")
    assert b.columns == first
    weights = near.inverse_frequencies(a)
    rows = sorted((i, kept[i].text) for i in want)
    sets = {i: weights.of(w) for (i, _), w in zip(rows, near.word_hashes(t for _, t in rows), strict=True)}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, t in rows:
        for j, u in rows:
            if i < j and (t == u or near.weighted_jaccard(sets[i], sets[j]) >= near.THRESHOLD):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    left = {r.doc_id for r in b.collect()}
    assert sorted(map(find, left)) == sorted({find(i) for i in root})

    c = written(cp.drop_contaminated(spark, b, D), "c")
    assert c.columns == first
    index = decontaminate.WindowIndex([(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()])
    clean = {i for i in left if not index.search(kept[i].text, next(near.word_hashes([kept[i].text])))[0].any()}
    assert {r.doc_id for r in c.collect()} == clean

    d = written(cp.mask_personal_data(spark, c, D), "d")
    assert d.columns == first
    field = pii.train(c)
    masked = {r.doc_id: r for r in d.collect()}
    assert {i: r.text for i, r in masked.items()} == {i: pii.masked(kept[i].text, field) for i in clean}
    assert all(r.n_chars == len(r.text) and not pii.base_spans(r.text) for r in masked.values())

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in cp.tokenise(spark, d, D).collect():
        ids = lib.encode(masked[r.doc_id].text, add_special_tokens=False).ids
        assert r.tokens == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_and_null_rows_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)
    for start, least in ((odd, 2), (docs.limit(0), 0)):
        rows = start.selectExpr("*", "1 as score", "'k' as hits", "0 as tokens")
        for _, stage in cp.STAGES:
            rows = written(stage(spark, rows, D), "odd")
        assert rows.count() == least
    assert bpe.bpe_encode(odd, public_tokenizers.path("word_bpe_49k.json")).where("size(tokens) > 0").count() == 0
