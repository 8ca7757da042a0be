import hashlib

import public_tokenizers
import pyarrow.dataset as ds
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docquarry.llm.bpe import WordBpe, bpe_decode, bpe_digests, bpe_encode

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
LIB.no_truncation()
LIB.no_padding()
OWN = WordBpe(open(PATH, "rb").read())
ODD = ["", " ", "\n", "don't STOP'LL", "a\x1cb\x85c", "ΟΔΟΣ Σ", "İstanbul", "été", "x<|endoftext|>Y<|startoftext|>", "<|endof", "²³½ Ⅷ 12", "日本語 テスト", "🙂🙂 🇫🇷", "a" * 3000, "ab" * 400, "é" * 500, "!" * 700, "　x​y", "a:\U000323b0b", "x\U000323b0\u2028Σ"]


def same(text):
    want = LIB.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == want
    assert OWN.decode(want) == LIB.decode(want, skip_special_tokens=False)


def test_odd_texts():
    for text in ODD:
        same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text.encode("utf-8", "ignore").decode())


def test_real_texts():
    for text in ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table()["text"].to_pylist():
        same(text)


def test_frame_with_nulls_repeats_and_clashes(spark):
    df = spark.createDataFrame([(1, "Hello hello", 5), (1, "Hello hello", 5), (None, None, None)], "doc_id long, text string, n_tokens int")
    rows = bpe_digests(df, PATH).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [0, 2, 2]
    assert rows[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe_digests(df.limit(0), PATH).count() == 0
    back = bpe_decode(bpe_encode(df, PATH), PATH).orderBy("doc_id").collect()
    assert [r.decoded for r in back] == ["", "hello</w> hello</w>", "hello</w> hello</w>"]
