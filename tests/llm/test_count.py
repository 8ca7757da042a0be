import random

import public_tokenizers
import pyarrow.dataset as ds
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from docquarry.llm import count

PIECES = count.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))


def library(pieces):
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


LIB, OWN = library(PIECES), count.UnigramCounter(PIECES)


def test_real_and_odd_texts():
    texts = ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table()["text"].to_pylist()
    for t in [*texts, "", " ", "  a  b ", "a\n\nb", "▁x", "日本語 🙂🙂🙂 x", "\x00\x01 \x00"]:
        assert OWN.count(t) == len(LIB.encode(t, add_special_tokens=False).ids), repr(t)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert OWN.count(text) == len(LIB.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab c", max_size=30), st.integers(0, 10**6))
def test_ties(text, seed):
    rng = random.Random(seed)
    pieces = [(p, float(rng.choice([-1, -2, -2, -3]))) for p in ["▁", "a", "b", "ab", "ba", "aa", "▁a", "abab", "bb", "aba"] if rng.random() < 0.8]
    if pieces:
        assert count.UnigramCounter(pieces).count(text) == len(library([*pieces]).encode(text, add_special_tokens=False).ids)


def test_frame(spark):
    df = spark.createDataFrame([(1, "Hello world", 9), (1, "Hello world", 9), (2, None, 9), (None, "", 9)], "doc_id long, text string, n_tokens int")
    got = count.count_tokens(df, PIECES)
    assert got.columns == ["doc_id", "text", "n_tokens"]
    n = len(LIB.encode("Hello world", add_special_tokens=False).ids)
    assert sorted(r.n_tokens for r in got.collect()) == [0, 0, n, n]
    assert count.count_tokens(df.limit(0), PIECES).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc", min_size=8, max_size=60), st.integers(0, 10**6), st.integers(1, 9))
def test_words_in_pieces(text, seed, piece):
    rng = random.Random(seed)
    pieces = [(p, float(rng.choice([-1, -2, -2, -3]))) for p in ["▁", "a", "b", "ab", "ba", "aa", "▁a", "abab", "bb", "aba"] if rng.random() < 0.8] or [("a", -1.0)]
    counter = count.UnigramCounter(pieces)
    whole = counter.word("▁" + text)
    old, count.PIECE = count.PIECE, piece
    try:
        assert counter.word("▁" + text) == whole
    finally:
        count.PIECE = old


def test_very_long_word_needs_no_memory_for_its_places(spark):
    import tracemalloc

    word = "abcdefgh日" * 200_000
    tracemalloc.start()
    n = OWN.count(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(LIB.encode(word, add_special_tokens=False).ids)
    assert peak < 16 * len(word) and word not in OWN.cache
