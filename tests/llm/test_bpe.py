import hashlib
import random

import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohort.llm import bpe as B

LIB = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
OWN = B.Bpe(B.Params())
SMALL = B.Bpe(B.Params(long_word=3, cache_words=5))
SCHEMA = "doc_id long, text string, ids string, n_tokens int"


def check(text, own=OWN):
    ids = LIB.encode(text, add_special_tokens=False).ids
    got_ids, got_text = own.encode_texts([text])[0]
    assert got_ids == " ".join(map(str, ids))
    assert got_text == LIB.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    check(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="thenadig' .#9é", max_size=90))
def test_wordlike_text_both_merge_paths(text):
    check(text)
    check(text, SMALL)


def test_every_latin_code_point_alone_and_in_words():
    for c in range(0x250):
        for t in (chr(c), f"a{chr(c)}b 1{chr(c)}2", f"E{chr(c)} '{chr(c)}s"):
            check(t)


@pytest.mark.parametrize("text", [
    "", " ", "<|startoftext|>", "a<|endoftext|>B <|endoftext|><|startoftext|>", "<|endoftext|",
    "ΣΑΣ ς Σ", "İstanbul", "ﬁ ½ ² ٣", "中文 字", "é", "it's we'LL 'tis", "\x1c\x1d\x85\xa0​",
    "\U0001f468‍\U0001f469", "x" * 5000, "ab" * 4000, "the" * 3000, "#" * 3000, "ñ" * 2000])
def test_edges(text):
    check(text)


def test_batch_of_words_equals_one_at_a_time():
    rng = random.Random(6)
    words = ["".join(rng.choice("thendiéab") for _ in range(rng.randrange(1, 30)))
             for _ in range(3000)]
    many = OWN.encode_words(words)
    for w, ids in zip(words, many):
        assert ids.tolist() == LIB.encode(w, add_special_tokens=False).ids
        assert OWN.merge_long(OWN.symbols([w.encode()])[0]).tolist() == ids.tolist()


def test_query_round_trip_nulls_long_repeats_empty(spark):
    texts = [None, "", "Hello  WORLD!", "Hello  WORLD!", "Straße <|endoftext|> x", "Q" * 120_000,
             "word " * 60_000]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    decoded = {r.doc_id: r.text for r in B.decode_documents(B.encode_documents(df)).collect()}
    for r in B.digests(df).collect():
        ids = LIB.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        text = LIB.decode(ids, skip_special_tokens=False)
        assert decoded[r.doc_id] == text and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert B.digests(df.where("false")).collect() == []
