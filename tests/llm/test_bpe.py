import hashlib

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewell.llm.bpe import LONG, WordBpe, bpe_encode

PATH = P.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as f:
    OWN = WordBpe(f.read())

HARD = [
    "", " ", "Hello,  World!\n\tIt's we'll they'RE 'sfoo", "straße ΣΑΣ İstanbul Å Å", "１２３ 4567 ½ ²", "日本語テキスト", "😀😀 á ́x",
    "a<|startoftext|>b <|endoftext|>", "<|ENDOFTEXT|>", "x" * 3000, "ab" * (LONG + 7), "!?!?" * 400, "a\x1cb\x1dc \x85d\xa0e f᠎g​h", "\x00\x01", "don't-stop_now",
]


def same(text):
    want = LIB.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == want
    assert OWN.decode(want) == LIB.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=100, deadline=None)
@given(st.text("abcdefgh'", min_size=LONG, max_size=LONG + 80))
def test_long_words(text):
    same(text)


def test_table(spark):
    rows = [(1, None, "x"), (2, "Two words", "y"), (2, "Two words", "y"), (None, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe_encode(docs, PATH, outputs=("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")).collect()
    assert len(got) == 4
    for r in got:
        want = LIB.encode({2: "Two words"}.get(r.doc_id, ""), add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded == LIB.decode(want, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe_encode(docs.limit(0), PATH).count() == 0
