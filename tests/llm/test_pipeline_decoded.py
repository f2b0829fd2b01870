"""The last stage of the pipeline encodes and decodes."""

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline as C


def test_decoded(spark):
    texts = ["plain words, decoded again", "mail [EMAIL] now", "", "Gr\u00f6\u00dfe \U0001f600"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = C.tokens(spark, docs, "").collect()
    assert len(got) == len(texts) and all(r.decoded == lib.decode(r.ids, skip_special_tokens=False) for r in got)
