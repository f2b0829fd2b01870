from zlib import crc32

import numpy as np
import pytest

from tidewell.llm.textmodel import SubwordModel, features, quality_scores, score_texts


def brute_features(text, buckets):
    """How many features a text has, counted plainly."""
    words = [w for w in "".join(chr(b) if b > 32 else " " for b in text.encode()).split(" ") if w]
    grams = sum(max(0, len(w) + 2 - n + 1) for w in words for n in (3, 4, 5))
    return len(words) + max(0, len(words) - 1) + grams


@pytest.mark.parametrize("text", ["", " ", "a", "one two two", "x\ty\n\n zzz  ", "éà ü", "w" * 5000])
def test_feature_counts(text):
    assert len(features([text], 1 << 10)[0]) == brute_features(text, 1 << 10)


def test_features_do_not_depend_on_neighbours():
    texts = ["one two", "", "two two three", "ä b"]
    at, bucket = features(texts, 1 << 12)
    for k, t in enumerate(texts):
        assert sorted(bucket[at == k]) == sorted(features([t], 1 << 12)[1])


def test_folded_score_is_the_models():
    model = SubwordModel(1 << 10).fit(["good text here", "bad!! junk!!"] * 20, [1, 0] * 20)
    w, b = model.folded()
    for text in ("good text", "junk!! here", ""):
        at, share = model._shares(text)
        z = share @ model.e[at] @ model.w + model.b
        p = np.exp(z) / np.exp(z).sum()
        assert score_texts([text], w, b)[0] == pytest.approx(p[1], abs=1e-4)
    assert score_texts(["good text"], w, b)[0] > 0.7 > score_texts(["bad!! junk!!"], w, b)[0]


def test_table(spark):
    docs = [(i, "nice plain words of text" if i % 2 else "!!BUY!! NOW!!", 9.0) for i in range(120)] + [(500, None, 1.0), (500, None, 1.0), (None, "", 0.0), (501, "z" * 200_000, 0.0)]
    labels = [(i, i % 2, 0) for i in range(120)] + [(3, 1, 0), (4, None, 0), (None, 1, 0), (9999, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_scores(d, lab).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    right = [r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 120 and r.held_out]
    assert np.mean(right) > 0.95
    flipped = quality_scores(d, lab.withColumn("quality", (lab.quality + (lab.doc_id == 2).cast("int")) % 2)).collect()
    held = crc32(b"2") % 4 == 2
    assert not held or sorted(r.score for r in flipped) == sorted(r.score for r in got)
    assert quality_scores(d.limit(0), lab).count() == 0
    assert {r.score for r in quality_scores(d, lab.limit(0)).collect()} == {0.5}
