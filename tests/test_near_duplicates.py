"""Near duplicates: bitmaps leave out what cannot be near, and nothing else."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidewell.functions.scalar import bigrams, content_hash
from tidewell.operators import retrieval as R


def test_bitmaps_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(-(2**63), 2**63 - 1, rng.integers(1, 900)) for _ in range(2))
        b = np.unique(np.concatenate([b, a[: rng.integers(0, len(a) + 1)]]))
        wide = lambda x: R._parity(x, int(2 ** rng.integers(9, 13))).tobytes()
        assert R._differing(wide(np.unique(a)), wide(b)) <= len(np.setxor1d(a, b))


def test_few_texts_are_compared(spark):
    """Only pairs that may be near leave the blocks; among them all of the brute-force ones, at sizes around a change of width."""
    rng = random.Random(2)
    texts = [[f"w{rng.randrange(4000)}" for _ in range(rng.choice([40, 250, 258, 600]))] for _ in range(300)]
    for i in range(20, 300, 4):
        texts[i] = list(texts[i - rng.randrange(1, 20)])
        for _ in range(rng.randrange(0, len(texts[i]) // 20)):
            texts[i][rng.randrange(len(texts[i]))] = "other"
        texts[i] += ["more"] * rng.randrange(0, 3)
    rows = [(i, " ".join(t), "a" if i % 7 else "b", i) for i, t in enumerate(texts)] + [(300, None, "a", 300), (301, "", "a", 301), (302, " ", "a", 302), (303, texts[299][0], None, 303)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tenant string, ingested_at long")
    got = {(r.doc_id, r.of): r.similarity for r in R.duplicates(docs, recent=30).where("not exact").collect()}
    sets = [set(zip(t, t[1:])) | {t[-1]} for t in texts]
    want = {}
    for t in "ab":
        own = [i for i in range(300) if rows[i][2] == t]
        for n, i in enumerate(own):
            for j in own[max(0, n - 30) : n]:
                s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if s >= 0.9 and texts[i] != texts[j]:
                    want[i, j] = s
    assert want and got == want
    bits = R._with_bits(docs.where("text is not null").select("doc_id", "tenant", content_hash("text").alias("h"), bigrams(F.col("text")).alias("g")), "doc_id", ["tenant", "h"])
    one = bits.select("doc_id", "h", "size", "bits", F.lit(0).alias("_t"), F.lit(0).alias("_k"), F.col("doc_id").alias("_n"), F.lit(True).alias("_own"))
    found = R._near(one, "doc_id", 30, 0.9).count()
    assert found < 300  # of about 9,000 pairs
