"""Quality classifier: supervised subword embeddings (hashed word and character n-grams, averaged, softmax).

Trained by plain stochastic gradient descent in numpy on a bounded sample of labelled documents.  Scoring is exact and
cheap: a document's logits are linear in its features, so the two matrices fold into one number for each hashed feature.
Features are computed for many whole texts at once with array operations over their UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import give_back, mix64, powers, tidy

GRAMS = (3, 4, 5)
_SPACE = 32
_PIECE = 1 << 18  # bytes that are hashed at once; their features take some 100 times as much


def held_out(doc_id: Column) -> Column:
    """The fold that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of whole texts: (position of the text, bucket) for each feature, in no particular order.

    Words are runs of bytes above the space; a text's features are its words, its pairs of adjacent words, and the byte
    n-grams of each word with a mark at both ends.  ``buckets`` is a power of two.
    """
    table = np.arange(256, dtype=np.uint8)
    table[:33] = _SPACE
    raw = b" ".join([b" ", *[t.encode("utf-8", "surrogatepass") + b" " for t in texts]])
    b = table[np.frombuffer(raw, np.uint8)]
    lengths = np.array([len(t.encode("utf-8", "surrogatepass")) + 2 for t in texts], np.int64)
    text_at = np.concatenate([np.zeros(2, np.int32), np.repeat(np.arange(len(texts), dtype=np.int32), lengths)])[: len(b)]
    word = b != _SPACE
    wide = b.astype(np.uint32)
    mask = np.uint64(buckets - 1)
    at, bucket = [], []
    with np.errstate(over="ignore"):
        code = wide[:-1] * np.uint32(0x01000193) + wide[1:]
        inner = None
        for n in range(3, max(GRAMS) + 1):
            code = code[: len(b) - n + 1] * np.uint32(0x01000193) + wide[n - 1 :]
            inner = word[1 : len(b) - 1].copy() if inner is None else inner[: len(b) - n + 1] & word[n - 2 : len(b) - 1]
            if n in GRAMS:
                pos = np.flatnonzero(inner[: len(b) - n + 1])
                h = code[pos] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(13)
                at.append(text_at[pos + 1])
                bucket.append((h & np.uint32(buckets - 1)).astype(np.int32))
        edge = np.diff(word.astype(np.int8))
        start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        if len(start):
            up, down = powers(len(b) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)])
            h = (sums[end] - sums[start]) * down[start]
            owner = text_at[start]
            at.append(owner)
            bucket.append((mix64(h) & mask).astype(np.int32))
            same = np.flatnonzero(owner[1:] == owner[:-1])  # both words of a pair in one text; a repeated word always gives the same pair
            at.append(owner[same])
            bucket.append((mix64((h[same + 1] - h[same]) * np.uint64(3) + np.uint64(1)) & mask).astype(np.int32))
    return np.concatenate([*at, np.zeros(0, np.int32)]), np.concatenate([*bucket, np.zeros(0, np.int32)])


class SubwordModel:
    """Two classes.  ``buckets`` hashed features of ``dim`` numbers each."""

    def __init__(self, buckets: int = 1 << 17, dim: int = 8, seed: int = 5):
        self.buckets, self.dim = buckets, dim
        self.rng = np.random.default_rng(seed)
        self.e = ((self.rng.random((buckets, dim)) - 0.5) / dim).astype(np.float32)
        self.w, self.b = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)

    def _shares(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets of a text with each one's share of all its features."""
        at, n = np.unique(features([text], self.buckets)[1], return_counts=True)
        return at, (n / max(1, n.sum())).astype(np.float32)

    def fit(self, texts: list[str], labels: list[int], epochs: int = 4, rate: float = 2.0) -> SubwordModel:
        data = [(*self._shares(t), y) for t, y in zip(texts, labels)]
        if labels:
            prior = np.clip(np.mean(labels), 0.01, 0.99)
            self.b[:] = np.log(1 - prior), np.log(prior)
        steps, step = max(1, epochs * len(data)), 0
        for _ in range(epochs):
            for k in self.rng.permutation(len(data)):
                at, share, y = data[k]
                lr = np.float32(rate * (1 - step / steps))
                step += 1
                own = self.e[at]
                v = share @ own
                z = v @ self.w + self.b
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                back = self.w @ p
                self.w -= lr * np.outer(v, p)
                self.e[at] = own - np.outer(np.minimum(share * np.float32(40), np.float32(0.5)), back * lr)  # capped: a text of one word would leap
                self.b -= lr * np.float32(0.01) * p
        return self

    def folded(self) -> tuple[np.ndarray, float]:
        """Each bucket's share in the difference of the two logits, and the difference of the biases."""
        return (self.e @ (self.w[:, 1] - self.w[:, 0])).astype(np.float32), float(self.b[1] - self.b[0])


def score_texts(texts: Iterable[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Probabilities of label 1 by a folded model.  Texts are taken in groups of about ``_PIECE`` bytes."""
    out, group, size = [], [], 0

    def score():
        at, bucket = features(group, len(weights))
        n = np.bincount(at, minlength=len(group))
        total = np.bincount(at, weights=weights[bucket], minlength=len(group))
        out.append(1 / (1 + np.exp(-np.clip(bias + total / np.maximum(n, 1), -700, 700))))

    for t in texts:
        group.append(t)
        size += len(t)
        if size >= _PIECE:
            score()
            group, size = [], 0
    if group:
        score()
    return np.concatenate(out) if out else np.zeros(0)


def train_quality(docs: DataFrame, labels: DataFrame, max_train: int = 2500, epochs: int = 4) -> SubwordModel:
    """A model learnt from at most ``max_train`` labelled documents outside the held-out fold.

    The sample is the labelled documents whose hashed doc_id is smallest; a document labelled more than once counts as
    its smallest label.  Labels other than 0 and 1, null ids and documents without a text are not learnt from.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").cast("int").alias("_y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("_text")).where("_text is not null")
    sample = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_doc", "_text", "_y").toArrow()  # max_train ids bound the broadcast
    rows = sorted(zip(sample["_doc"].to_pylist(), sample["_text"].to_pylist(), sample["_y"].to_pylist()))[:max_train]
    model = SubwordModel().fit([r[1] for r in rows], [r[2] for r in rows], epochs)
    del sample, rows
    give_back()
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_train: int = 2500) -> DataFrame:
    """``docs`` with held_out, score (probability of label 1) and predicted (1 if score >= threshold), whole texts read.

    A null text counts as empty and gets the score that the model's bias gives.  Without any label the score is 0.5.
    Rows map one to one (repeated rows stay); columns of these names in ``docs`` are replaced.  One pass, no shuffle; the
    model (half a megabyte) is broadcast.
    """
    model = train_quality(docs, labels, max_train)
    weights, bias = model.folded()
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))
    docs = docs.drop("held_out", "score", "predicted")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["score double"])
    text_at = docs.columns.index("text")

    @tidy
    def run(batches):
        for batch in batches:
            scores = score_texts((t.as_py() or "" for t in batch.column(text_at)), *shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    scored = docs.mapInArrow(run, schema)
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
