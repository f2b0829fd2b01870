import random
from zlib import crc32

import numpy as np

from tidewell.llm.langid import WINDOW, ByteGru, language_id

WORDS = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "żółw gęś krąg śnieg".split(), "cc": "the quick brown fox jumps".split()}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def slow_sums(net, data):
    """Pooled distribution of one text, position by position, from the plain recurrences."""
    out = np.zeros(len(net.langs))
    for at in range(0, len(data), WINDOW):
        t = np.frombuffer(data[at : at + WINDOW].ljust(WINDOW, b"\0"), np.uint8)[:, None]
        hf, _ = net._forward(t, "f")
        hb, _ = net._forward(t[::-1], "b")
        z = np.concatenate([hf[:, 0], hb[::-1, 0]], 1) @ net.p["w"] + net.p["b"]
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        out += p[: len(data) - at].sum(0)
    return out / len(data)


def test_prediction_is_the_plain_recurrence():
    net = ByteGru(["a", "b", "c"], seed=1)
    texts = [b"x", b"some words " * 30, b"", b"q" * WINDOW, bytes(range(256))]
    for data, (best, score) in zip(texts, net.predict(texts)):
        if data:
            want = slow_sums(net, data)
            assert best == want.argmax() and abs(score - want.max()) < 1e-4
        else:
            assert (best, score) == (-1, 0.0)


def test_backpropagation_against_differences():
    rng = np.random.default_rng(0)
    net = ByteGru(["a", "b"], hidden=3, seed=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    t = rng.integers(0, 4, (5, 3))
    weight = rng.normal(size=(5, 3, 3))
    loss = lambda: float((net._forward(t, "f")[0] * weight).sum())
    grads = {}
    net._backward(t, "f", net._forward(t, "f")[1], weight, grads)
    for key in ("xf", "uf"):
        for i, j in [(0, 0), (1, 4), (2, 8), (0, 3)]:
            old, eps = net.p[key][i, j], 1e-3
            net.p[key][i, j] = old + eps
            up = loss()
            net.p[key][i, j] = old - eps
            down = loss()
            net.p[key][i, j] = old
            assert abs((up - down) / (2 * eps) - grads[key][i, j]) < 2e-2 * (1 + abs(grads[key][i, j]))


def test_table(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, lang := rng.choice("aa bb cc".split()), rng.randint(5, 60)), lang, "s") for i in range(200)]
    rows += [(900, None, "aa", "s"), (901, "", None, "s"), (902, "123 !?", "bb", "s"), (902, "123 !?", "bb", "s"), (None, text(rng, "cc", 9), None, "s"), (903, text(rng, "bb", 9000), "bb", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language_id(docs, steps=120).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    held = [(by[r[0]].lang_pred, r[2]) for r in rows[:200] if crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([a == b for a, b in held]) > 0.95 and by[903].lang_pred == "bb" and by[None].lang_pred == "cc"
    assert language_id(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id(docs.withColumn("lang", docs.lang.substr(9, 1)).where("doc_id < 0 or doc_id = 902")).collect()} == {"und"}
