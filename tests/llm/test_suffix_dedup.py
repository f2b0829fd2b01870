import hashlib
import random

import pytest

from tidewell.llm.suffix_dedup import suffix_dedup


def brute(rows, length):
    """Window by window, documents in order of (doc_id, null last; hash of the text)."""
    texts = {(i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest()): (t or "").encode() for i, t, *_ in rows}
    seen, result = set(), {}
    for key in sorted(texts):
        raw = texts[key]
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        result[key] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return sorted(((i, *result[i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest()]) for i, t, *_ in rows), key=repr)


def data(seed, ids=True):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(5)]
    rows = []
    for i in range(50):
        parts = [rng.choice(passages) if rng.random() < 0.3 else " ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 6))]
        rows.append((i, "\n".join(parts), "x", 1))
    rows += [(60 + i, rows[3][1] + ("" if i % 2 else word()), "x", 1) for i in range(8)]
    rows += [(80, "a" * 700, "x", 1), (81, "ab" * 200, "x", 1), (82, "", "x", 1), (83, None, "x", 1), (84, "a" * 30, "x", 1)]
    if not ids:
        rows += [(None, rows[5][1], "x", 1), (3, rows[9][1], "x", 1), (7, rows[7][1], "x", 1), (None, passages[0], "x", 1)]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, h string, n_bytes int"


@pytest.mark.parametrize("seed, ids, length, limits", [(1, True, 100, {}), (2, False, 100, {"budget": 300, "in_memory": 20}), (3, True, 40, {"shard_bytes": 2000})])
def test_against_brute_force(spark, seed, ids, length, limits):
    rows = data(seed, ids)
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5), length=length, anchor=length * 2 // 5, bucket_anchors=50, **limits).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, length)


def test_long_texts_are_cut_into_overlapping_parts(spark, monkeypatch):
    import tidewell.llm.suffix_dedup as m

    monkeypatch.setattr(m, "_GROUP", 150)
    raw = [t.encode() for _, t, *_ in data(4) if t]
    found = [set(zip(d.tolist(), p.tolist())) for d, p, _ in m._anchor_groups(range(len(raw)), raw, 100, 40)]
    monkeypatch.setattr(m, "_GROUP", 1 << 20)
    whole = [set(zip(d.tolist(), p.tolist())) for d, p, _ in m._anchor_groups(range(len(raw)), raw, 100, 40)]
    assert set().union(*found) == set().union(*whole)


def test_empty_and_kept(spark):
    assert suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "q" * 50 + "w" * 120, "", 0), (2, "w" * 120 + "e", "", 0)]
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup(spark.createDataFrame(rows, SCHEMA), keep_bytes=True).collect()}
    assert got == {1: b"q" * 50 + b"w", 2: b"e"} or got[2] == b"e"
