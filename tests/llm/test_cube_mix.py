import random

import pytest

from tidewell.llm.cube_mix import cube_mix, fly, source_targets


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > cap * sizes[s]}
        if not over:
            return t | {s: cap * sizes[s] for s in capped}
        capped |= over


def test_targets(spark):
    rng = random.Random(4)
    for n in (1, 2, 7, 23):
        sizes = {f"s{i}": rng.choice([0, 3, 50, 900, 12345]) for i in range(n)} | {None: 70}
        got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        want = brute_targets(sizes)
        assert {r.source: r.source_size for r in got} == sizes
        for r in got:
            assert r.target == pytest.approx(want[r.source], abs=1e-6)


def test_flight_keeps_totals():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 50, 700):
        sizes = [float(rng.choice([0, 1, 5, 80, 3000])) for _ in range(n)]
        p = fly([0.3] * n, sizes, "s", False)
        assert sum(p) == pytest.approx(0.3 * n) and sum(a * b for a, b in zip(p, sizes)) == pytest.approx(0.3 * sum(sizes))
        assert sum(0 < x < 1 for x in p) <= 2 and all(0 <= x <= 1 for x in p)
        assert all(x in (0, 1) for x in fly([0.3] * n, sizes, "s", True))


def test_inclusion_probabilities():
    sizes = [1.0, 5.0, 9.0, 2.0, 7.0, 7.0]
    hits = [0.0] * 6
    for s in range(4000):
        for i, x in enumerate(fly([0.3] * 6, sizes, str(s), False)):
            hits[i] += x / 4000
    assert all(abs(h - 0.3) < 0.03 for h in hits)


def mixed(spark, rows, **more):
    return cube_mix(spark.createDataFrame(rows, "doc_id long, text string, source string, size string, n int"), **more)


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 200)) + "\n\x0bx", rng.choice(["a", "b", "c", None, "a", "a"]), "clash", 1) for i in range(600)]
    got = mixed(spark, rows, group_size=16).collect()
    again = mixed(spark, rows[::-1], group_size=16).repartition(7).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert len(got) == len(rows)
    per = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        per.setdefault(r.source, []).append(r)
    for rs in per.values():
        assert sum(r.size for r in rs) == rs[0].source_size
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs)


def test_edges(spark):
    assert mixed(spark, []).collect() == []
    rows = [(1, None, "a", "", 0), (1, None, "a", "", 0), (None, "one two", None, "", 0), (3, "", "z", "", 0), (4, "x" * 100_000, "b", "", 0)]
    got = mixed(spark, rows).collect()
    assert len(got) == 5 and sum(r.size for r in got) == 3
    assert all(r.taken == r.times * r.size for r in got)
