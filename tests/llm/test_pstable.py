import random

import numpy as np
import pytest

from tidewell.llm.components import components
from tidewell.llm.pstable import collision, link_block, near_duplicates, tables


def brute(rows, cosine=0.9):
    good = [(i, k, np.array(v, float)) for k, (i, v, *_) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {k: 0 for k in range(len(rows))}, {i: i for i, *_ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, k, a in good:
        for j, m, b in good:
            if k < m and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                links[k] += 1
                links[m] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, links[k], find(i) if i is not None else None, i == find(i) if i is not None else None) for k, (i, *_) in enumerate(rows)), key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int, t int"


def data():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    rows = []
    for i in range(150):
        v = base[i % 12] + rng.normal(size=8) * rng.choice([0, 0.02, 0.1])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 3])], 0, 1))
    rows += [(200, None, 0, 0), (201, [0.0] * 8, 0, 0), (202, [float("nan")] * 8, 0, 0), (203, [None] * 8, 0, 0), (204, [], 0, 0), (205, rows[0][1][:4], 0, 0), (206, [float("inf")] + [1.0] * 7, 0, 0), (None, rows[1][1], 0, 0), (207, rows[3][1], 0, 0), (208, rows[3][1], 0, 0)]
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4096, 5])
def test_against_brute_force(spark, block):
    rows = data()
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), recall=0.999999, block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_at_threshold():
    k, n = tables(100_000, 0.9)
    p = collision(np.sqrt(0.2), 1.0)
    assert 1 - (1 - p**k) ** n >= 0.94
    rng = np.random.default_rng(0)
    a = rng.normal(size=(4000, 64))
    agree = np.mean(np.floor(a @ np.eye(64)[0] + 0.3) == np.floor(a @ (np.eye(64)[0] + np.sqrt(0.2) * np.eye(64)[1]) + 0.3))
    assert abs(agree - p) < 0.05


def test_pairs_of_earlier_tables_are_skipped():
    v = np.ones((3, 2)) / np.sqrt(2)
    ids, n, low = link_block(np.array([5, 3, 9]), np.array([1, 1, 4]), np.zeros(3), v, 1, False, 0.9, lambda x: np.array([[1, 1], [2, 1], [1, 1]]))
    assert dict(zip(ids, n)) == {5: 1, 3: 5, 9: 1} and set(low) == {3}


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(30)] + [(None, 1), (5, 5), (141, 100)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = components(spark.createDataFrame(edges, "x long, y long").repartition(5)).collect()
    assert {(r.id, r.component_id) for r in got} == {(x, find(x)) for x in root}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0
