import random

import numpy as np
import pytest

from tidewell.llm.tjoin import Shingler, Similarity, jaccard_join, merge_skip, search_block


def brute(rows, n, num, den):
    def sh(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    root = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    s = [(r[0], sh(r[1])) for r in rows]
    for k, (i, a) in enumerate(s):
        for j, b in s[:k]:
            if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(a), find(i) if i is not None else None) for i, a in s), key=repr)


def data(seed, n_base=14):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(30))
    passage = [word() for _ in range(60)]
    texts = []
    for k in range(n_base):
        size = rng.choice([1, 2, 3, 5, 8, 14, 30, 70, 150, 400, 900])
        base = [word() for _ in range(size)]
        if k % 3 == 0:
            base += passage
        texts.append(base)
        for _ in range(rng.randrange(8)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 1 + size // 60, 1 + size // 30])):
                t[rng.randrange(len(t))] = word()
            texts.append(t if rng.random() < 0.7 else t + [word() for _ in range(1 + size // 25)])
    rng.shuffle(texts)
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(t).upper() if i % 5 == 0 else " ".join(t), 1, 2) for i, t in enumerate(texts)]
    return rows + [(9000, None, 1, 2), (9001, "", 1, 2), (9002, " \n", 1, 2), (None, rows[0][1], 1, 2), (9003, rows[0][1], 1, 2), (9003, rows[0][1], 1, 2), (9004, "Ä x", 1, 2), (9005, "ä x", 1, 2)]


SCHEMA = "doc_id long, text string, n_shingles int, component_id int"


@pytest.mark.parametrize("n, sim, block, seed", [(3, (90, 100), 8192, 1), (5, (80, 100), 8192, 2), (3, (90, 100), 3, 3), (2, (60, 100), 4, 4)])
def test_against_brute_force(spark, n, sim, block, seed):
    rows = data(seed)
    got = jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(3), n, sim, block=block, bucket_docs=4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, n, *sim)


def test_empty(spark):
    assert jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(0)
    for num, den in ((90, 100), (80, 100)):
        divide = Similarity(num, den, rng.integers(0, 9, 1 << 10, dtype=np.uint8))
        for _ in range(400):
            a = rng.integers(0, 2**64, rng.integers(1, 700), dtype=np.uint64)
            b = a.copy()
            while True:
                c = b.copy()
                if rng.random() < 0.5 and len(c) > 1:
                    c = np.delete(c, rng.integers(len(c)))
                else:
                    c = np.append(c, rng.integers(0, 2**64, dtype=np.uint64))
                common = len(np.intersect1d(a, c))
                if not divide.linked(common, len(a), len(c)):
                    break
                b = c
            a, b = np.sort(a), np.sort(b)
            assert len(np.intersect1d(divide.keys(a), divide.keys(b)))


def test_merge_skip():
    rng = random.Random(5)
    for _ in range(200):
        lists = [sorted(rng.sample(range(60), rng.randint(1, 40))) for _ in range(rng.randint(1, 9))]
        least = rng.randint(1, len(lists))
        counts = {j: sum(j in x for x in lists) for j in range(60)}
        assert list(merge_skip(lists, least)) == [(j, n) for j, n in counts.items() if n >= least]


def test_search_block():
    rng = random.Random(3)
    for trial in range(30):
        universe = range(40)
        sets = [set(rng.sample(universe, rng.randint(5, 30)))]
        for _ in range(25):
            s = set(rng.choice(sets))
            for _ in range(rng.randint(0, 3)):
                s ^= {rng.choice(universe)}
            sets.append(s or {1})
        divide = Similarity(80, 100)
        got = search_block([np.array(sorted(s), np.uint64) for s in sets], divide)
        assert [(i, len(s), c) for i, s, c in zip(range(99), sets, got)] == brute_sets(sets)


def brute_sets(sets):
    root = list(range(len(sets)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def test_shingler():
    s = Shingler(3)
    assert len(s("a b c d")) == 2 and len(s("a b")) == 1 and len(s("a")) == 1 and len(s(" ")) == 0
    assert (s("A b C") == s("a\tB c")).all() and not np.array_equal(s("Ä b c"), s("ä b c"))


@pytest.mark.parametrize("n, sim, seed", [(3, (90, 100), 3), (2, (60, 100), 4)])
def test_large_groups(spark, monkeypatch, n, sim, seed):
    """Blocks of three sets without much in common: what they leave apart is found by shared shingles."""
    from tidewell.llm import tjoin

    asked = []
    plain = tjoin._search_open
    monkeypatch.setattr(tjoin, "_ANCHORS", 1)
    monkeypatch.setattr(tjoin, "_search_open", lambda *a: (asked.append(plain(*a)), asked[-1])[1])
    rows = data(seed)
    got = jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(3), n, sim, block=3).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, n, *sim)
    assert len(asked) == 1 and asked[0].count() > 0


def test_linked_sets_share_a_mark():
    """Also where most shingles are common, and at any size."""
    rng = np.random.default_rng(1)
    ranks = np.where(rng.random(1 << 10) < 0.7, 3, 250).astype(np.uint8)
    for num, den in ((90, 100), (80, 100), (60, 100)):
        divide = Similarity(num, den, ranks)
        divide.rare = 100
        for trial in range(300):
            a = np.unique(rng.integers(0, 2**64, rng.integers(1, 400), dtype=np.uint64))
            if trial % 3 == 0:  # nearly all common
                a = a[(ranks[(a % np.uint64(1 << 10)).astype(int)] > 100) | (rng.random(len(a)) < 0.1)]
            b = a
            while len(a):
                c = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.union1d(b, rng.integers(0, 2**64, 1, dtype=np.uint64))
                if not divide.linked(len(np.intersect1d(a, c)), len(a), len(c)):
                    break
                b = c
            if not np.array_equal(a, b):
                assert len(np.intersect1d(divide.marks(a), divide.marks(b)))


def test_a_shared_shingle_makes_no_candidates(spark, monkeypatch):
    """Documents that chain up by one shingle each are not searched, however badly the sketch tells what is rare."""
    from tidewell.llm import tjoin

    searched = []
    plain = tjoin._sets
    monkeypatch.setattr(tjoin, "_COUNTERS", (4, 4))
    monkeypatch.setattr(tjoin, "_sets", lambda base, placed, n: (searched.append(placed.count()), plain(base, placed, n))[1])
    rng = random.Random(0)
    shared = [[f"s{rng.random()}" for _ in range(3)] for _ in range(81)]
    rows = [(i, " ".join(shared[i] + [str(rng.random()) for _ in range(120)] + shared[i + 1])) for i in range(80)]
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i) for i in range(80)]
    assert searched == [0]


def test_search_block_merges_no_lists_of_sets_that_cannot_link(monkeypatch):
    from tidewell.llm import tjoin

    merged = []
    monkeypatch.setattr(tjoin, "merge_skip", lambda lists, least: (merged.append(len(lists)), merge_skip(lists, least))[1])
    rng = np.random.default_rng(2)
    most = rng.integers(0, 2**64, 275, dtype=np.uint64)
    sets = [np.sort(np.concatenate([most, rng.integers(0, 2**64, 25, dtype=np.uint64)])) for _ in range(20)]
    assert search_block(sets, Similarity(90, 100)).tolist() == list(range(20)) and not merged
    assert search_block([*sets, sets[3][5:]], Similarity(90, 100)).tolist() == [*range(20), 3] and merged


@pytest.mark.parametrize("task, tables", [(4, None), (1 << 19, 2)])
def test_components_of_one_task_and_of_many(spark, monkeypatch, task, tables):
    """Few edges take two tables, the first forest and the whole one; the others go round by round."""
    from tidewell.llm import components as c

    wrote = []
    plain = c.saved
    monkeypatch.setattr(c, "_TASK", task)
    monkeypatch.setattr(c, "saved", lambda df, what: (wrote.append(what), plain(df, what))[1])
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (60, 61), (61, 60)]
    got = c.components(spark.createDataFrame(edges, "x long, y long").repartition(5)).collect()
    want = {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 140)}, 60: 60, 61: 60}
    assert len(got) == len(want) and {r.id: r.component_id for r in got} == want
    assert tables is None or len(wrote) == tables


def test_functions_for_workers_carry_no_tables():
    from pyspark import cloudpickle

    from tidewell.llm import common

    common.powers(10)
    assert len(cloudpickle.dumps(common.tidy(Shingler(3)))) < 100_000
    sent = cloudpickle.loads(cloudpickle.dumps(common.tidy(lambda batches: batches)))
    assert list(sent([1])) == [1] and not common._POWERS


def test_keys_of_large_groups_come_with_labels(spark, monkeypatch):
    """Labels meet documents, not each of their keys, of which a large group has very many."""
    from tidewell.llm import tjoin

    wrote = {}
    plain = tjoin.saved
    monkeypatch.setattr(tjoin, "_ANCHORS", 1)
    monkeypatch.setattr(tjoin, "saved", lambda df, what: wrote.setdefault(what, plain(df, what)) if what == "keys" else plain(df, what))
    rows = data(3)
    jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(3), 3, block=3)
    assert {"id", "label", "key"} <= set(wrote["keys"].columns) and wrote["keys"].where("key is not null and label is not null").count() > 0
