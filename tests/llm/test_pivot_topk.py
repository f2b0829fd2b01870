import math
import random

from tidewell.llm.pivot_topk import pivot_topk

SCHEMA = "vec_id long, embedding array<float>, score int, rank string"


def brute(rows, k):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if i is not None and ok(v)]
    out = []
    for q, a in ints:
        if q % 10 == 0:
            found = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q and len(a) == len(b)))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def rows():
    rng = random.Random(2)
    f = lambda x: __import__("struct").unpack("f", __import__("struct").pack("f", x))[0]
    out = [(i, [f(rng.gauss(0, 1)) for _ in range(6)], 1, "r") for i in range(300)]
    out += [(i, out[i % 7][1], 1, "r") for i in range(300, 330)]
    out += [(400, None, 0, ""), (410, [float("nan")] * 6, 0, ""), (420, [None] * 6, 0, ""), (430, [0.5, 0.25], 0, ""), (431, [0.5, -0.25], 0, ""), (440, [], 0, ""), (None, [1.0] * 6, 0, ""), (450, [f(1e9)] * 6, 0, "")]
    return out


def test_against_brute_force(spark):
    data = rows()
    vectors = spark.createDataFrame(data, SCHEMA)
    for more in ({}, {"tile_rows": 50, "query_rows": 7, "n_pivots": 3, "sample_rows": 40}, {"n_pivots": 0}):
        got = pivot_topk(vectors, vectors.where("vec_id % 10 = 0"), k=5, **more).collect()
        assert sorted(map(tuple, got)) == brute(data, 5)


def test_few_and_none(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0], 0, "")], SCHEMA)
    assert pivot_topk(one, one).count() == 0
    assert pivot_topk(one.limit(0), one).count() == 0 and pivot_topk(one, one.limit(0)).count() == 0
