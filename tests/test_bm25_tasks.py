"""BM25 scored in tasks gives what joining postings gives, and shuffles no postings."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import retrieval as R


def rows_of(df):
    return sorted(((r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "The", "THE", "o'neil", "x-1", "éa", *[f"w{k}" for k in range(12)]]) for _ in range(rng.randrange(0, 25))) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts + ["The w1 w2 w3"] * 80)] + [(2000, None), (2001, ""), (None, "the w4")]
    rng.shuffle(rows)
    asked = [(1, "the w1 W2 w2"), (2, "o'neil x-1 w3"), (3, "nothing"), (4, None), (5, ""), (None, "w5 w6"), (6, "w1"), (6, "w1 w7")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(asked, "query_id long, query string")


def test_against_joins(spark, tables, monkeypatch):
    docs, queries = tables
    for n in (None, 3, 700):
        got = R.bm25(docs, queries, n)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "SortMergeJoin" not in plan  # no postings
        with monkeypatch.context() as m:
            m.setattr(R, "MOST_ASKED", 0)
            want = R.bm25(docs, queries, n)
            assert rows_of(got) == rows_of(want) != []
            assert got.schema == want.schema or [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]


def test_shared_ids_and_no_queries(spark, tables):
    docs, queries = tables
    twice = docs.unionByName(docs.where("doc_id = 7"))
    assert rows_of(R.bm25(twice, queries, 3)) != []
    assert R.bm25(docs, queries.where(F.lit(False)), 3).count() == 0
