"""Scoped search in tiles gives what joining every pair gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import vectors as X


@pytest.mark.parametrize("metric", X.METRICS)
def test_against_all_pairs(spark, monkeypatch, metric):
    monkeypatch.setattr(X, "TILE_ROWS", 40)
    monkeypatch.setattr(X, "TILE_QUERIES", 7)
    rng = random.Random(3)
    vector = lambda: [float(rng.choice([-1, 0, 0.5, 1, 3])) for _ in range(3)]
    rows = [(rng.randrange(250), rng.choice([1, 1, 1, 2, 3, None]), vector()) for _ in range(300)]
    odd = [(901, 2, None), (902, 2, [None, 1.0, 1.0]), (903, 3, [1.0, 2.0]), (904, 3, [float("nan"), 1.0, 0.0]), (905, 1, [0.0, 0.0, 0.0])]
    rows += odd + [(i, 1, [1.0, 1.0, 1.0]) for i in range(1000, 1090)]
    asked = [(i, vector(), [rng.choice([1, 2, 3, 9]), rng.choice([1, 2, None])]) for i in range(40)] + [(50, None, [1]), (51, [1.0], [3]), (52, [0.0, 0.0, 0.0], [1, 2]), (53, [1.0, 1.0, 1.0], [1])]
    df = spark.createDataFrame(rows, "chunk long, scope int, embedding array<float>")
    queries = spark.createDataFrame(asked, "query_id long, query array<float>, scopes array<int>")
    got = X.scoped_search(df, queries, 5, metric=metric)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan  # no rows of all pairs
    pairs = df.join(queries.select("query_id", "query", F.explode("scopes").alias("_s")), F.col("scope") == F.col("_s"))
    scored = pairs.groupBy("query_id", "chunk").agg(F.max(-X.distance(F.col("embedding"), F.col("query"), metric)).alias("score"))
    want = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk"))).where("rank <= 5")
    rows_of = lambda d: sorted(map(repr, (tuple(r) for r in d.select("query_id", "chunk", "score", "rank").collect())))
    assert rows_of(got) == rows_of(want)
