"""Orders whose numbers reach into those of the new rows, as in larger tables."""

from tidewell import registry


def test_numbers_beyond_a_million(spark, tmp_path):
    rows = [(i, "O", 200000.0 if i % 2 else 100.0) for i in (1, 2, 3, 1000001, 1000002, 1000003)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = registry.QUERIES["m07_insert_ignore"](spark, str(tmp_path))
    assert got.columns == ["o_orderkey", "o_orderstatus", "o_totalprice"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows + [(i + 1000000, "N", p) for i, _, p in rows if p > 150000])
