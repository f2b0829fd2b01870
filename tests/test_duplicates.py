"""Each document is compared with the 200 before it, wherever it stands in its tenant."""

from tidewell.operators import retrieval as R


def test_before_each(spark):
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, words(i), "t", i) for i in range(500)]
    for i, of in ((3, 1), (250, 50), (252, 51), (499, 480)):  # 2, 200, 201 and 19 before
        rows[i] = (i, words(of) + " more", "t", i)
    docs = spark.createDataFrame(rows, "doc_id long, text string, tenant string, ingested_at long")
    got = {(r.doc_id, r.of) for r in R.duplicates(docs).where("not exact").collect()}
    assert got == {(3, 1), (250, 50), (499, 480)}
