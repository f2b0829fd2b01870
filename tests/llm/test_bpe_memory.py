"""Workers outlive their tasks, but vocabularies don't."""

import public_tokenizers as P
import pyarrow as pa

from tidewell.llm.bpe import bpe_encode


def test_no_vocabulary_is_left(spark):
    docs = spark.range(64).selectExpr("id AS doc_id", "concat('some text ', id) AS text").repartition(4)
    assert bpe_encode(docs, P.path("word_bpe_49k.json")).count() == 64
    bpe_encode(docs, P.path("word_bpe_49k.json"), outputs=("ids_sha256",)).collect()

    def left(batches):
        import gc

        for _ in batches:
            pass
        big = sum(type(x).__name__ == "WordBpe" for x in gc.get_objects())
        yield pa.RecordBatch.from_arrays([pa.array([big], pa.int64())], ["n"])

    assert [r.n for r in spark.range(64).repartition(4).mapInArrow(left, "n long").collect()] == [0] * 4
