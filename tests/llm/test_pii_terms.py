"""Terms are counted alike with and without their entity: outside personal values."""

from tests.llm.test_pii import SCHEMA, brute, data
from tidewell.llm.pii import pii_clean, pii_spans


def named():
    rows = [(i, f"{'Miller' if i < 3 else 'someone'} signs {'abcde'[i] * 4} as alice.miller@corp.example today", 0, 0) for i in range(5)]
    return rows + [(10 + i, f"signs as someone today number {'abcde'[i] * 3}", 0, 0) for i in range(5)]


def test_name_inside_address(spark):
    docs = spark.createDataFrame(named(), SCHEMA)
    got = {r.doc_id: r.spans for r in pii_spans(docs).collect()}
    assert sorted(i for i, s in got.items() if "term:" in s) == [0, 1, 2] and all("term:0:6" in got[i] for i in range(3))
    assert not any("Miller" in r.text or "miller" in r.text for r in pii_clean(docs).collect())


def test_against_equal_counts(spark):
    rows = [*data(), *named()]
    assert sorted(map(tuple, pii_spans(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=repr) == brute(rows)
