"""Terms that no entity could make disclosing are left out before texts' words meet their counts."""

import tidewell.llm.pii as pii
from tests.llm.test_pii import SCHEMA, brute
from tests.llm.test_pii_terms import named


def test_only_terms_that_can_disclose_meet_words(spark, monkeypatch):
    kept, saved = {}, pii.saved

    def watched(df, what):
        out = saved(df, what)
        kept.setdefault(what, []).append(out)
        return out

    monkeypatch.setattr(pii, "saved", watched)
    rows = [*named(), *[(20 + i, r[1], 0, 0) for i, r in enumerate(named())]]  # each text twice
    got = pii.pii_spans(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    counted = next(t for t in kept["terms"] if "asked" in t.columns)
    assert [r.asked for r in counted.collect()] == ["miller"]  # "today" and "signs" are in all texts
    assert {r.text for r in kept["different"][-1].collect()} == {r[1] for r in rows}  # a copied text is moved once, then kept
    assert len(kept["different"]) == 2
