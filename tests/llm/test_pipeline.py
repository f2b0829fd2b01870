"""The pipeline on a small fixture against a plain version of each stage."""

import collections

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.llm.test_pii import base
from tests.llm.test_tjoin import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rows = []
    for i in range(60):
        junk = i % 5 == 4
        body = " ".join(f"{'JUNK!!' if junk else 'plain'}{(i * 31 + k * 7) % 97}{'!!' if junk else ''}" for k in range(40))
        rows.append((i, body + (f" mail user{i}@host.example.com" if i % 7 == 0 else ""), "en", f"s{i % 3}", 1))
    rows += [(100 + i, rows[i][1] + (" extra" if i % 2 else ""), "en", "s1", 1) for i in range(10)]
    return [(i, t, x, s, len(t)) for i, t, x, s, _ in rows] + [(None, "plain text without id", "en", None, 21), (7, rows[7][1], "en", "s0", 3)]


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(fixture(), COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 != 4), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in C.STAGES] == ["quality", "near duplicates", "personal data", "mix", "tokens"]
    sf = str(tmp_path)
    good = spark.createDataFrame(C.quality(spark, docs, sf).collect(), COLUMNS)
    rows = [tuple(r) for r in good.collect()]
    assert good.columns == list(C.COLUMNS) and not any("JUNK" in r[1] for r in rows)
    assert collections.Counter(r for r in fixture() if "JUNK" not in r[1]) == collections.Counter(rows)

    single = spark.createDataFrame(C.near_duplicates(spark, good, sf).collect(), COLUMNS)
    want = {i for i, _, c in brute([(r[0], r[1]) for r in rows], 5, 80, 100) if i == c}
    got = [r[0] for r in single.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and single.columns == list(C.COLUMNS)

    clean = C.personal_data(spark, single, sf).collect()
    text = {r.doc_id: r.text for r in single.collect()}
    for r in clean:
        assert ("[EMAIL]" in r.text) == bool(base(text[r.doc_id])) and "@" not in r.text and r.n_chars == len(r.text)

    cleaned = spark.createDataFrame(clean, COLUMNS)
    mixed = [tuple(r) for r in C.mix(spark, cleaned, sf).collect()]
    from tidewell.llm.cube_mix import cube_mix

    times = {r.doc_id: r.times for r in cube_mix(cleaned).collect()}
    assert collections.Counter(r[0] for r in mixed) == collections.Counter({i: t for i, t in times.items() if t})
    assert mixed == [tuple(r) for r in C.mix(spark, cleaned, sf).collect()] or sorted(mixed, key=repr) == sorted(map(tuple, C.mix(spark, cleaned, sf).collect()), key=repr)

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in C.tokens(spark, cleaned, sf).collect():
        assert r.ids == lib.encode(next(x.text for x in clean if x.doc_id == r.doc_id), add_special_tokens=False).ids and r.n_tokens == len(r.ids)

    final = C.run(spark, sf)
    assert final.count() == len(mixed)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
