import base64
import hashlib

from tidewell.llm.warc import register, warc_records, warc_round_trip

SCHEMA = "page_id long, url string, html string, record_type int"


def brute(rows):
    out, first = [], {}
    for pid, _, html, _ in rows:
        body = (html or "").encode()
        first[body] = min(x for x in (first.get(body), pid) if x is not None) if (first.get(body) is not None or pid is not None) else None
    for pid, url, html, _ in rows:
        body = (html or "").encode()
        own = pid == first[body]
        out.append((pid, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if own else "revisit", None if own else first[body], url))
    return sorted(out, key=repr)


ROWS = [(5, "u5", "same", 1), (3, "u3", "same", 1), (9, None, "sàme\r\n\r\nWARC/1.1\r\n", 2), (4, "u\n4", None, None), (7, "u7", "", 1), (3, "u3", "same", 1), (None, "n", "same", 1), (11, "x", "y" * 300_000, 0)]


def test_round_trip(spark):
    got = warc_round_trip(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()
    want = [(*r[:5], r[5].replace("\n", " ") if r[5] else None) for r in brute(ROWS)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty(spark):
    assert warc_round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_min_bytes(spark):
    got = warc_round_trip(spark.createDataFrame(ROWS, SCHEMA), min_bytes=5).collect()
    assert {r.record_type for r in got if r.payload_bytes < 5} == {"response"}


def test_pushdown_splits_and_foreign_files(spark, tmp_path, monkeypatch):
    import tidewell.llm.warc as w

    monkeypatch.setattr(w, "_SPLIT_BYTES", 200)
    register(spark)
    rows = [(i, f"http://h{i % 3}/{i}", f"page {i // 2} " * 20, 0) for i in range(60)]
    out = w._Out(open(tmp_path / "a.warc.gz", "wb"))
    for i, url, html, _ in rows:
        out.record({"WARC-Type": "response" if i % 2 == 0 else "metadata", "WARC-Record-ID": str(i), "WARC-Target-URI": url}, html.encode())
    out.sink.close()
    assert len(out.offsets) > 3
    read = []
    for a, b in zip(out.offsets, [*out.offsets[1:], out.at]):  # every split on its own: no record twice or never
        with open(tmp_path / "a.warc.gz", "rb") as f:
            read += [h["WARC-Record-ID"] for h, _, _ in w._members(f, a, b)]
    assert read == [str(r[0]) for r in rows]
    back = spark.read.format("warc").load(str(tmp_path))
    assert back.count() == 60
    some = back.where("record_type = 'response' and target_uri like 'http://h0/%'")
    assert sorted(int(r.record_id) for r in some.collect()) == [i for i in range(60) if i % 6 == 0]
    assert {bytes(r.payload).decode() for r in some.collect()} == {rows[i][2] for i in range(0, 60, 6)}
    lean = spark.read.format("warc").option("payload", "false").load(str(tmp_path))
    assert lean.where("payload is not null").count() == 0
    with open(tmp_path / "plain.warc", "wb") as f:
        f.write(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 2)
    assert spark.read.format("warc").load(str(tmp_path / "plain.warc")).count() == 2


def test_pushed_filters_are_used():
    from pyspark.sql.datasource import EqualTo, GreaterThan

    from tidewell.llm.warc import WarcReader

    r = WarcReader({"path": "/x"})
    left = list(r.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_length",), 3)]))
    assert len(left) == 1 and r.passes({"record_type": "response"}) and not r.passes({"record_type": "revisit"})


def test_records_ignore_clashing_columns(spark):
    assert warc_records(spark.createDataFrame(ROWS, SCHEMA)).columns[1] == "record_type"


def test_two_appends(spark, tmp_path):
    """A second append keeps the records of the first; overwriting does not."""
    from tidewell.llm.warc import register, warc_records

    register(spark)
    path = str(tmp_path / "archive")
    write = lambda rows, mode: warc_records(spark.createDataFrame(rows, "page_id long, url string, html string")).write.format("warc").mode(mode).save(path)
    count = lambda: spark.read.format("warc").load(path).count()
    write([(1, "a", "x"), (2, "b", "y")], "append")
    write([(3, "c", "z")], "append")
    assert count() == 3
    write([(4, "d", None)], "overwrite")
    assert count() == 1
