"""Parsers hand on their rows in parts of bounded size, whatever a batch holds."""

import pyarrow as pa

from tidewell.sources import parse

TEXT = "# One\n\nfirst\nparagraph\n\n- item\n\n## Two\n\n" + "words and words. " * 300 + "\n\n```\ncode\n```\n"


def test_bounded_parts():
    texts = [f"{TEXT}\n{'x' * (i % 50)}\n\nend" for i in range(3000)]
    run = parse._in_parts(lambda t: iter(parse.parse(t, "markdown")), [pa.field(n, t) for n, t in zip(["n", *parse.Block._fields], [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()])], lambda b: len(b[3]) + len(b[5]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts)], ["id", "text"])
    parts = list(run(iter([batch])))
    assert max(p.num_rows for p in parts) <= parse._HELD_ROWS and max(p.nbytes for p in parts) < 2 * parse._HELD_CHARS
    got = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert got == [(i, n, *b) for i, t in enumerate(texts) for n, b in enumerate(parse.parse(t, "markdown"))]


def test_without_texts(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id long, text string")
    for read in (parse.parse_blocks, parse.chunk):
        whole = read(docs, "doc_id", "text")
        assert whole.drop("text").collect() == read(docs, "doc_id", "text", with_text=False).collect() != []
