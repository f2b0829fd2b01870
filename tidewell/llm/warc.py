"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing makes one gzip member per record; a task's file becomes visible only when the driver's commit names it in the
folder's manifest, so lost or repeated tasks leave nothing behind that a reader would see.  The manifest also holds
member offsets, at which the reader splits files into partitions.  Reading parses a record's headers first, applies the
pushed-down predicates on record type and headers to them, and decodes a payload only for records that pass, and only
if the option ``payload`` is not ``false``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from tidewell.llm.common import fresh_dir

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, content_type string, payload_length long, headers map<string,string>, payload binary"
#: Header names of the format behind the columns; the last is this library's extension.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type", "payload_length": "X-Full-Payload-Length"}
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "_warc_manifest.json"
_SPLIT_BYTES = 8 << 20
_BATCH_BYTES = 16 << 20


def _store(path: str):
    """A file system and the path within it: local paths and file:, else what pyarrow knows (hdfs, s3, gs, ...)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class _Out:
    """Members are compressed one by one; offsets of members at least _SPLIT_BYTES apart are kept."""

    def __init__(self, sink):
        self.sink, self.at, self.offsets = sink, 0, [0]

    def record(self, headers: dict[str, str], block: bytes) -> None:
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
        z = zlib.compressobj(4, zlib.DEFLATED, 31)
        member = z.compress(head.encode("utf-8")) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()
        if self.at - self.offsets[-1] >= _SPLIT_BYTES:
            self.offsets.append(self.at)
        self.sink.write(member)
        self.at += len(member)


def _one_line(s) -> str:
    return str(s).replace("\r", " ").replace("\n", " ")


def _manifest(store, root: str) -> list[dict] | None:
    """The folder's committed files, or None where it has no manifest."""
    from pyarrow import fs

    if store.get_file_info(f"{root}/{_MANIFEST}").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{root}/{_MANIFEST}", compression=None) as f:
        return json.loads(f.read())


class _Committed(WriterCommitMessage):
    def __init__(self, name: str, offsets: list[int], size: int, records: int):
        self.name, self.offsets, self.size, self.records = name, offsets, size, records


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        name, records = f"part-{uuid.uuid4().hex}.warc.gz", 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as sink:
            out = _Out(sink)
            for batch in batches:
                for row in batch.to_pylist():
                    payload = row.get("payload")
                    fields = {HEADERS[c]: _one_line(row[c]) for c in HEADERS if row.get(c) is not None}
                    fields |= {_one_line(k): _one_line(v) for k, v in (row.get("headers") or []) if k not in fields and k not in ("Content-Length", "WARC-Profile")}
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                    if row.get("record_type") == "revisit":
                        fields["WARC-Profile"], block = _REVISIT, http
                    elif row.get("record_type") == "response":
                        block = http + (payload or b"")
                    else:
                        block = payload or b""
                    if row.get("record_type") in ("response", "revisit"):
                        fields["Content-Type"] = "application/http; msgtype=response"
                    out.record(fields, block)
                    records += 1
        return _Committed(name, out.offsets, out.at, records)

    def commit(self, messages) -> None:
        files = [{"name": m.name, "offsets": m.offsets, "size": m.size, "records": m.records} for m in messages if m]
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        if not self.overwrite:  # earlier archives of the folder stay; jobs that append to it come one after another
            files = (_manifest(store, root) or []) + files
        with store.open_output_stream(f"{root}/{_MANIFEST}", compression=None) as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        store, root = _store(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{root}/{m.name}")


class _Range(InputPartition):
    def __init__(self, file: str, start: int, end: int | None):
        self.file, self.start, self.end = file, start, end


def _members(f, start: int, end: int | None) -> Iterator[tuple[dict[str, str], int, "_Block"]]:
    """Headers, content length and the lazily read block of each record of a file from ``start`` to ``end``."""
    f.seek(start)
    reader = _Gunzip(f, start) if _is_gzip(f, start) else _Plain(f, start)
    while True:
        line = reader.line()
        while line is not None and not line.strip():  # blank lines between records
            line = reader.line()
        if line is None or end is not None and reader.began(line) >= end:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {reader.began(line)}: {line[:40]!r}")
        headers: dict[str, str] = {}
        last = None
        while (line := reader.line()) is not None and line.strip():
            if line[:1] in b" \t" and last:
                headers[last] += " " + line.decode("utf-8", "replace").strip()
                continue
            key, _, value = line.decode("utf-8", "replace").partition(":")
            last = key.strip()
            headers[last] = value.strip()
        length = int(next((v for k, v in headers.items() if k.lower() == "content-length"), 0))
        block = _Block(reader, length)
        yield headers, length, block
        block.skip()


class _Block:
    def __init__(self, reader, length: int):
        self.reader, self.left = reader, length

    def read(self) -> bytes:
        data, self.left = self.reader.take(self.left), 0
        return data

    def skip(self) -> None:
        if self.left:
            self.reader.drop(self.left)
            self.left = 0


def _is_gzip(f, start: int) -> bool:
    magic = f.read(2)
    f.seek(start)
    return magic == b"\x1f\x8b"


class _Plain:
    """Reads lines and byte counts from a stream."""

    def __init__(self, f, start: int):
        self.f, self.raw_at, self.buf, self.pos = f, start, b"", 0

    def began(self, line: bytes) -> int:
        """Offset in the file at which the record of this line, just read, begins."""
        return self.raw_at - (len(self.buf) - self.pos) - len(line)

    def more(self) -> bool:
        data = self.f.read(1 << 16)
        if data:
            self.raw_at += len(data)
            self.buf, self.pos = self.buf[self.pos :] + data, 0
        return bool(data)

    def line(self) -> bytes | None:
        while (i := self.buf.find(b"\n", self.pos)) < 0:
            if not self.more():
                rest, self.pos = self.buf[self.pos :], len(self.buf)
                return rest or None
        out, self.pos = self.buf[self.pos : i + 1], i + 1
        return out

    def take(self, n: int) -> bytes:
        parts = []
        while n:
            if self.pos == len(self.buf) and not self.more():
                break
            part = self.buf[self.pos : self.pos + n]
            self.pos += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)

    def drop(self, n: int) -> None:
        while n:
            if self.pos == len(self.buf) and not self.more():
                break
            step = min(n, len(self.buf) - self.pos)
            self.pos += step
            n -= step


class _Gunzip(_Plain):
    """The same over gzip members; a record begins where its member does."""

    def __init__(self, f, start: int):
        super().__init__(f, start)
        self.z, self.rest, self.member, self.fed, self.over = zlib.decompressobj(31), b"", start, start, False

    def began(self, line: bytes) -> int:
        return self.member

    def more(self) -> bool:
        while data := self.rest or self.f.read(1 << 16):
            if self.over:
                self.z, self.member, self.over = zlib.decompressobj(31), self.fed, False
            out = self.z.decompress(data)
            self.rest, self.over = self.z.unused_data, self.z.eof
            self.fed += len(data) - len(self.rest)
            if out:
                self.buf, self.pos = self.buf[self.pos :] + out, 0
                return True
        return False


class WarcReader(DataSourceReader):
    """Plans partitions from the manifest (or, without one, one per file) and keeps what Spark pushes down."""

    def __init__(self, options: dict[str, str]):
        self.path, self.with_payload = options["path"], options.get("payload", "true").lower() != "false"
        self.pushed: list = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else ()
            known = len(column) == 1 and column[0] in HEADERS and column[0] != "payload_length"
            if known and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                self.pushed.append(f)
            else:
                yield f

    def passes(self, row: dict) -> bool:
        for f in self.pushed:
            v = row[f.attribute[0]]
            ok = v is not None and (isinstance(f, IsNotNull) or isinstance(f, EqualTo) and v == f.value or isinstance(f, In) and v in f.value or isinstance(f, StringStartsWith) and v.startswith(f.value))
            if not ok:
                return False
        return True

    def partitions(self):
        from pyarrow import fs

        store, root = _store(self.path)
        if (files := _manifest(store, root)) is not None:
            return [_Range(m["name"], a, b) for m in files for a, b in zip(m["offsets"], [*m["offsets"][1:], m["size"]]) if m["records"]] or [_Range("", 0, 0)]
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            return [_Range("", 0, info.size)]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz")))
        return [_Range(n[len(root) :].lstrip("/"), 0, None) for n in names] or [_Range("", 0, 0)]

    def read(self, part: _Range):
        if part.end == 0:
            return
        store, root = _store(self.path)
        columns = [*HEADERS, "headers", "payload"]
        schema = pa.schema([(c, pa.int64() if c == "payload_length" else pa.map_(pa.string(), pa.string()) if c == "headers" else pa.binary() if c == "payload" else pa.string()) for c in columns])
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        with store.open_input_file(f"{root}/{part.file}" if part.file else root) as f:
            for headers, length, block in _members(f, part.start, part.end):
                low = {k.lower(): v for k, v in headers.items()}
                row = {c: low.get(h.lower()) for c, h in HEADERS.items()}
                if not self.passes(row):
                    continue
                row["headers"] = list(headers.items())
                full = row["payload_length"]
                row["payload_length"] = int(full) if full is not None and full.isdigit() else None
                row["payload"] = None
                if self.with_payload and row["record_type"] != "revisit":
                    data = block.read()
                    if (row["content_type"] or "").startswith("application/http"):
                        data = data.partition(b"\r\n\r\n")[2]
                    row["payload"] = data
                    if row["payload_length"] is None:
                        row["payload_length"] = len(data)
                    held += len(data)
                rows.append(row)
                held += 500
                if held >= _BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets its filters be pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def base32(hex_digest):
    """RFC 4648 base32 of a 40-digit hex column, in SQL functions: five hex digits make four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def letter(k):
        bits = F.conv(F.substring(hex_digest, 5 * (k // 4) + 1, 5), 16, 10).cast("int")
        return letters.substr(F.shiftright(bits, 15 - 5 * (k % 4)).bitwiseAND(F.lit(31)) + F.lit(1), F.lit(1))

    return F.concat(*[letter(k) for k in range(32)])


def warc_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One WARC record per row of ``pages`` (page_id long, url, html), equal payloads stored once.

    The payload is the html in UTF-8, a null html an empty payload.  Of rows with equal payloads of at least
    ``min_bytes`` bytes those with the smallest page_id are of type response, the others revisits of it (a null page_id
    counts as largest; rows that repeat the smallest page_id are responses all); smaller payloads are always responses.
    A null url gives no target URI.  Other columns are ignored; an empty table gives no records.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), body.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("payload_length", F.length("payload").cast("long"))
    first = rows.groupBy("sha1").agg(F.min("page_id").alias("first_id"))  # combined before the shuffle: a hot payload is one row a task
    joined = rows.join(first, "sha1")
    revisit = (F.col("payload_length") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    digest = base32(F.col("sha1"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return joined.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit("sha1:"), digest).alias("payload_digest"),
        F.when(revisit, urn(F.col("first_id"))).alias("refers_to"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        "payload_length",
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def warc_round_trip(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes ``warc_records(pages)`` as an archive in the shared folder, reads it back and reports on each page.

    Returns page_id, payload_bytes, payload_digest (for responses recomputed from the payload read back; for revisits the
    header's), record_type, refers_to (a page_id or null) and target_uri.
    """
    spark = pages.sparkSession
    register(spark)
    folder = folder or fresh_dir(spark, "warc")
    warc_records(pages, min_bytes).write.format("warc").mode("append").save(folder)
    back = spark.read.format("warc").load(folder)
    page = lambda c: F.regexp_extract(c, "^<urn:page:([0-9-]+)>$", 1)
    to_long = lambda c: F.when(F.length(c) > 0, c.cast("long"))
    own = F.col("record_type") == "response"
    return back.select(
        to_long(page(F.col("record_id"))).alias("page_id"),
        F.when(own, F.length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(own, base32(F.sha1("payload"))).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        to_long(page(F.col("refers_to"))).alias("refers_to"),
        "target_uri",
    )
