"""Files as documents: adapters by suffix and type, incremental sync, checksummed snapshots, Wikipedia-like dumps."""

from __future__ import annotations

import html
import json
import re
from email import message_from_bytes, policy

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.scalar import content_hash, detect_language

#: What suffixes and media types are.
SUFFIXES = {"html": "html", "htm": "html", "eml": "email", "json": "json", "jsonl": "jsonl", "md": "markdown", "markdown": "markdown", "txt": "text", "pdf": "pdf", "docx": "docx"}
CODE = {"py", "js", "ts", "go", "rs", "java", "c", "cc", "cpp", "h", "hpp", "rb", "php", "sh", "sql"}
MEDIA = {"text/html": "html", "message/rfc822": "email", "application/json": "json", "text/markdown": "markdown", "application/pdf": "pdf"}


def kind_of(uri: str, media: str = "") -> str:
    suffix = uri.rpartition(".")[2].lower() if "." in uri.rpartition("/")[2] else ""
    return SUFFIXES.get(suffix) or ("code" if suffix in CODE else MEDIA.get(media.split(";")[0].strip(), "text"))


def adapt(data: bytes, uri: str, media: str = "") -> tuple[str, str, str]:
    """(kind, title, text) of a file's bytes."""
    kind = kind_of(uri, media)
    if kind == "pdf":
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise ValueError("PDF needs pypdf") from e
        import io

        return kind, "", "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)
    if kind == "docx":
        import io
        import zipfile

        raw = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode("utf-8")
        paragraphs = re.findall(r"<w:p[ >].*?</w:p>", raw, re.S)
        return kind, "", "\n\n".join(html.unescape("".join(re.findall(r"<w:t[^>]*>(.*?)</w:t>", p, re.S))) for p in paragraphs)
    if kind == "email":
        m = message_from_bytes(data, policy=policy.default)
        parts = [p.get_content() for p in m.walk() if p.get_content_type() in ("text/plain", "text/html") and p.get_content_disposition() != "attachment"]
        return kind, str(m.get("Subject", "")), "\n\n".join(re.sub(r"(?s)<[^>]+>", " ", p) for p in parts)
    text = data.decode("utf-8-sig", "replace")
    if kind == "html":
        clean = re.sub(r"(?is)<(script|style).*?>.*?</\1>", " ", text)
        title = re.search(r"(?is)<title[^>]*>(.*?)</title>", clean)
        return kind, html.unescape(title[1]).strip() if title else "", html.unescape(re.sub(r"(?s)<[^>]+>", " ", clean))
    if kind == "json":
        return kind, "", json.dumps(json.loads(text), ensure_ascii=False, indent=2)
    if kind == "jsonl":
        return "json", "", json.dumps([json.loads(x) for x in text.splitlines() if x.strip()], ensure_ascii=False, indent=2)
    return kind, "", text


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """uri, kind, title, text, error, modified for every file under a path (any store that Spark reads)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    rows = files.select(F.col("path").alias("uri"), F.col("modificationTime").cast("long").alias("modified"), "content")

    def run(batches):
        for batch in batches:
            out = []
            for uri, when, data in zip(*(batch.column(c).to_pylist() for c in range(3))):
                try:
                    out.append((uri, when, *adapt(data, uri), None))
                except Exception as e:  # a bad file is a row with its error, not the end of the job
                    out.append((uri, when, kind_of(uri), None, None, str(e)))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 1 else pa.string()) for k, c in enumerate(cols)], ["uri", "modified", "kind", "title", "text", "error"])

    return rows.mapInArrow(run, "uri string, modified long, kind string, title string, text string, error string")


def sync_manifest(previous: DataFrame, current: DataFrame) -> DataFrame:
    """uri, status, content_hash, previous_uri from a previous manifest (uri, content_hash) and the current files (uri, content_hash).

    Known uris: unchanged or changed.  New ones: duplicate if a present file with the same content comes first (known
    uris before new ones), renamed if only a vanished one had it (the first new uri takes it), else created.  Vanished
    uris that were not renamed are deleted.  A null hash is rejected.
    """
    p = previous.select(F.col("uri").alias("uri"), F.col("content_hash").alias("old"))
    joined = current.select("uri", F.col("content_hash").alias("new")).join(p, "uri", "full_outer").withColumn("is_new", F.col("old").isNull() & F.col("uri").isNotNull())
    cur = current.select("uri", "content_hash")
    here = joined.join(cur.select(F.col("uri").alias("u"), F.lit(True).alias("present")), F.col("uri") == F.col("u"), "left").drop("u")
    here = here.withColumn("present", F.coalesce("present", F.lit(False)))
    first = here.where("present and new is not null").groupBy(F.col("new").alias("h")).agg(F.min(F.struct("is_new", "uri"))["uri"].alias("first_uri"))
    gone = here.where("not present").groupBy(F.col("old").alias("g")).agg(F.min("uri").alias("gone_uri"))
    out = here.join(first, F.col("new") == F.col("h"), "left").join(gone, F.col("new") == F.col("g"), "left")
    status = (
        F.when(F.col("present") & F.col("new").isNull(), "rejected")
        .when(F.col("present") & ~F.col("is_new") & (F.col("old") == F.col("new")), "unchanged")
        .when(F.col("present") & (F.col("first_uri") != F.col("uri")), "duplicate")
        .when(F.col("present") & ~F.col("is_new"), "changed")
        .when(F.col("present") & F.col("gone_uri").isNotNull(), "renamed")
        .when(F.col("present"), "created")
    )
    known = out.where("present").select("uri", status.alias("status"), F.col("new").alias("content_hash"), F.when(status == "renamed", F.col("gone_uri")).alias("previous_uri"))
    taken = known.where("status = 'renamed'").select(F.col("previous_uri").alias("uri"))
    lost = here.where("not present").join(taken, "uri", "left_anti").select("uri", F.lit("deleted").alias("status"), F.col("old").alias("content_hash"), F.lit(None).cast("string").alias("previous_uri"))
    return known.unionByName(lost)


def manifest(files: DataFrame) -> DataFrame:
    """uri, content_hash, language of parsed files."""
    return files.select("uri", F.when(F.col("text").isNotNull(), content_hash(F.col("text"))).alias("content_hash"), detect_language(F.col("text")).alias("language"))


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of all files: written beside a copy, it verifies and restores."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that are missing, new or different between two snapshots (paths relative to each)."""
    joined = before.alias("a").join(after.alias("b"), "path", "full_outer")
    state = F.when(F.col("b.sha256").isNull(), "missing").when(F.col("a.sha256").isNull(), "new").when(F.col("a.sha256") != F.col("b.sha256"), "different")
    return joined.select("path", state.alias("state")).where("state is not null")


def _balanced(text: str, start: str, end: str) -> str:
    """Text without balanced ``start`` ... ``end``; what is never closed stays."""
    out, depth, held, at = [], 0, [], 0
    for m in re.finditer(f"{re.escape(start)}|{re.escape(end)}", text):
        if m[0] == start:
            if depth == 0:
                out.append(text[at : m.start()])
                at = m.start()
            depth += 1
            held.append(m.start())
        elif depth:
            depth -= 1
            held.pop()
            if depth == 0:
                at = m.end()
    out.append(text[at:])
    return "".join(out)


def wikitext(text: str) -> str:
    """Plain text with Markdown headings: templates, tables, comments, references, galleries, files and markup removed."""
    text = _balanced(_balanced(text, "{{", "}}"), "{|", "|}")
    text = re.sub(r"(?m)^(={2,6})\s*(.*?)\s*\1$", lambda m: "#" * len(m[1]) + " " + m[2], text)
    text = re.sub(r"(?s)<!--.*?-->|<ref.*?</ref>|<gallery.*?</gallery>", "", text)
    text = re.sub(r"\[\[(?:file|image|category):[^\[\]]*(?:\[\[[^\]]*\]\][^\[\]]*)*\]\]", "", text, flags=re.I)
    text = re.sub(r"\[\[([^\]]*?)\]\]", lambda m: m[1].rpartition("|")[2], text)
    text = re.sub("<[^>]*>", "", text)
    text = text.replace("'''", "").replace("''", "")
    return re.sub("\n{3,}", "\n\n", text)


def wiki_pages(spark: SparkSession, path: str, most_chars: int = 2_000_000) -> DataFrame:
    """page_id, title, text of a MediaWiki export (bz2 too): articles only, without redirects, empty and oversized pages."""
    schema = "id long, ns int, title string, redirect struct<_title:string>, revision struct<text:string>"
    raw = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    rows = raw.where("ns = 0 and redirect is null").select(F.col("id").alias("page_id"), "title", F.col("revision.text").alias("raw"))
    rows = rows.where((F.length(F.trim("raw")) > 0) & (F.length("raw") <= most_chars))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([wikitext(t) for t in batch.column(2).to_pylist()], pa.string())], ["page_id", "title", "text"])

    return rows.mapInArrow(run, "page_id long, title string, text string")
