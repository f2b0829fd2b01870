"""Removal of repeated byte strings: distributed suffix sorting of the text that can hold any.

1. Anchors.  Of each window of ``length`` bytes the k-byte string with the smallest hash is its anchor (leftmost on a
   tie); equal windows have equal anchors at equal offsets.  Anchors whose k bytes occur once in the corpus stand for
   windows that occur once, and this text is settled.
2. Pieces.  Around every other anchor lies a piece that holds all windows with this anchor.  Pieces are dealt to shards by
   the anchor's hash, so equal windows meet in a shard.  Equal pieces are combined before and after the shuffle: all but
   the earliest are repeats throughout, whatever their number.
3. Each shard's different pieces are suffix-sorted externally (see esort); runs of suffixes that share ``length`` bytes
   are repeated windows, of which all but the earliest are marked.
4. A document's marks meet at the document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import maybe_in, mix64, powers, saved
from tidewell.llm.esort import suffix_sort

_GROUP = 1 << 20  # bytes of text hashed at once (positions take 24 bits)
_FLUSH = 1 << 20  # anchors or pieces that a task combines at once
_SEPARATOR = 255  # no byte of UTF-8


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes at each position."""
    with np.errstate(over="ignore"):
        up, down = powers(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        return mix64((sums[k:] - sums[:-k]) * down[: len(b) - k + 1])


def anchors(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the anchors of all windows that lie in one text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    b = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(b) < length:
        return none, none, np.zeros(0, np.uint64)
    h = gram_hashes(b, k)
    low = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    least, width, span = low, 1, length - k + 1
    while 2 * width <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[: len(low) - span + 1], least[span - width :][: len(low) - span + 1])
    ends = np.cumsum(sizes)
    inside = np.zeros(len(b) + 1, np.int8)  # window starts that stay in their text
    starts, last = ends - sizes, np.maximum(ends - sizes, ends - length + 1)
    np.add.at(inside, starts, 1)
    np.add.at(inside, last, -1)
    ok = np.cumsum(inside[: len(least)]) > 0
    pos = np.unique((least[ok] & np.uint64((1 << 24) - 1)).astype(np.int64))
    text = np.searchsorted(ends, pos, side="right")
    return text, pos - starts[text], h[pos]


def _anchor_groups(ids, texts, length: int, k: int):
    """Anchors of many texts in groups of about _GROUP bytes; long texts in overlapping parts."""
    group, owner, shift, size = [], [], [], 0

    def flush():
        text, pos, h = anchors(group, length, k)
        return np.array(owner, np.int64)[text], pos + np.array(shift, np.int64)[text], h

    for doc, text in zip(ids, texts):
        for at in range(0, max(1, len(text) - length + 1), _GROUP):
            part = text[at : at + _GROUP + length - 1]
            if len(part) >= length:
                group.append(part)
                owner.append(doc)
                shift.append(at)
                size += len(part)
            if size >= _GROUP:
                yield flush()
                group, owner, shift, size = [], [], [], 0
    if group:
        yield flush()


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal values, and the runs' lengths."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.concatenate([starts, [len(values)]]))


def _by_doc(doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Candidates as a row for each document."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order].astype(np.int32)
    starts, n = _groups(doc)
    return pa.RecordBatch.from_arrays([pa.array(doc[starts], pa.int64()), pa.array([pos[a : a + m].tobytes() for a, m in zip(starts, n)], pa.binary())], ["doc", "pos"])


_ANCHORS = "bucket int, doc long, pos binary, keys binary, docs binary, flags binary"


def _find_anchors(length: int, k: int, buckets: int):
    def run(batches):
        held: list = []

        def flush():
            doc, pos, h = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((pos, doc, h))
            doc, pos, h = doc[order], pos[order], h[order]
            starts, n = _groups(h)
            many = np.repeat(n > 1, n)
            if many.any():  # met here already: candidates; one of them goes on to meet the others
                out = _by_doc(doc[many], pos[many])
                none = pa.nulls(len(out), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), -1, np.int32)), out.column(0), out.column(1), none, none, none], ["bucket", "doc", "pos", "keys", "docs", "flags"])
            doc, pos, h, known = doc[starts], pos[starts], h[starts], (n > 1)
            at = (h % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(at, kind="stable")
            doc, pos, h, known, at = doc[order], pos[order].astype(np.int32), h[order], known[order].astype(np.uint8), at[order]
            starts, n = _groups(at)
            pack = lambda a: pa.array([a[s : s + m].tobytes() for s, m in zip(starts, n)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(at[starts]), pa.nulls(len(starts), pa.int64()), pack(pos), pack(h), pack(doc), pack(known)], ["bucket", "doc", "pos", "keys", "docs", "flags"])

        size = 0
        for batch in batches:
            texts = (t.as_py().encode("utf-8", "surrogatepass") for t in batch.column(1))
            for found in _anchor_groups(batch.column(0).to_pylist(), texts, length, k):
                held.append(found)
                size += len(found[0])
                if size >= _FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _meet(batches):
    """Rows of a bucket come together: anchors that more than one task has seen are candidates."""
    at, held = None, []

    def flush():
        h, doc, pos, known = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        h, doc, pos, known = h[order], doc[order], pos[order], known[order]
        _, n = _groups(h)
        many = np.repeat(n > 1, n) & (known == 0)
        if many.any():
            yield _by_doc(doc[many], pos[many])

    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] < 0:
                yield pa.RecordBatch.from_arrays([pa.array([row["doc"]], pa.int64()), pa.array([row["pos"]], pa.binary())], ["doc", "pos"])
                continue
            if held and row["bucket"] != at:
                yield from flush()
                held = []
            at = row["bucket"]
            held.append((np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["docs"], np.int64), np.frombuffer(row["pos"], np.int32), np.frombuffer(row["flags"], np.uint8)))
    if held:
        yield from flush()


def _earliest(pieces):
    """Of equal pieces (doc, start, bytes) the earliest, and (doc, start, end) marks of the others."""
    first: dict[bytes, tuple[int, int]] = {}
    marks: list[tuple[int, int, int]] = []
    for doc, start, data in pieces:
        old = first.get(data)
        if old is None:
            first[data] = (doc, start)
        elif (doc, start) < old:
            first[data] = (doc, start)
            marks.append((*old, old[1] + len(data)))
        elif (doc, start) != old:
            marks.append((doc, start, start + len(data)))
    return first, marks


def _mark_rows(marks: list[tuple[int, int, int]]) -> pa.RecordBatch:
    a = np.array(sorted(marks), np.int64).reshape(-1, 3)
    starts, n = _groups(a[:, 0])
    data = [a[s : s + m, 1:].astype(np.int32).tobytes() for s, m in zip(starts, n)]
    none = pa.nulls(len(starts), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), -1, np.int32)), pa.array(a[starts, 0]), pa.array(data, pa.binary()), none, none, none], ["shard", "doc", "marks", "docs", "spans", "data"])


_PIECES = "shard int, doc long, marks binary, docs binary, spans binary, data binary"


def _cut_pieces(length: int, k: int, shards: int):
    def run(batches):
        held: dict[int, list] = {}
        size = 0

        def flush():
            for shard, pieces in held.items():
                first, marks = _earliest(pieces)
                if marks:
                    yield _mark_rows(marks)
                docs = np.array([d for d, _ in first.values()], np.int64)
                spans = np.array([[s, len(p)] for p, (_, s) in first.items()], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([docs.tobytes()], pa.binary()), pa.array([spans.tobytes()], pa.binary()), pa.array([b"".join(first)], pa.binary())], ["shard", "doc", "marks", "docs", "spans", "data"])

        for batch in batches:
            for doc, text, lists in zip(*(batch.column(c).to_pylist() for c in range(3))):
                raw = text.encode("utf-8", "surrogatepass")
                pos = np.unique(np.concatenate([np.frombuffer(p, np.int32) for p in lists])).astype(np.int64)
                b = np.frombuffer(raw, np.uint8)
                grams = np.lib.stride_tricks.sliding_window_view(b, k)[pos].astype(np.uint64)
                with np.errstate(over="ignore"):
                    up, _ = powers(k)
                    key = mix64(((grams + np.uint64(1)) * up).sum(1, dtype=np.uint64))
                shard = (mix64(key + np.uint64(1)) % np.uint64(shards)).astype(np.int64)
                for s, p in zip(shard.tolist(), pos.tolist()):
                    start = max(0, p - (length - k))
                    held.setdefault(s, []).append((doc, start, raw[start : p + length]))
                size += len(pos)
                if size >= _FLUSH // 8:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return run


def repeated_windows(segments: list[tuple[int, int, bytes]], length: int, **limits) -> list[tuple[int, int, int]]:
    """(doc, start, end) marks: bytes of windows of the segments (doc, start, bytes) that also start earlier.

    Overlapping segments of a document must agree; they are merged, so that each window occurs once.
    """
    merged: list[tuple[int, int, bytearray]] = []
    for doc, start, data in sorted(segments, key=lambda s: (s[0], s[1], -len(s[2]))):
        if merged and merged[-1][0] == doc and start <= merged[-1][1] + len(merged[-1][2]):
            known = merged[-1][1] + len(merged[-1][2]) - start
            if known < len(data):
                merged[-1][2].extend(data[known:])
        else:
            merged.append((doc, start, bytearray(data)))
    x = np.frombuffer(bytes([_SEPARATOR]).join(m[2] for m in merged), np.uint8)
    sizes = np.array([len(m[2]) for m in merged], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    whole = np.zeros(len(x) + 1, np.int32)  # windows that lie in one segment
    np.add.at(whole, at, 1)
    np.add.at(whole, np.maximum(at, at + sizes - length + 1), -1)
    whole = np.cumsum(whole) > 0
    cover = np.zeros(len(x) + length + 1, np.int32)
    tail: list[np.ndarray] = []

    def settle(pos: np.ndarray, new: np.ndarray) -> None:
        """Complete runs of equal windows: all but the earliest (positions are in order of document and start) repeat."""
        starts = np.flatnonzero(new)
        first = np.repeat(np.minimum.reduceat(pos, starts), np.diff(np.concatenate([starts, [len(pos)]])))
        again = pos[(pos != first) & whole[pos]]
        np.add.at(cover, again, 1)
        np.add.at(cover, again + length, -1)

    def emit(pos: np.ndarray, lcp: np.ndarray) -> None:
        new = lcp < length
        if tail:
            pos, new = np.concatenate([tail[0], pos]), np.concatenate([tail[1], new])
            tail.clear()
        new[0] = True
        last = int(np.flatnonzero(new)[-1])
        if last:
            settle(pos[:last], new[:last])
        tail.extend([pos[last:], new[last:]])

    suffix_sort(x, length, emit, **limits)
    if tail:
        settle(tail[0], tail[1])
    gone = np.cumsum(cover[: len(x)]) > 0
    edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
    marks = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):  # windows don't cross separators, nor do runs of them
        m = int(np.searchsorted(at, a, side="right")) - 1
        marks.append((merged[m][0], merged[m][1] + a - int(at[m]), merged[m][1] + b - int(at[m])))
    return marks


def _sort_shards(length: int, limits: dict):
    def run(batches):
        at, held = None, []

        def flush():
            first, marks = _earliest(held)
            marks += repeated_windows([(d, s, p) for p, (d, s) in first.items()], length, **limits)
            if marks:
                out = _mark_rows(marks)
                yield pa.RecordBatch.from_arrays([out.column(1), out.column(2)], ["doc", "marks"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([row["doc"]], pa.int64()), pa.array([row["marks"]], pa.binary())], ["doc", "marks"])
                    continue
                if held and row["shard"] != at:
                    yield from flush()
                    held = []
                at = row["shard"]
                docs, spans, data, k = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["spans"], np.int32).reshape(-1, 2), row["data"], 0
                for doc, (start, n) in zip(docs.tolist(), spans.tolist()):
                    held.append((doc, start, data[k : k + n]))
                    k += n
        if held:
            yield from flush()

    return run


def remaining(raw: bytes, marks: list[bytes]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs removed, bytes left) under lists of packed (start, end) pairs."""
    if not marks:
        return 0, 0, raw
    a = np.concatenate([np.frombuffer(m, np.int32).reshape(-1, 2) for m in marks])
    a = a[np.argsort(a[:, 0], kind="stable")]
    reach = np.maximum.accumulate(a[:, 1])
    new = np.concatenate([[True], a[1:, 0] > reach[:-1]])
    starts = a[new, 0]
    ends = np.concatenate([reach[:-1][new[1:]], reach[-1:]])
    left, at = [], 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        left.append(raw[at:s])
        at = e
    left.append(raw[at:])
    return int((ends - starts).sum()), len(starts), b"".join(left)


def suffix_dedup(docs: DataFrame, length: int = 100, anchor: int = 40, shard_bytes: int = 8 << 20, bucket_anchors: int = 1 << 20, keep_bytes: bool = False, **limits) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with ``keep_bytes`` kept, binary) for every row of ``docs``.

    A byte goes if a ``length``-byte string that covers it also starts earlier: in a document of smaller doc_id, or in the
    same document before.  Overlaps count, strings are judged on the input and lie within one document.  Texts are taken
    whole, in UTF-8; a null text is empty.  Rows that share a doc_id are ordered by the SHA-256 of their texts, a null
    doc_id comes last; rows equal in both are one document and each get its result.  An empty table gives no rows; other
    columns are ignored.  ``limits`` go to ``suffix_sort`` (what a task's queues hold in memory).
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    odd = base.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if odd:
        hashed = base.withColumn("h", F.sha2("text", 256))
        order = hashed.select("doc_id", "h").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "h").withColumn("doc", F.monotonically_increasing_id())
        order = saved(order, "order").withColumnsRenamed({"doc_id": "_id", "h": "_h"})
        rows = hashed.join(order, hashed["doc_id"].eqNullSafe(order["_id"]) & (hashed["h"] == order["_h"])).select("doc_id", "doc", "text")
        texts = rows.select("doc", "text").dropDuplicates(["doc"])
    else:
        rows = base.withColumn("doc", F.col("doc_id"))
        texts = rows.select("doc", "text")
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(12, total * 2 // (length - anchor) // bucket_anchors)
    met = texts.mapInArrow(_find_anchors(length, anchor, buckets), _ANCHORS)
    # what repeats within a task only passes through: such rows are dealt by document
    met = met.repartition(int(buckets), "bucket", F.when(F.col("bucket") < 0, F.col("doc"))).sortWithinPartitions("bucket").mapInArrow(_meet, "doc long, pos binary")
    met = saved(met, "anchors")
    pieces = met.agg(F.sum(F.length("pos"))).first()[0] or 0
    shards = max(12, pieces // 4 * (2 * length - anchor) // shard_bytes)
    repeats = met.groupBy(F.col("doc").alias("d")).agg(F.collect_list("pos").alias("lists"))
    some = maybe_in(texts, "doc", met.select(F.col("doc").alias("d")), "d").where("_maybe")
    cut = some.join(repeats, F.col("doc") == F.col("d")).select("doc", "text", "lists").mapInArrow(_cut_pieces(length, anchor, shards), _PIECES)
    # rows of marks only pass through: they are dealt by document
    dealt = cut.repartition(int(shards), "shard", F.when(F.col("shard") < 0, F.col("doc"))).sortWithinPartitions("shard")
    marks = saved(dealt.mapInArrow(_sort_shards(length, limits), "doc long, marks binary"), "marks")
    marks = marks.groupBy(F.col("doc").alias("d")).agg(F.collect_list("marks").alias("marks"))
    flagged = maybe_in(rows, "doc", marks, "d")  # texts without any mark are finished where they are read
    joined = flagged.where("_maybe").join(marks, F.col("doc") == F.col("d"), "left").select("doc_id", "text", "marks")
    joined = joined.unionByName(flagged.where("not _maybe").select("doc_id", "text", F.lit(None).cast("array<binary>").alias("marks")))

    def finish(batches):
        for batch in batches:
            out = []
            for text, lists in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                removed, spans, left = remaining(raw, lists or [])
                out.append((len(raw), removed, spans, hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*out)) if out else [[]] * 5
            arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_bytes:
                arrays, names = [*arrays, pa.array(cols[4], pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return joined.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
