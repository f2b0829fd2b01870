"""Exact n-gram Jaccard join of documents by T-occurrence search (DivideSkip).

1. Blocking, exact by parts and prefixes.  Linked sets of some class of sizes differ in at most k shingles.  The hash space
   is cut into k + 1 + m ranges, so m + 1 of the parts that these cut from two linked sets are equal.  A part with a rare
   shingle is a key; other parts are none, so passages that many documents share make no candidates.  A set that has more
   than m parts without one (see Similarity.marks) takes prefixes too: in any one order of all shingles, two sets linked at
   similarity t share one of the first n - ceil(t n) + 1 of each; rare ones come first.  What is rare tells a sketch of
   counts over all documents (of fixed size, so it may misjudge; this changes the number of candidates only).
2. Documents that share a key are candidates, and their components are groups (over star edges, no pairs are written).
   A group is a block, or, if it is large, several blocks that have some sets in common.
3. In a block, T-occurrence search decides: every set looks up its shingles' inverted lists, merges the short ones with a
   heap that skips, probes the long ones by binary search, and keeps sets that reach the overlap its similarity needs.
   Sets whose bitmaps (see _bitmap) or sizes rule a link out are left out of the lists before.
   Only links between different components are searched, since the result is the components.
4. Where the blocks of a large group leave sets apart, those that share a shingle of their prefixes meet again (see
   _search_open), so candidates that chain up without being linked cost what shares a shingle, not the group's square.

Equal sets are one set in steps 2 to 4.
"""

from __future__ import annotations

import bisect
import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import join_hot, maybe_in, mix64, powers, saved, tidy
from tidewell.llm.components import components, forest

_SPACE = 32
_EDGES = 1 << 19
_HELD = 1 << 19  # keys that a task sorts at once
_MU = 0.01  # DivideSkip: how dear a probe is, which sets the number of long lists
_ANCHORS = 32  # sets that the blocks of a large group have in common
_SIZE, _EQUAL, _NEAR = 0, 1, 2  # kinds of rows: size of a set, equal sets, sets to compare
_COUNTERS = 22, 25  # powers of two: the sketch has from 4 to 32 megabytes
_CHUNK = 1 << 16
_BITS = 1024
_KEYS = 3  # of a bucket's usual number of documents, how many times fewer a bucket takes, as a set has many keys
_RARE = 4, 32  # a shingle is rare up to so many times the mean count of the sketch, and so many more
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class Shingler:
    """Sets of word n-grams as sorted distinct 64-bit hashes."""

    def __init__(self, n: int):
        self.n = n
        self.table = np.arange(256, dtype=np.uint8)
        self.table[9:14] = _SPACE
        self.table[65:91] += 32  # A-Z
        self.letter = mix64(np.arange(1, 257, dtype=np.uint64))

    def __call__(self, text: str | None) -> np.ndarray:
        """Words are runs of characters other than ASCII white space, A-Z lower-cased; fewer than n words are one shingle.

        A word's hash is a polynomial over its bytes, taken from prefix sums over the whole text.
        """
        b = self.table[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
        edge = np.diff(b != _SPACE, prepend=False, append=False)
        bounds = np.flatnonzero(edge)
        start, end = bounds[::2], bounds[1::2]
        if not len(start):
            return np.zeros(0, np.uint64)
        up, down = powers(len(b) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(self.letter[b] * up[:-1], out=sums[1:])
            words = mix64((sums[end] - sums[start]) * down[start])
            n = min(self.n, len(words))
            out = np.full(len(words) - n + 1, n, np.uint64)
            for i in range(n):
                out = mix64(out * _ODD[0] + words[i : len(words) - n + 1 + i])
        return np.unique(out)


class Similarity:
    """The threshold num / den, and the keys of which linked sets share one; ``ranks``: rarer shingles have smaller ones."""

    def __init__(self, num: int, den: int, ranks: np.ndarray | None = None):
        self.num, self.den, self.ranks = num, den, ranks
        self.rare = 255
        if ranks is not None:
            mean = np.bincount(ranks, minlength=256) @ (2.0 ** (np.arange(256) / 16) - 1) / len(ranks)
            self.rare = min(255, 16 * math.log2(1 + _RARE[0] * mean + _RARE[1]))
        self.tops = [0]  # the largest size of each class

    def _rank(self, s: np.ndarray) -> np.ndarray:
        return self.ranks[(s % np.uint64(len(self.ranks))).astype(np.int64)]

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The first n - ceil(t n) + 1 shingles of a set (of n, sorted) in order of rank and hash."""
        first = len(s) - -(-len(s) * self.num // self.den) + 1
        if self.ranks is not None and len(s):
            s = s[np.argsort(self._rank(s), kind="stable")]
        return s[:first]

    def marks(self, s: np.ndarray) -> np.ndarray:
        """Keys of a set (sorted, not empty): linked sets that are not equal share one.

        Sizes in a class differ by less than the threshold's factor, so of two linked sets the smaller one's class is the
        larger one's or the one before it; a set has keys for its own class and the next.  Linked sets of a class differ in
        at most ``apart`` shingles, which spoil as many parts, so at least ``spare`` + 1 parts are equal.  If at most
        ``spare`` parts of one set are without a rare shingle, an equal part has one and is a key of both.  Else both sets
        have more such parts, and both have prefixes.
        """
        while self.tops[-1] < len(s) or len(self.tops) < 3:
            self.tops.append((self.tops[-1] + 1) * self.den // self.num)
        own = bisect.bisect_left(self.tops, len(s))
        if own + 1 == len(self.tops):
            self.tops.append((self.tops[-1] + 1) * self.den // self.num)
        rare = np.ones(len(s), bool) if self.ranks is None else self._rank(s) <= self.rare
        mixed, high = mix64(s ^ _ODD[2]), s >> np.uint64(32)
        out, prefixes = [], False
        for k in (own, own + 1):
            apart = 2 * self.tops[k] * (self.den - self.num) // (self.den + self.num)
            if not apart:  # linked sets are equal
                continue
            spare = apart // 8 + 2
            parts = apart + 1 + spare
            part = (high * np.uint64(parts)) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            some = np.logical_or.reduceat(rare, starts)
            with np.errstate(over="ignore"):
                out.append(mix64(np.add.reduceat(mixed, starts)[some] + np.uint64(k) * _ODD[3]))
            prefixes |= parts - len(out[-1]) > spare
        return np.concatenate([*out, *([self.keys(s)] if prefixes else [])]) if out else np.zeros(0, np.uint64)

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)


def shingle_ranks(base: DataFrame, n: int, counters: int) -> np.ndarray:
    """Logarithmic ranks (a byte for each hashed shingle) by how many of all documents hold it."""

    @tidy
    def count(batches):
        shingle, counts = Shingler(n), np.zeros(counters, np.uint16)
        held, size = [], 0

        def add():
            np.add.at(counts, np.concatenate(held), np.uint16(1))
            np.minimum(counts, 60_000, out=counts)

        for batch in batches:
            for text in batch.column(1):
                held.append((shingle(text.as_py()) % np.uint64(counters)).astype(np.int64))
                size += len(held[-1])
                if size >= 1 << 20 or len(held) >= 4096:
                    add()
                    held, size = [], 0
        if held:
            add()
        some = [k for k in range(0, counters, _CHUNK) if counts[k : k + _CHUNK].any()]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([k // _CHUNK for k in some], pa.int32()), pa.array([zlib.compress(np.minimum(counts[k : k + _CHUNK], 255).astype(np.uint8).tobytes(), 1) for k in some], pa.binary())], ["chunk", "counts"])

    @tidy
    def add_up(batches):
        at, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.minimum(16 * np.log2(1.0 + total), 255).astype(np.uint8).tobytes()], pa.binary())], ["chunk", "ranks"])
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                if chunk != at:
                    if at is not None:
                        yield row()
                    at, total = chunk, np.zeros(min(counters, _CHUNK), np.int64)
                total += np.frombuffer(zlib.decompress(counts.as_py()), np.uint8)
        if at is not None:
            yield row()

    parts = base.mapInArrow(count, "chunk int, counts binary").repartition("chunk").sortWithinPartitions("chunk")
    ranks = np.zeros(counters, np.uint8)
    for r in saved(parts.mapInArrow(add_up, "chunk int, ranks binary"), "ranks").toLocalIterator():  # ``counters`` bytes in all
        ranks[r.chunk * _CHUNK : r.chunk * _CHUNK + _CHUNK] = np.frombuffer(r.ranks, np.uint8)
    return ranks


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by key and id: (first of each key: key, id), and (other, first) for the keys' other ids."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    first = ids[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(keys) else ids
    rest = ~new & (ids != first)
    return keys[new], ids[new], ids[rest], first[rest]


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs."""
    if not len(a):
        return a, b
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[keep], b[keep]


_BLOB = "kind int, bucket int, a long, b long, keys binary, ids binary"


def _emit(kind: int, a, b) -> pa.RecordBatch:
    """Rows that only pass through, dealt over all tasks."""
    n = len(a)
    none = pa.nulls(n, pa.binary())
    a = a if isinstance(a, pa.Array) else pa.array(a, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array((-1 - np.arange(n) % 1009).astype(np.int32)), a, pa.array(b, pa.int64()), none, none], ["kind", "bucket", "a", "b", "keys", "ids"])


def _hash_sets(n: int, num: int, den: int, ranks, buckets: int):
    """Per task: sizes, local stars, and each bucket's keys (for exact and near matches) in packed form."""

    def run(batches):
        shingle, divide = Shingler(n), Similarity(num, den, ranks.value)
        keys, ids, kinds, held = [], [], [], 0
        top = np.uint64(buckets)

        def flush():
            for kind in (_EQUAL, _NEAR):
                k = [x for x, z in zip(keys, kinds) if z == kind]
                if not k:
                    continue
                k, i = np.concatenate(k), np.concatenate([x for x, z in zip(ids, kinds) if z == kind])
                k, i, other, first = _stars(k, i)
                if len(other):
                    yield _emit(kind, *_pairs(other, first))
                at = (mix64(k) % top).astype(np.int32)  # shingles of one sketch counter are not of one bucket
                order = np.argsort(at, kind="stable")
                k, i, at = k[order], i[order], at[order]
                starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                ends = [*starts[1:].tolist(), len(at)]
                m = len(starts)
                none = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), pa.array(at[starts]), none, none, pa.array([k[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()), pa.array([i[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], ["kind", "bucket", "a", "b", "keys", "ids"])

        for batch in batches:
            sizes = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle(text.as_py())
                sizes.append(len(s))
                if doc is None or not len(s):
                    continue
                keys.append(mix64(np.array([np.add.reduce(mix64(s ^ _ODD[1])) ^ np.uint64(len(s))], np.uint64)))
                ids.append(np.array([doc], np.int64))
                kinds.append(_EQUAL)
                k = divide.marks(s)
                keys.append(k)
                ids.append(np.full(len(k), doc, np.int64))
                kinds.append(_NEAR)
                held += len(k)
                if held >= _HELD:
                    yield from flush()
                    keys, ids, kinds, held = [], [], [], 0
            yield _emit(_SIZE, batch.column(0).cast(pa.int64()), sizes)
        yield from flush()

    return run


def _match(batches):
    """Rows of a bucket come together, its packed keys one after another; everything else passes through.

    Sets to compare are contracted to a spanning forest over all of a task's buckets: only their components are used.
    """
    held_keys, held_ids, held_at = [], [], None
    near: list[tuple[np.ndarray, np.ndarray]] = []
    names = ["kind", "a", "b"]

    def rows(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)

    def flush():
        _, _, other, first = _stars(np.concatenate(held_keys), np.concatenate(held_ids))
        a, b = _pairs(other, first)
        if held_at[0] == _NEAR:
            yield from compare(a, b)
        elif len(a):
            yield rows(held_at[0], a, b)

    def compare(a, b, last=False):
        if len(a):
            near.append((a, b))
        if near and (last or sum(len(x) for x, _ in near) > _EDGES):
            a, b = forest(np.concatenate([x for x, _ in near]), np.concatenate([y for _, y in near]))
            near.clear()
            if last or len(a) > _EDGES // 2:
                yield rows(_NEAR, a, b)
            else:
                near.append((a, b))

    for batch in batches:
        packed = batch.column("keys").is_valid()
        plain = batch.filter(pa.compute.and_(pa.compute.invert(packed), pa.compute.equal(batch.column("kind"), _NEAR)))
        yield from compare(plain.column("a").to_numpy(), plain.column("b").to_numpy())
        plain = batch.filter(pa.compute.and_(pa.compute.invert(packed), pa.compute.not_equal(batch.column("kind"), _NEAR)))
        if len(plain):
            yield pa.RecordBatch.from_arrays([plain.column("kind"), plain.column("a"), plain.column("b")], names)
        full = batch.filter(packed)
        for kind, bucket, k, i in zip(full.column("kind").to_pylist(), full.column("bucket").to_pylist(), full.column("keys"), full.column("ids")):
            if held_keys and (kind, bucket) != held_at:
                yield from flush()
                held_keys, held_ids = [], []
            held_at = kind, bucket
            held_keys.append(np.frombuffer(k.as_py(), np.uint64))  # copies of one row at a time
            held_ids.append(np.frombuffer(i.as_py(), np.int64))
    if held_keys:
        yield from flush()
    none = np.zeros(0, np.int64)
    yield from compare(none, none, True)


def search_block(sets: list[np.ndarray], divide: Similarity, label: np.ndarray | None = None) -> np.ndarray:
    """Component labels (positions of the smallest member) of sets under the join's links.

    ``label``: components that are known already.  DivideSkip: a set's short inverted lists are merged by a heap that skips
    what cannot occur often enough, its long ones are probed by binary search.  A set in the searching one's own
    component is no candidate any more, as only components are asked for, nor is one whose size or bitmap rules a link out.
    """
    n = len(sets)
    label = np.arange(n) if label is None else label.copy()
    if (label == label[0]).all():
        return label
    # inverted lists, ascending, one after another; a shingle of one set only has no list
    sizes = np.array([len(s) for s in sets])
    at = np.repeat(np.arange(n, dtype=np.int32), sizes)
    tokens = np.concatenate(sets)
    by = np.argsort(tokens, kind="stable")
    tokens, at = tokens[by], at[by]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    heads = np.flatnonzero(new)
    lengths = np.diff(np.concatenate([heads, [len(at)]]))
    of = np.empty(len(by), np.int32)
    of[by] = (np.cumsum(new) - 1).astype(np.int32)
    del tokens, by, new
    ends = np.cumsum(sizes)
    bits = np.stack([_bitmap(s) for s in sets]).view(np.uint64)
    for i in np.argsort(sizes, kind="stable")[::-1]:
        size = int(sizes[i])
        fits = (label != label[i]) & (sizes <= size) & (sizes * divide.den >= divide.num * size)  # larger sets search themselves
        near = np.flatnonzero(fits)
        differ = np.bitwise_count(bits[near] ^ bits[i]).sum(1, dtype=np.int64)
        fits[near] = differ * (divide.num + divide.den) <= (sizes[near] + size) * (divide.den - divide.num)
        if not fits.any():
            continue
        need = -(-size * divide.num // divide.den)
        mine = of[ends[i] - size : ends[i]]
        mine = mine[lengths[mine] > 1]
        if len(mine) < need:
            continue
        mine = mine[np.argsort(lengths[mine], kind="stable")]
        own = [at[a : a + m] for a, m in zip(heads[mine].tolist(), lengths[mine].tolist())]
        n_long = min(need - 1, int(need / (_MU * math.log2(max(2, len(own[-1]))) + 1)))
        short, long = own[: len(own) - n_long], own[len(own) - n_long :]
        found = np.concatenate(short)
        fits = fits[found]
        if not fits.any():
            continue
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in short])])
        cut = np.concatenate([[0], np.cumsum(fits)])[bounds]
        found = found[fits].tolist()
        for j, count in merge_skip([found[a:b] for a, b in zip(cut, cut[1:]) if a < b], max(1, need - n_long)):
            if label[j] == label[i]:
                continue
            want = -(-divide.num * (size + int(sizes[j])) // (divide.num + divide.den))
            for k, postings in enumerate(long):
                if count >= want or count + len(long) - k < want:
                    break
                p = np.searchsorted(postings, j)
                count += int(p < len(postings) and postings[p] == j)
            if count >= want:
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
    return label


def merge_skip(lists: list[list[int]], least: int):
    """(position, occurrences) of positions in at least ``least`` ascending lists, by a heap of the lists' heads.

    Where the smallest head does not occur often enough, the ``least`` - 1 smallest heads are taken out and their lists
    jump, by binary search, to the smallest head that is left: nothing before it can reach ``least``.
    """
    at = [0] * len(lists)
    heap = [(x[0], k) for k, x in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= least:
        low, out = heap[0][0], []
        while heap and heap[0][0] == low:
            out.append(heapq.heappop(heap)[1])
        if len(out) >= least:
            yield low, len(out)
            for k in out:
                at[k] += 1
        else:
            while len(out) < least - 1:
                out.append(heapq.heappop(heap)[1])
            for k in out:  # least - 1 < len(heap) + len(out), so a head is left
                at[k] = bisect.bisect_left(lists[k], heap[0][0], at[k])
        for k in out:
            if at[k] < len(lists[k]):
                heapq.heappush(heap, (lists[k][at[k]], k))


def jaccard_join(docs: DataFrame, n: int = 3, similarity: tuple[int, int] = (90, 100), block: int = 2048, bucket_docs: int = 131072, block_shingles: int = 1 << 21) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id long, text).

    A document's set holds its distinct ``n``-word shingles (words: runs of characters other than ASCII white space, with
    A-Z lower-cased; fewer than n words are one shingle).  Two documents link when
    den * intersection >= num * union for ``similarity`` (num, den); component_id is the smallest doc_id reachable by
    links, itself included.  A null text or one without words has an empty set and links with nothing.  A null doc_id links with
    nothing and has a null component_id; rows that share a doc_id are one document for links (any of their texts), yet
    each is returned with its own n_shingles.  Texts of any length are taken whole.  An empty table gives no rows; other
    columns are ignored.  Shingles and whole sets are compared as 64-bit hashes.

    A block holds up to ``block`` sets and about ``block_shingles`` shingles (one set at least).  Larger groups of
    candidates are searched in blocks that have some sets in common, and what these leave apart is searched again, by the
    shingles that the sets share, between sets of different components only.
    """
    spark = docs.sparkSession
    num, den = similarity
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_docs, letters = base.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    buckets = max(16, -(-n_docs * _KEYS // bucket_docs) * 16)
    counters = 1 << min(_COUNTERS[1], max(_COUNTERS[0], (letters // 64).bit_length()))  # about a counter for ten shingles
    ranks = spark.sparkContext.broadcast(shingle_ranks(base, n, counters))
    packed = base.mapInArrow(tidy(_hash_sets(n, num, den, ranks, buckets)), _BLOB).repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")
    found = saved(packed.mapInArrow(tidy(_match), "kind int, a long, b long"), "matches")
    sizes = found.where(F.col("kind") == _SIZE).select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    equal = found.where(F.col("kind") == _EQUAL).select("a", "b").distinct()
    near = found.where(F.col("kind") == _NEAR).select("a", "b")
    # a document that equals a smaller one leaves the search, which stands for it; not so an id with several texts
    blocks = components(near.unionByName(equal))
    known = sizes.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.sum("n_shingles").alias("w"), F.count("*").alias("rows"))
    copies = equal.select(F.col("a").alias("copy")).distinct().join(known.where("rows > 1"), F.col("copy") == F.col("_id"), "left_anti").select("copy")
    members = blocks.join(copies, blocks["id"] == copies["copy"], "left_anti")
    members = saved(members.join(known, F.col("id") == F.col("_id")).select("id", F.col("component_id").alias("c"), "w"), "members")
    many = members.groupBy(F.col("c").alias("_c")).agg(F.count("*").alias("n"), F.sum("w").alias("shingles")).where("n > 1")
    many = many.withColumn("parts", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("shingles") / block_shingles)).cast("int"))
    many = saved(many, "candidates")
    members = saved(join_hot(members, "c", many, "_c", "n").select("id", "c", "w", "n", "parts"), "members")
    at = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    anchor = F.pmod(F.xxhash64("id", F.lit(5)), F.ceil(F.col("n") / _ANCHORS)) == 0  # members of every block
    placed = members.withColumn("i", F.explode(F.when(anchor, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(at))))
    cells = _sets(base, placed.select("id", "c", "i", F.lit(0).alias("j"), F.col("id").alias("label")), n)
    links = saved(_search(cells, num, den).unionByName(equal), "links")
    comps = components(links)
    large = members.where("parts > 1")
    if large.limit(1).count():
        more = _search_open(base, large, comps, n, num, den, ranks, block, block_shingles)
        if more is not None:
            comps = components(links.unionByName(more))
    out = sizes.join(comps, sizes["doc_id"] == comps["id"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _sets(base: DataFrame, placed: DataFrame, n: int) -> DataFrame:
    """``placed`` (id, c, i, j, label: where sets go) with the sets themselves in ``data``."""

    @tidy
    def sets(batches):
        shingle = Shingler(n)
        for batch in batches:
            for at in range(0, len(batch), 256):
                piece = batch.slice(at, 256)
                data = [shingle(t.as_py()).tobytes() for t in piece.column(5)]
                yield pa.RecordBatch.from_arrays([*piece.columns[:5], pa.array(data, pa.binary())], ["c", "i", "j", "id", "label", "data"])

    some = maybe_in(base, "doc_id", placed, "id").where("_maybe")  # other texts stay out of the shuffle
    texts = some.join(placed, F.col("doc_id") == F.col("id")).select("c", "i", "j", "id", "label", "text")
    return texts.mapInArrow(sets, "c long, i int, j int, id long, label long, data binary")


def _search(cells: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): each set of a cell (c, i, j) with the smallest id of its component there; ``label`` tells known components."""

    @tidy
    def search(batches):
        divide = Similarity(num, den)
        held, held_at = [], None

        def flush():
            rows = sorted(held)
            ids = np.array([r[0] for r in rows], np.int64)
            _, first, at = np.unique(np.array([r[1] for r in rows], np.int64), return_index=True, return_inverse=True)
            old = first[at]  # the first row of a label is its smallest id
            label = search_block([np.frombuffer(r[2], np.uint64) for r in rows], divide, old)
            own = np.flatnonzero((ids[label] != ids) & (label != old))
            return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[label][own])], ["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(5)))
            for (c, i, j, doc, label), data in zip(keys, batch.column(5)):
                if (c, i, j) != held_at:
                    if len(held) > 1:
                        yield flush()
                    held, held_at = [], (c, i, j)
                data = data.as_py()
                if data:
                    held.append((doc, label, data))
        if len(held) > 1:
            yield flush()

    dealt = cells.select("c", "i", "j", "id", "label", "data").repartition("c", "i", "j").sortWithinPartitions("c", "i", "j")
    return dealt.mapInArrow(search, "a long, b long")


def _bitmap(s: np.ndarray) -> np.ndarray:
    """_BITS bits, each the parity of the shingles that hash to it: two sets differ in no fewer shingles than bits."""
    return np.packbits((np.bincount((mix64(s) % np.uint64(_BITS)).astype(np.int64), minlength=_BITS) & 1).astype(np.uint8))


def _search_open(base: DataFrame, large: DataFrame, comps: DataFrame, n: int, num: int, den: int, ranks, block: int, block_shingles: int) -> DataFrame | None:
    """Links between different components within large groups of candidates, or None where no such group is left.

    Linked sets share a key (a shingle of their prefixes).  Two sets with a key need not meet there if they lie in one
    component, or if the same key comes just before it in both prefixes: they share that one too, and meet at the first for
    which this is not so.  So passages that many sets begin with cost one meeting, not one for each shingle.  Of the sets
    with one key those outside the commonest component, or without the commonest key before it, (strays) meet all others,
    each pair once, block by block, but as bitmaps only.  Sets whose bitmaps allow a link are searched.
    """
    labels = comps.select(F.col("id").alias("_id"), F.col("component_id").alias("label"))
    labelled = large.select("id", "c", "w").join(labels, F.col("id") == F.col("_id"), "left").select("id", "c", "w", F.coalesce("label", "id").alias("label"))
    labelled = saved(labelled, "labelled")
    apart = labelled.groupBy(F.col("c").alias("_c")).agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    apart = saved(apart.where("low <> high").select("_c", "n"), "apart")
    if not apart.limit(1).count():
        return None
    left = saved(join_hot(labelled, "c", apart, "_c", "n").select(F.col("id").alias("_id"), "w", "label"), "left")

    @tidy
    def draw(batches):
        """Keys, with those before them, and bitmaps (with a null key) of documents."""
        divide, shingle = Similarity(num, den, ranks.value), Shingler(n)
        types = [("id", pa.int64()), ("label", pa.int64()), ("key", pa.int64()), ("prev", pa.int64()), ("size", pa.int64()), ("bits", pa.binary())]
        for batch in batches:
            for doc, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if len(s := shingle(text.as_py())):
                    k = divide.keys(s)
                    keys = [None, *k.view(np.int64).tolist()]
                    columns = [doc] * len(keys), [label] * len(keys), keys, [None, *keys[:-1]], [len(s)] + [None] * len(k), [_bitmap(s).tobytes()] + [None] * len(k)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types)], [c for c, _ in types])

    some = maybe_in(base, "doc_id", left, "_id").where("_maybe").join(left, F.col("doc_id") == F.col("_id")).select("_id", "label", "text")
    drawn = saved(some.mapInArrow(draw, "id long, label long, key long, prev long, size long, bits binary"), "keys")
    keyed = drawn.where("key is not null").select("id", "key", "prev", "label")
    both = F.array(F.struct(F.lit(0).alias("by"), F.col("label").alias("of")), F.struct(F.lit(1).alias("by"), F.col("prev").alias("of")))
    per = keyed.select("key", F.explode(both).alias("class")).groupBy("key", "class.by", "class.of").agg(F.count("*").alias("n"))
    labels = F.sum(F.when(F.col("by") == 0, 1).otherwise(0))
    per = per.groupBy(F.col("key").alias("_key")).agg((F.sum("n") / 2).cast("long").alias("n"), F.max(F.when(F.col("of").isNotNull(), F.struct("n", "by", "of"))).alias("top"), labels.alias("labels"))
    number = lambda m: F.ceil(m / block).cast("int")
    per = per.where("labels > 1 and top.n < n")  # else no two sets have to meet here
    per = saved(per.select("_key", "n", "top.by", F.col("top.of").alias("major"), number(F.col("n")).alias("parts"), number(F.col("n") - F.col("top.n")).alias("strays")), "open")
    apart = ~F.coalesce(F.when(F.col("by") == 0, F.col("label")).otherwise(F.col("prev")) == F.col("major"), F.lit(False))
    placed = join_hot(keyed, "key", per, "_key", "n").withColumn("stray", apart)
    hashed = lambda of, m: F.pmod(F.xxhash64("id", F.lit(of)), F.col(m)).cast("int")
    right = F.transform(F.sequence(F.lit(0), F.col("strays") - 1), lambda i: F.struct(i.alias("i"), hashed(1, "parts").alias("j"), F.lit(False).alias("asks")))
    asks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(hashed(2, "strays").alias("i"), j.alias("j"), F.lit(True).alias("asks")))
    cells = placed.withColumn("at", F.explode(F.when(F.col("stray"), F.concat(right, asks)).otherwise(right)))
    bitmaps = drawn.where("key is null").select(F.col("id").alias("_id"), "size", "bits")
    cells = cells.select("key", "at.i", "at.j", "at.asks", "stray", "id", "label", "prev").join(bitmaps, F.col("id") == F.col("_id")).drop("_id")

    @tidy
    def compare(batches):
        held, held_at = [], None
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            held.sort(key=lambda r: r[5])
            asks = np.array([r[0] for r in held])
            if not asks.any():
                return
            first = np.array([r[4] is None for r in held])  # nothing comes before the key
            ids, label, prev, size = (np.array([r[k] or 0 for r in held], np.int64) for k in (2, 3, 4, 5))
            stray = np.array([r[1] for r in held])
            bits = np.frombuffer(b"".join(r[6] for r in held), np.uint64).reshape(len(held), -1)
            to = np.flatnonzero(~asks)
            to_ids, to_label, to_prev, to_first, to_stray, to_size, to_bits = (x[to] for x in (ids, label, prev, first, stray, size, bits))
            low = np.searchsorted(to_size * den, size * num, side="left")
            high = np.searchsorted(to_size * num, size * den, side="right")
            for i in np.flatnonzero(asks & (low < high)).tolist():
                at = slice(low[i], high[i])
                meet = (to_label[at] != label[i]) & (~to_stray[at] | (to_ids[at] > ids[i]))
                if not first[i]:
                    meet &= to_first[at] | (to_prev[at] != prev[i])
                j = low[i] + np.flatnonzero(meet)
                if len(j):
                    differ = np.bitwise_count(to_bits[j] ^ bits[i]).sum(1, dtype=np.int64)
                    j = j[differ * (num + den) <= (to_size[j] + size[i]) * (den - num)]
                    found.append((to_ids[j], np.full(len(j), ids[i])))

        def rows():
            a, b = forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j) != held_at:
                    if len(held) > 1:
                        flush()
                        if sum(len(x) for x, _ in found) > _EDGES:
                            yield rows()
                    held, held_at = [], (key, i, j)
                held.append(row)
        if len(held) > 1:
            flush()
        if found:
            yield rows()

    near = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a long, b long")
    groups = components(saved(near, "allowed"))
    groups = saved(groups.join(left, F.col("id") == F.col("_id")).select("id", "component_id", "w", "label"), "groups")
    many = groups.groupBy(F.col("component_id").alias("_c")).agg(F.count("*").alias("n"), F.sum("w").alias("shingles"))
    many = saved(many.select("_c", "n", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("shingles") / block_shingles)).cast("int").alias("parts")), "candidates")
    placed = join_hot(groups, "component_id", many, "_c", "n").withColumn("side", hashed(3, "parts"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("id", F.col("component_id").alias("c"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "label")
    return saved(_search(_sets(base, saved(placed, "placed"), n), num, den), "links")
