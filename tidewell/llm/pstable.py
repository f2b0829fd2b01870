"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised; each of ``L`` tables concatenates ``K`` quantised Gaussian projections floor((a.v + b) / w).
Vectors that share a bucket in some table are compared exactly; a pair is counted in the first table they share only.
No pairs leave a task: it returns link counts and each vector's smallest linked relative.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import finite_vector, matrix, mix64, saved
from tidewell.llm.components import components


def collision(distance: float, width: float) -> float:
    """Probability that one quantised projection agrees for two points at a distance (Datar et al.)."""
    c = width / distance
    normal = 0.5 * (1 + math.erf(-c / math.sqrt(2)))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def tables(n: int, cosine: float, width: float = 1.0, recall: float = 0.95, crowd: int = 128) -> tuple[int, int]:
    """(K, L): unrelated (orthogonal) vectors leave about ``crowd`` to a bucket; a pair just at the threshold is found with probability ``recall``."""
    far, near = collision(math.sqrt(2), width), collision(math.sqrt(max(1e-6, 2 - 2 * cosine)), width)
    k = max(1, math.ceil(math.log(max(2.0, n / crowd)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def bucket_keys(v: np.ndarray, k: int, n_tables: int, width: float, seed: int) -> np.ndarray:
    """(rows, tables) 64-bit bucket keys of normalised rows."""
    rng = np.random.default_rng([seed, v.shape[1]])
    a, b = rng.normal(size=(v.shape[1], n_tables * k)), rng.random(n_tables * k) * width
    q = np.floor((v @ a + b) / width).astype(np.int64).reshape(len(v), n_tables, k)
    out = np.broadcast_to(np.arange(n_tables, dtype=np.uint64) * np.uint64(1000003) + np.uint64(v.shape[1]), (len(v), n_tables)).copy()
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix64(out * np.uint64(31) + q[:, :, i].astype(np.uint64))
    return out.view(np.int64)


def link_block(ids, mult, side, v, table, cross, cosine, keys_of):
    """Links within one bucket: (id, links, smallest id of its relatives here) of rows that have any.

    ``cross``: the bucket is a cell of a split one, and only rows of different ``side`` are compared.
    """
    n = len(ids)
    links, label, seen = np.zeros(n, np.int64), np.argsort(np.argsort(ids, kind="stable"), kind="stable"), np.zeros(n, bool)
    keys = None
    for at in range(0, n, 256):
        rows = np.arange(at, min(n, at + 256))
        hit = v[rows] @ v[at:].T >= cosine
        hit &= np.arange(at, n)[None, :] > rows[:, None]
        if cross:
            hit &= side[rows][:, None] != side[at:][None, :]
        i, j = np.nonzero(hit)
        if not len(i):
            continue
        i, j = rows[i], j + at
        if keys is None:
            keys = keys_of(v)[:, :table]
        new = np.ones(len(i), bool)
        for t in range(table):
            new &= keys[i, t] != keys[j, t]
        np.add.at(links, i[new], mult[j[new]])
        np.add.at(links, j[new], mult[i[new]])
        seen[i] = seen[j] = True
        for r in np.unique(i):  # labels joined row by row
            group = np.unique(label[np.append(j[i == r], r)])
            if len(group) > 1:
                label[np.isin(label, group)] = group[0]
    order = np.sort(ids, kind="stable")
    own = np.flatnonzero(seen)
    return ids[own], links[own], order[label[own]]


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, width: float = 1.0, recall: float = 0.95, block: int = 4096, seed: int = 1) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id long, embedding array).

    Links are pairs with cosine >= ``cosine`` in double precision; none below it is ever reported, and at the threshold
    itself a link is found with probability ``recall`` (nearer pairs with more, equal vectors always).  Vectors that are
    null, all zero, empty, or hold null, NaN or infinite components link with nothing (n_links 0, a component of their
    own); vectors of different lengths do not link.  Rows with a null vec_id are returned with n_links 0 and null
    component_id and kept.  Equal vectors are one vector in the search; repeated rows are vectors each for itself and link
    with each other.  An empty table gives no rows; other columns are ignored.

    Buckets of over ``block`` rows are split into pairs of blocks, one task's memory each, so no bucket is capped.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    usable = F.col("vec_id").isNotNull() & finite_vector(F.col("e")) & F.exists("e", lambda x: x != 0)
    # -0.0 and 0.0 are one value
    rows = rows.withColumn("e", F.when(usable, F.transform("e", lambda x: x + F.lit(0.0)))).withColumn("h", F.xxhash64("e"))
    distinct = saved(rows.where("e is not null").groupBy("h", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")), "vectors")
    k, n_tables = tables(distinct.count(), cosine, width, recall)

    def normalised(e: pa.Array) -> np.ndarray:
        v = matrix(e)
        v = v / np.abs(v).max(1, keepdims=True)
        return v / np.sqrt((v * v).sum(1, keepdims=True))

    def hashed(batches):
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for d in np.unique(dims):
                for some in np.array_split(np.flatnonzero(dims == d), max(1, len(dims) // 2048)):
                    if len(some):
                        part = batch.take(pa.array(some))
                        keys = bucket_keys(normalised(part.column(2)), k, n_tables, width, seed)
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(list(keys), pa.list_(pa.int64()))], ["rep", "mult", "e", "keys"])

    keyed = distinct.select("rep", "mult", "e", F.size("e").alias("dim")).mapInArrow(hashed, "rep long, mult long, e array<double>, keys array<long>")
    placed = keyed.select("rep", "mult", "e", F.posexplode("keys").alias("t", "key"))
    crowded = placed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    crowded = crowded.select(F.col("t").alias("_t"), F.col("key").alias("_key"), F.ceil(F.col("n") / block).cast("int").alias("parts"))
    cells = placed.join(crowded, (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_key")))  # buckets of one vector go
    cells = cells.withColumn("side", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("t", "key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep", "mult", F.transform("e", lambda x: x.cast("double")).alias("e"))

    def links(batches):
        """Rows come sorted by cell; a cell may go on in the next batch."""
        held: list[pa.RecordBatch] = []
        key_of = lambda b, r: tuple(b.column(c)[r].as_py() for c in range(4))

        def cell(parts):
            b = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            if len(b) < 2:
                return None
            col = lambda c: b.column(c).to_numpy(zero_copy_only=False)
            v = normalised(b.column(7))
            found = link_block(col(5), col(6), col(4), v, int(col(0)[0]), bool(col(2)[0] != col(3)[0]), cosine, lambda x: bucket_keys(x, k, n_tables, width, seed))
            return found if len(found[0]) else None

        def out(found):
            ids, n, low = (np.concatenate(x) for x in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(low, pa.int64())], ["id", "links", "low"])

        found = []
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            bounds = [0, *change.tolist(), len(batch)]
            for a, b in zip(bounds, bounds[1:]):
                piece = batch.slice(a, b - a)
                if held and key_of(held[-1], 0) != key_of(piece, 0):
                    if (f := cell(held)) is not None:
                        found.append(f)
                    held = []
                held.append(piece)
            if sum(len(f[0]) for f in found) > 10_000:
                yield out(found)
                found = []
        if held and (f := cell(held)) is not None:
            found.append(f)
        if found:
            yield out(found)

    sorted_cells = cells.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    linked = saved(sorted_cells.mapInArrow(links, "id long, links long, low long"), "links")
    comps = components(linked.select("id", "low"))
    totals = linked.groupBy("id").agg(F.sum("links").alias("links"))
    known = distinct.select("h", F.col("e").alias("_e"), "rep", "mult").join(totals, F.col("rep") == F.col("id"), "left").drop("id")
    known = known.join(comps, F.col("rep") == F.col("id"), "left").select(F.col("h").alias("_h"), "_e", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component_id", "rep").alias("c"))
    out = rows.join(known, (F.col("h") == F.col("_h")) & (F.col("e") == F.col("_e")), "left")
    comp = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), comp).alias("component_id"), (F.col("vec_id") == comp).alias("kept"))
