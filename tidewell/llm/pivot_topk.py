"""Exact top-k inner-product search by pivot-table elimination.

Largest inner product is turned into a metric bound:  2<q,x> = |q|^2 + |x|^2 - d(q,x)^2,  and for every pivot p the
triangle inequality gives d(q,x) >= |d(q,p) - d(x,p)|.  The largest of these lower bounds over many pivots bounds the
score from above; candidates are evaluated in order of that bound until no bound reaches the k-th score found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import finite_vector, matrix

_PART = pa.schema([("qrow", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_EXACT = 2.0**53
_LONG = (-(2**63), 2**63 - 1)


def choose_pivots(sample: np.ndarray, n_pivots: int) -> np.ndarray:
    """Farthest-first pivots of a sample, starting at the row of the largest norm."""
    if not len(sample):
        return sample
    at = int(np.argmax((sample**2).sum(1)))
    chosen, far = [], np.full(len(sample), np.inf)
    for _ in range(min(n_pivots, len(sample))):
        chosen.append(at)
        far = np.minimum(far, ((sample - sample[at]) ** 2).sum(1))
        at = int(np.argmax(far))
    return sample[chosen]


def search_tile(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, k: int, chunk: int = 256):
    """The k best rows of one tile for each query: lists of (query position, vec_id, score).  Integer-valued arrays."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    top = max(1, x.shape[1]) * (np.abs(x).max(initial=0.0) + 1) * (np.abs(q).max(initial=0.0) + 1)
    exact = top < _EXACT
    xn, qn = (x**2).sum(1), (q**2).sum(1)
    if len(pivots) and exact:
        dist = lambda a: np.sqrt(((a[:, None, :] - pivots[None]) ** 2).sum(2))
        px, pq = dist(x), dist(q)
    wide = None if exact else x.astype(object)
    for j in range(len(q)):
        if not exact:  # integers beyond a double's 53 bits: exact Python integers, all rows
            found = wide.dot(q[j].astype(object)) if len(x) else np.zeros(0, object)
            keep = np.flatnonzero(ids != query_ids[j])
            best = sorted(((-int(found[i]), i) for i in keep))[:k]
            yield from ((j, int(ids[i]), min(max(-s, _LONG[0]), _LONG[1])) for s, i in best)
            continue
        if len(pivots):
            low = np.abs(px - pq[j]).max(1)
            bound = (qn[j] + xn - low * low) / 2
            bound += 1e-9 * (np.abs(bound) + qn[j] + xn) + 0.5  # rounding of roots and squares
        else:
            bound = np.full(len(x), np.inf)
        bound[ids == query_ids[j]] = -np.inf
        by_bound = np.argsort(-bound, kind="stable")
        n = int((bound > -np.inf).sum())
        best_score, best_row, kth, at = np.zeros(0), np.zeros(0, np.int64), -np.inf, 0
        while at < n and bound[by_bound[at]] >= kth:  # equal bounds too: a tie goes to the smaller vec_id
            rows = by_bound[at : min(at + chunk, n)]
            best_score = np.concatenate([best_score, x[rows] @ q[j]])
            best_row = np.concatenate([best_row, rows])
            keep = np.lexsort((best_row, -best_score))[:k]  # rows are in order of vec_id
            best_score, best_row = best_score[keep], best_row[keep]
            if len(keep) == k:
                kth = best_score[-1]
            at += chunk
        yield from ((j, int(ids[i]), int(s)) for s, i in zip(best_score, best_row))


def pivot_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, n_pivots: int = 16, tile_rows: int = 32768, query_rows: int = 4096, sample_rows: int = 2048) -> DataFrame:
    """Exact k largest integer inner products of ``queries`` against ``vectors`` (both: vec_id long, embedding array).

    Components become floor(scale * x) with x as a double.  Rows whose vec_id is null, and vectors that are
    null or hold null, NaN or infinite components, take no part; only vectors of equal length are compared (an empty array has length 0, score 0).  A row
    with the query's own vec_id is no candidate.  Ties go to the smaller vec_id; with fewer than k candidates all are
    returned; empty inputs give no rows.  Repeated rows are candidates (and queries) each for itself.  Scores outside
    a long are cut to its ends.  Other columns are ignored.

    Tiles of about ``tile_rows`` rows meet blocks of about ``query_rows`` queries, one task's memory each; only k rows
    of a query leave a tile.  ``sample_rows`` bounds the rows from which the pivots are picked (any pivots are exact).

    Returns query_id, rank (int, from 1), vec_id, score.
    """
    def usable(df: DataFrame) -> DataFrame:
        ready = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        ready = ready.where(F.col("vec_id").isNotNull() & finite_vector(F.col("embedding")))
        return ready.select("vec_id", F.size("embedding").alias("dim"), F.transform("embedding", lambda v: _floor(v, scale)).alias("v"))

    cands, asked = usable(vectors), usable(queries)
    sample = cands.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample_rows).toArrow()
    by_dim = {}
    for n in set(sample["dim"].to_pylist()):
        rows = sample.filter(pa.compute.equal(sample["dim"], n))
        by_dim[n] = choose_pivots(matrix(rows["v"]), n_pivots)
    n = vectors.count()
    tiles = max(1, -(-n // tile_rows), min(12, -(-n // 2048)))  # small inputs still keep several cores busy
    blocks = max(1, -(-asked.count() // query_rows))
    left = cands.withColumn("g", F.pmod(F.monotonically_increasing_id(), F.lit(tiles))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("qrow", F.monotonically_increasing_id()).withColumn("b", F.pmod(F.col("qrow"), F.lit(blocks)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if len(a) and len(b):
            ids, qrow, qid = a["vec_id"].to_numpy(), b["qrow"].to_numpy(), b["vec_id"].to_numpy()
            pivots = by_dim.get(a["dim"][0].as_py(), np.zeros((0, 0)))
            out = [(int(qrow[j]), int(qid[j]), i, s) for j, i, s in search_tile(ids, matrix(a["v"]), qid, matrix(b["v"]), pivots, k)]
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out) if out else [[]] * 4, _PART)], schema=_PART)

    part = left.groupBy("dim", "g", "b").cogroup(right.groupBy("dim", "g", "b")).applyInArrow(tile, "qrow long, query_id long, vec_id long, score long")
    best = Window.partitionBy("qrow").orderBy(F.col("score").desc(), "vec_id")
    return part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _floor(v, scale: int):
    """floor(scale * v) that stays a double (a long would wrap for huge components)."""
    x = v * F.lit(float(scale))
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
