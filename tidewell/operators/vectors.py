"""Vector search: distances, exact top-k, and an inverted-file index whose lists are Parquet partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "l2")


def _doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(inner(a, a))


def distance(a: Column, b: Column, metric: str) -> Column:
    """cosine: 1 - cos (1 if a norm is 0); dot: the negative product; l2: the squared distance."""
    if metric == "cosine":
        scale = norm(a) * norm(b)
        return F.when(scale == 0, F.lit(1.0)).otherwise(1 - inner(a, b) / scale)
    if metric == "dot":
        return -inner(a, b)
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    raise ValueError(f"metric must be one of {METRICS}")


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def usable(c: Column, dim: int) -> Column:
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) == dim) & ~bad, F.lit(False))


def top_k(df: DataFrame, query: list[float], k: int, metric: str = "cosine", id: str = "row_id", column: str = "embedding", where: Column | None = None) -> DataFrame:  # noqa: A002
    """The k nearest rows (id, distance), ties to the smaller id; the filter runs before any distance."""
    if not query or not all(math.isfinite(x) for x in query):
        raise ValueError("the query must hold finite numbers")
    if where is not None:
        df = df.where(where)
    df = df.where(usable(F.col(column), len(query)))
    return df.select(id, distance(F.col(column), literal(query), metric).alias("distance")).orderBy("distance", id).limit(k)


def rerank(df: DataFrame, candidates: DataFrame, query: list[float], k: int, metric: str = "cosine", id: str = "row_id", column: str = "embedding") -> DataFrame:  # noqa: A002
    """Exact top-k within a table of candidate ids."""
    return top_k(df.join(candidates.select(id).distinct(), id, "left_semi"), query, k, metric, id, column)


def check_dimension(df: DataFrame, column: str = "embedding") -> int:
    """The one length of all vectors; several are an error."""
    sizes = df.where(F.col(column).isNotNull()).agg(F.min(F.size(column)).alias("a"), F.max(F.size(column)).alias("b")).first()
    if sizes.a != sizes.b:
        raise ValueError(f"vectors of {sizes.a} to {sizes.b} numbers")
    return sizes.a or 0


class Ivf:
    """Lists of near vectors around centroids: a table with list_id, and the centroids (a few hundred, held by the driver).

    As the number of lists is bounded by 512 whatever the input, broadcasting centroids is safe.
    """

    def __init__(self, rows: DataFrame, centroids: list[list[float]], metric: str, id: str, column: str, spread: float):  # noqa: A002
        self.rows, self.centroids, self.metric, self.id, self.column, self.spread = rows, centroids, metric, id, column, spread

    @staticmethod
    def _nearest(c: Column, centroids: list[list[float]]) -> Column:
        pairs = [F.struct(distance(c, literal(v), "l2").alias("d"), F.lit(i).alias("i")) for i, v in enumerate(centroids)]
        return F.array_min(F.array(*pairs))

    @classmethod
    def build(cls, df: DataFrame, metric: str = "cosine", id: str = "row_id", column: str = "embedding", lists: int | None = None, sample: int = 8192, rounds: int = 4) -> Ivf:  # noqa: A002
        """Lloyd rounds on at most ``sample`` rows (those of smallest hashed id), then one pass that assigns every row."""
        import numpy as np

        df = df.where(usable(F.col(column), check_dimension(df, column)))
        n = df.count()
        lists = min(max(1, n), lists or min(512, max(32, int(math.sqrt(n) / 2))))
        x = np.array([r[0] for r in df.orderBy(F.xxhash64(id), id).select(column).limit(sample).collect()], np.float64)
        if metric == "cosine":
            x = x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))
        centres = x[np.linspace(0, len(x) - 1, lists).astype(int)]
        for _ in range(rounds):
            near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.stack([x[near == i].mean(0) if (near == i).any() else centres[i] for i in range(len(centres))])
        centroids = centres.tolist()

        def assign(batches):
            import pandas as pd

            for pdf in batches:
                v = np.stack(pdf[column].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, centres.shape[1]))
                if metric == "cosine":
                    v = v / np.maximum(1e-12, np.linalg.norm(v, axis=1, keepdims=True))
                d = (v**2).sum(1)[:, None] - 2 * v @ centres.T + (centres**2).sum(1)[None]
                yield pd.concat([pdf, pd.DataFrame({"list_id": d.argmin(1).astype("int32"), "spread": np.maximum(0, d.min(1)) if len(d) else []}, index=pdf.index)], axis=1)

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        rows = df.mapInPandas(assign, f"{fields}, list_id int, spread double")
        return cls(rows, centroids, metric, id, column, 0.0)

    def save(self, path: str) -> Ivf:
        """Rows partitioned by list, so that a search reads only the lists it probes, and bounds for each list."""
        self.rows.write.partitionBy("list_id").mode("overwrite").parquet(f"{path}/rows")
        spark = self.rows.sparkSession
        spark.createDataFrame([(i, c) for i, c in enumerate(self.centroids)], "list_id int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
        return self.load(spark, path, self.metric, self.id, self.column)

    @classmethod
    def load(cls, spark, path: str, metric: str, id: str = "row_id", column: str = "embedding") -> Ivf:  # noqa: A002
        rows = spark.read.parquet(f"{path}/rows")
        centroids = [r.centroid for r in spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()]
        return cls(rows, centroids, metric, id, column, rows.agg(F.avg("spread")).first()[0] or 0.0)

    def bounds(self, columns: list[str]) -> DataFrame:
        """Smallest and largest value of numeric columns in each list, for pruning by a filter."""
        return self.rows.groupBy("list_id").agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])

    def probe(self, query: list[float], probes: int | None = None) -> list[int]:
        """The nearest lists: by default max(4, sqrt(lists))."""
        import numpy as np

        q, c = np.array(query, np.float64), np.array(self.centroids)
        if self.metric == "cosine":
            q = q / max(1e-12, float(np.linalg.norm(q)))
        order = np.argsort(((c - q) ** 2).sum(1), kind="stable")
        return order[: probes or max(4, math.isqrt(len(c)))].tolist()

    def search(self, query: list[float], k: int, probes: int | None = None, where: Column | None = None, extra: DataFrame | None = None) -> DataFrame:
        """Exact distances within the probed lists (and rows not yet indexed); loose lists fall back to a full exact search."""
        loose = probes is None and self.metric == "cosine" and self.spread / 2 > 0.35
        rows = self.rows if loose else self.rows.where(F.col("list_id").isin(*self.probe(query, probes)))
        rows = rows.drop("list_id", "spread")
        if extra is not None:
            rows = rows.unionByName(extra.select(*rows.columns))
        return top_k(rows, query, k, self.metric, self.id, self.column, where)


#: Rows and queries of a scope that meet in one task.
TILE_ROWS, TILE_QUERIES = 8192, 2048


def _scores(q, v, metric: str, exact: bool = False):
    """Negative distances of matrices' rows: of all pairs (by products of matrices), or of q[i] and v[i], added up in order as ``distance`` does."""
    import numpy as np

    def added(x):
        out = np.zeros(len(x))
        for d in range(x.shape[1]):
            out += x[:, d]
        return out

    if exact:
        if metric == "cosine":
            scale = np.sqrt(added(q * q)) * np.sqrt(added(v * v))
            return -np.where(scale == 0, 1.0, 1 - added(q * v) / np.where(scale == 0, 1.0, scale))
        return added(q * v) if metric == "dot" else -added((q - v) ** 2)
    if metric == "cosine":
        unit = [x / np.where((n := np.sqrt((x * x).sum(1, keepdims=True))) == 0, 1.0, n) for x in (q, v)]
        return unit[0] @ unit[1].T - 1
    return q @ v.T if metric == "dot" else 2 * q @ v.T - (q * q).sum(1)[:, None] - (v * v).sum(1)[None]


def _best(k: int, metric: str):
    """A function of a tile's rows (id, v) and queries (id, v) that gives (query_id, id, score) with the k best ids of each query, and what may tie."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        np.seterr(all="ignore")
        empty = pa.table({"query_id": asked["id"].slice(0, 0), "id": rows["id"].slice(0, 0), "score": pa.array([], pa.float64())})
        if not len(rows) or not len(asked):
            return empty
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")], null_placement="at_start"))
        q, v = (t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1) for t in (asked, rows))
        names = rows["id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        # of equal vectors only the k smallest ids can be among the best
        same = np.unique(v.view(f"V{v.shape[1] * 8}")[:, 0], return_inverse=True)[1] if v.shape[1] else np.zeros(len(v), np.int64)
        order = np.lexsort((names, same))
        new = np.ones(len(order), bool)
        new[1:] = (same[order][1:] != same[order][:-1]) | (names[order][1:] != names[order][:-1])
        order = order[new]
        first = np.flatnonzero(np.r_[True, same[order][1:] != same[order][:-1]])
        within = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        left = np.sort(order[within < k])
        v, names = v[left], names[left]
        starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        # rounding of sums in another order stays far below this share of the largest product
        slack = 1e-9 * (1.0 if metric == "cosine" else (np.sqrt((q * q).sum(1)) + np.sqrt((v * v).sum(1)).max())[:, None] ** 2)
        out = []
        for a in range(0, len(q), 128):
            near = _scores(q[a : a + 128], v, metric)
            near[np.isnan(near)] = np.inf  # NaN is the largest
            ids = near if len(starts) == len(v) else np.maximum.reduceat(near, starts, axis=1)
            if ids.shape[1] > k:
                least = np.partition(ids, ids.shape[1] - k, axis=1)[:, -k][:, None]
                keep = ~(near < least - (slack if metric == "cosine" else slack[a : a + 128]))
            else:
                keep = np.ones(near.shape, bool)
            i, j = np.nonzero(keep)
            out.append((i + a, j, _scores(q[i + a], v[j], metric, exact=True)))
        i, j, score = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query_id": asked["id"].take(pa.array(i)), "id": rows["id"].take(pa.array(left[j])), "score": pa.array(score)})

    return run


def scoped_search(df: DataFrame, queries: DataFrame, k: int, scope: str = "scope", id: str = "chunk", column: str = "embedding", metric: str = "cosine") -> DataFrame:  # noqa: A002
    """(query_id, id, score): each query's scopes searched, the best score of a chunk kept, k chunks a query.

    ``queries``: query_id, query (vector), scopes (array).  Rows and queries of a scope meet in tiles of bounded size, whose
    best pairs are scored as ``distance`` does.  Vectors that are null, hold nulls or have another size than most join as rows.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    asked = queries.select("query_id", "query", F.explode("scopes").alias("_scope")).where("_scope is not null")
    rows = df.where(F.col(scope).isNotNull()).select(F.col(scope).alias("_scope"), F.col(id).alias("id"), F.col(column).alias("v"))
    asked = asked.select(F.col("_scope").cast(rows.schema["_scope"].dataType), F.col("query_id").alias("id"), F.col("query").alias("v"))
    whole = F.coalesce(F.when(~F.exists("v", lambda x: x.isNull()), F.size("v")), F.lit(-1))
    sizes = [{r.n: r.rows for r in t.groupBy(whole.alias("n")).agg(F.count("*").alias("rows")).collect()} for t in (rows, asked)]
    dim = max((n for n in sizes[0] if n > 0), key=sizes[0].get, default=0)
    fits = whole == dim
    # blocks of the scopes that need more than one: a thousandth of the rows' number at most
    count = rows.groupBy("_scope").agg(F.count("*").alias("r"), F.lit(0).cast("long").alias("q")).union(asked.groupBy("_scope").agg(F.lit(0).cast("long"), F.count("*")))
    large = count.groupBy("_scope").agg(F.ceil(F.max("r") / TILE_ROWS).cast("int").alias("_r"), F.ceil(F.max("q") / TILE_QUERIES).cast("int").alias("_q")).where("_r > 1 or _q > 1")

    def dealt(t: DataFrame, own: str, other: str) -> DataFrame:
        n = {c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) for c in (own, other)}
        blocks = t.where(fits).join(F.broadcast(large), "_scope", "left")
        return blocks.select("_scope", "id", "v", F.pmod(F.xxhash64("id"), n[own]).cast("int").alias(own), F.explode(F.sequence(F.lit(0), n[other] - 1)).alias(other))

    kinds = f"query_id {asked.schema['id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
    tile = ["_scope", "_r", "_q"]
    run = _best(k, metric)
    scored = dealt(rows, "_r", "_q").groupBy(*tile).cogroup(dealt(asked, "_q", "_r").groupBy(*tile)).applyInArrow(lambda a, b: run(a.select(["id", "v"]), b.select(["id", "v"])), kinds)

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.alias("a").join(b.alias("b"), F.col("a._scope") == F.col("b._scope"))
        return both.select(F.col("b.id").alias("query_id"), F.col("a.id").alias("id"), (-distance(F.col("a.v"), F.col("b.v"), metric)).alias("score"))

    if set(sizes[0]) - {dim}:
        scored = scored.unionByName(joined(rows.where(~fits), asked))
    if set(sizes[1]) - {dim}:
        scored = scored.unionByName(joined(rows.where(fits), asked.where(~fits)))
    best = scored.groupBy("query_id", F.col("id").alias(id)).agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), id)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
