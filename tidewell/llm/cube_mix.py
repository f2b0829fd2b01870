"""Mixing sources to target weights by cube-method balanced sampling.

A document of a source with target t and size s is taken floor(t/s) times for certain and once more with probability
frac(t/s).  The flight phase of the cube method (Deville and Tille, fast form) moves these probabilities along vectors
of the null space of the balancing constraints - number of words and number of documents - so both totals stay exact
until fewer documents than needed are undecided; only those are rounded in the landing phase.

Groups of documents fly independently; what stays undecided in them (two documents at most) flies again, together with
that of other groups of the source, so a source of any size is dealt over many tasks and ends in one small landing.
"""

from __future__ import annotations

import itertools
import random

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import saved

WORD = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets by source from (source, size): weights repeat over sources in code-point order, null last.

    The targets sum to ``share`` times all sizes; none exceeds ``cap`` times its source's size, the excess is shared
    again by weight.  That fixed point is min(cap * size, level * weight) for one common level: with sources in order
    of cap * size / weight, source i is capped exactly if the level left by those before it would exceed its cap.
    One row for each source goes through the windows, so their single task reads no documents.
    Returns source, source_size long, target double.
    """
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    listed = per.withColumn("_i", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    listed = listed.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int")))
    listed = listed.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    ranked = everything.orderBy(F.col("_cap") / F.col("_w"), "_i")
    before, rest = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(float(share))
    listed = listed.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    listed = listed.withColumn("_capped", F.col("_level") * F.col("_w") >= F.col("_cap"))
    level = F.max(F.when(~F.col("_capped"), F.col("_level"))).over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return listed.select("source", "source_size", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.greatest(F.lit(0.0), level * F.col("_w"))).alias("target"))


def fly(probs: list[float], sizes: list[float], seed: str, land: bool) -> list[float]:
    """Flight of one group with constraints on count and size; with ``land``, what is left is rounded as well.

    Returns each document's probability after the flight: 0 or 1 but for two at most.
    """
    rng = random.Random(seed)
    p = list(probs)
    live: list[int] = []
    n = len(p)
    at = 0
    while True:
        live = [i for i in live if _EPS < p[i] < 1 - _EPS]
        while len(live) < 3 and at < n:
            if _EPS < p[at] < 1 - _EPS:
                live.append(at)
            else:
                p[at] = float(p[at] > 0.5)
            at += 1
        if len(live) < 3:
            break
        i, j, k = live
        # constraints: equal sums of u (documents) and of size * u (words); null vector of a 2 x 3 matrix
        a, b, c = sizes[i], sizes[j], sizes[k]
        u = (c - b, a - c, b - a)
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[x]) / d if d > 0 else p[x] / -d for x, d in zip(live, u) if d)
        down = min(p[x] / d if d > 0 else (1 - p[x]) / -d for x, d in zip(live, u) if d)
        step = up if rng.random() * (up + down) < down else -down
        for x, d in zip(live, u):
            v = p[x] + step * d
            p[x] = 0.0 if v < _EPS else 1.0 if v > 1 - _EPS else v
    if land and live:  # two at most: of all roundings, the one nearest to the totals, words first
        words, docs = sum(p[i] * sizes[i] for i in live), sum(p[i] for i in live)
        best = min(itertools.product((0.0, 1.0), repeat=len(live)), key=lambda t: (abs(sum(x * sizes[i] for x, i in zip(t, live)) - words), abs(sum(t) - docs), t))
        for i, x in zip(live, best):
            p[i] = x
    return p


_SCHEMA = "doc_id long, source string, size long, p double, salt long"


def _flight(group_size: int, seed: int, last: bool, level: int):
    def run(t: pa.Table) -> pa.Table:
        order = t.sort_by([("doc_id", "ascending"), ("size", "ascending"), ("salt", "ascending")])
        key = f"{seed}/{level}/{order['source'][0].as_py()}/{order['g'][0].as_py()}"
        p = fly(order["p"].to_pylist(), [float(s) for s in order["size"].to_pylist()], key, last)
        return pa.table([order["doc_id"], order["source"], order["size"], pa.array(p, pa.float64()), order["salt"]], names=["doc_id", "source", "size", "p", "salt"])

    return run


def cube_mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, group_size: int = 4096, seed: int = 11) -> DataFrame:
    """How many words of each document the mix takes: doc_id, size, source_size, target, taken, times.

    ``size`` counts runs of characters other than ASCII white space (null text: 0); ``target`` is the source's, see
    ``source_targets``; ``times`` is how often the document is taken and ``taken`` = times * size.  With ``cap`` c no
    document is taken more than ceil(c) times.  A null source is a source of its own (the last); documents of size 0
    are taken floor(target / size of source) times or once more like others; a source of size 0 is not taken.  Repeated
    rows are documents each for itself; an empty table gives no rows; other columns are ignored.  The draw depends on
    doc_id, source and size only (groups are dealt by a hash of the id), so reruns agree however rows are partitioned.
    """
    number = F.regexp_count(F.col("text").cast("string"), F.lit(WORD)).cast("long")
    sized = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(number, F.lit(0).cast("long")).alias("size")), "sizes")
    targets = saved(source_targets(sized, weights, share, cap), "targets")
    counts = sized.groupBy("source").agg(F.count("*").alias("n"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    per = targets.join(counts, same(targets, counts)).select(targets["source"].alias("s"), "source_size", "target", "n")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    # repeated rows get numbers, so that each keeps its own draw
    nth = Window.partitionBy("doc_id", "source", "size").orderBy(F.lit(0))
    rows = sized.join(per, sized["source"].eqNullSafe(per["s"])).withColumn("salt", F.row_number().over(nth).cast("long"))
    rows = rows.withColumn("_r", ratio).withColumn("base", F.floor("_r")).withColumn("p", F.col("_r") - F.col("base"))
    hashed = lambda level: F.xxhash64(F.lit(seed + 1000 * level), F.col("doc_id"), F.col("size"), F.col("salt"))
    groups = F.greatest(F.lit(1), F.ceil(F.col("n") / group_size))
    todo = rows.where(f"p > {_EPS} and p < {1 - _EPS}").select("doc_id", "source", "size", "p", "salt", "n", F.pmod(hashed(0), groups).alias("g"))
    most = counts.agg(F.max("n")).first()[0] or 0
    certain, level = None, 0
    while True:
        n_groups = max(1, -(-most // group_size))
        last = n_groups == 1
        flown = todo.groupBy("source", "g").applyInArrow(_flight(group_size, seed, last, level), _SCHEMA)
        flown = saved(flown, f"flight{level}")
        done = flown.where(f"p <= {_EPS} or p >= {1 - _EPS}")
        certain = done if certain is None else certain.unionByName(done)
        if last:
            break
        level, most = level + 1, 2 * n_groups
        open_rows = flown.where(f"p > {_EPS} and p < {1 - _EPS}")
        again = -(-most // group_size)
        todo = open_rows.withColumn("g", F.pmod(hashed(level), F.lit(max(1, again))))
    drawn = certain.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("salt").alias("_n"), F.round("p").cast("long").alias("once"))
    match = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("salt") == F.col("_n"))
    out = rows.join(drawn, match, "left").withColumn("times", F.col("base") + F.coalesce("once", F.when(F.col("p") > 0.5, 1).otherwise(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"), F.col("times").cast("int").alias("times"))
