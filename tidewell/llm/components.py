"""Connected components over edge tables, without collecting links anywhere.

Each task first contracts its edges to a spanning forest; a node's edges from all forests meet and are contracted again,
as long as that saves a quarter of them.  Up to _TASK edges are left to one task, which ends it.  Of more, labels flow over
the remaining edges and along labels (pointer jumping) until none changes.  Every round ends in a table in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import join_hot, saved, tidy

_CHUNK = 1 << 20
_TASK = 1 << 19  # edges of a task that contracts again, fewer than _CHUNK


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the given edges; components are unchanged."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        old = label
        low = np.minimum(label[i], label[j])
        label = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == old).all():
            break
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _contract(batches):
    held: list[np.ndarray] = []
    size = 0

    def flush():
        a, b = forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        return a, b

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        size += len(batch)
        if size >= _CHUNK:
            held = [flush()]
            size = len(held[0][0])
            if size >= _CHUNK // 2:
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0], pa.int64()), pa.array(held[0][1], pa.int64())], ["a", "b"])
                held, size = [], 0
    if held:
        a, b = flush()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) for every node of ``edges`` (two long columns): component_id is the smallest id reachable.

    Edges with a null end and loops are ignored; repeated edges do no harm; no edges give no rows.  Nodes with very many
    edges and labels of very many nodes are looked up by broadcast (see ``join_hot``), so no task gets all of one's rows.
    """
    x, y = edges.columns[:2]
    clean = edges.select(F.col(x).cast("long").alias("a"), F.col(y).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    small = saved(clean.mapInArrow(tidy(_contract), "a long, b long").distinct(), "forest")
    ends, before = small.count(), None
    while ends > _TASK and (before is None or 4 * ends < 3 * before):
        dealt = small.repartition(-(-ends // _TASK), "a")  # a forest has one edge for each of its nodes "a", so none is hot
        small = saved(dealt.mapInArrow(tidy(_contract), "a long, b long"), "forest")
        ends, before = small.count(), ends
    if ends <= _TASK:
        labels = saved(small.coalesce(1).mapInArrow(tidy(_contract), "a long, b long").select(F.col("a").alias("id"), F.col("b").alias("component_id")), "forest")
        return labels.union(labels.select("component_id", "component_id").distinct())
    both = small.union(small.select("b", "a"))
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("lab"), F.count("*").alias("n")), "labels")
    ends, nodes = 2 * ends, labels.count()
    while True:
        near = join_hot(both, "b", labels, "id", "n", ends).groupBy("a").agg(F.min("lab").alias("near"))
        met = saved(labels.join(near, F.col("id") == F.col("a")).select("id", "lab", F.least("lab", "near").alias("new"), "n"), "met")
        if not met.where("new <> lab").limit(1).count():  # no edge joins two labels
            return labels.select("id", F.col("lab").alias("component_id"))
        held = met.groupBy(F.col("new").alias("_new")).agg(F.count("*").alias("held"))
        target = held.join(met.select(F.col("id").alias("to"), F.col("new").alias("next")), F.col("_new") == F.col("to")).select("to", "next", "held")
        jumped = join_hot(met, "new", saved(target, "target"), "to", "held", nodes)
        labels = saved(jumped.select("id", F.least("new", "next").alias("lab"), "n"), "labels")
