"""Connected components of a graph of edges."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.scratch import Scratch

#: Edges up to which one task labels the graph; beyond it, rounds of joins do.
ONE_TASK, MOST_ROUNDS = 500_000, 200
#: Edges that a task thins at once, nodes that it holds, and thinned edges that one task thins again.
BLOCK, HELD, SECOND = 500_000, 2_000_000, 8_000_000


def label(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, least id of the component of each), by hooking to the least neighbour and pointer jumping."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(ids))
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, low[a], m)
        np.minimum.at(new, low[b], m)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, low):
            return ids, ids[low]
        low = new


def thin(edges: DataFrame) -> DataFrame:
    """(u, v): edges with the same components, of each task at most one a node (or of HELD nodes, one after the other)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, held, n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for b in chain(it, [None]):
            if b is not None:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
                n += b.num_rows
            if n >= max(BLOCK, len(u)) or b is None and n:
                u, v = label(*(np.concatenate([x, *[h[i] for h in held]]) for i, x in enumerate((u, v))))
                held, n = [], 0
            if len(u) > HELD or b is None:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                u, v = u[:0], v[:0]

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, nodes: DataFrame | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): component is the least node reachable.

    edges: (u, v) long, any direction, loops and doubles allowed. nodes: (node) that are to be
    listed besides the edges' ends. The edges are thinned and written first, so that what made them runs once
    and on all tasks. Small graphs, by count, are labelled in one task; others by rounds of
    least-neighbour labels and pointer jumping, each written and read again, with the same result.
    """
    cuts = Scratch(edges.sparkSession, "components")
    edges = cuts.cut(thin(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))), "edges")
    if one_task < edges.limit(SECOND + 1).count() <= SECOND:
        edges = cuts.cut(thin(edges.coalesce(1)), "thinned")
    if edges.limit(one_task + 1).count() <= one_task:

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = list(it)
            if parts:
                all_ = pd.concat(parts)
                ids, low = label(all_.u.to_numpy(np.int64), all_.v.to_numpy(np.int64))
                yield pd.DataFrame({"node": ids, "component": low})

        out = edges.repartition(1).mapInPandas(run, "node long, component long")
    else:
        out = _by_rounds(edges)
    if nodes is None:
        return out
    return nodes.select(F.col("node").cast("long").alias("node")).distinct().join(out, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _by_rounds(edges: DataFrame) -> DataFrame:
    cuts = Scratch(edges.sparkSession, "components")
    both = cuts.cut(edges.where("u <> v").union(edges.where("u <> v").select("v", "u")).toDF("u", "v").distinct(), "both")
    labels = cuts.cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")), "labels")
    for _ in range(MOST_ROUNDS):
        near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("l").alias("m"))
        hooked = labels.join(near, "u").select("u", "l", F.least("l", "m").alias("m"))
        jumped = hooked.join(labels.select(F.col("u").alias("m"), F.col("l").alias("j")), "m", "left").select("u", "l", F.least("m", F.coalesce("j", "m")).alias("m"))
        done = cuts.cut(jumped, "jumped")
        changed = not done.where("l <> m").isEmpty()
        labels = cuts.cut(done.select("u", F.col("m").alias("l")), "labels")
        if not changed:
            loops = edges.where("u = v").select("u", F.col("u").alias("l")).join(labels, "u", "left_anti").distinct()
            return labels.union(loops).toDF("node", "component")
    raise RuntimeError("components did not converge")


def sizes(labels: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(component, n, size): members, and the sum of (node, size) weights."""
    df = labels if weights is None else labels.join(weights, "node", "left")
    total = F.lit(None).cast("double") if weights is None else F.sum(F.coalesce("size", F.lit(0.0)))
    return df.groupBy("component").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)).cast("double") if weights is None else total).alias("size"))
