"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.scratch import Scratch

#: Edges that a task joins to stars at once before the distributed steps.
PIECE = 500_000
#: Steps after which it gives up with an error; the labels' depth falls exponentially with the steps.
MOST = 100


def _distinct(df: DataFrame) -> DataFrame:
    return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _local_stars(edges: DataFrame) -> DataFrame:
    """The same components with each piece of a task's edges joined to stars: fewer edges and shorter ways."""

    def stars(parent: dict[int, int]) -> pa.RecordBatch:
        found = [(x, y) for x in parent if (y := root(parent, x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["u", "v"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        for b in it:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = root(parent, u), root(parent, v)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > PIECE:
                yield stars(parent)
                parent = {}
        yield stars(parent)

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(run, "u long, v long")


def root(parent: dict[int, int], x: int) -> int:
    """The least node that x is known to reach; ways are halved as they are walked."""
    while (y := parent.setdefault(x, x)) != x:
        parent[x] = x = parent.setdefault(y, y)
    return x


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour, or greater ones only: then no step would change an edge."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n")).where("up > 1 or (up = 1 and n > 1)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its greater neighbours to the least of its neighbours and itself.

    The least neighbour comes from a sum per node and task; only edges are joined to it, and a
    node with very many neighbours is dealt to many tasks by the skewed join.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _distinct(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    own = low.select("u", F.col("m").alias("v"))
    return _distinct(edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own))


def components(edges: DataFrame, cuts: Scratch, name: str = "stars") -> DataFrame:
    """(node, component) for each node of an edge: component is the least node that it reaches.

    edges: two integer columns u, v, never null. Loops, doubles and both directions are allowed; a
    node with loops only is no node of the result.
    """
    now = cuts.cut(_distinct(_local_stars(edges.select("u", "v"))), name)
    for _ in range(MOST):
        if _are_stars(now):
            break
        now = cuts.cut(_small_star(_large_star(_local_stars(now))), name)
    else:
        raise RuntimeError("components did not converge")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
