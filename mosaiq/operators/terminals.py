"""Sample points on a mask and pairs of them, drawn by hashes: the same for any number of tasks and any size of mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.operators.grid import label_components

#: Points between whose pairs a draw is made; their pairs are listed.
MOST_POINTS = 2000


def stratified_points(mask: DataFrame, k: int) -> DataFrame:
    """(id, row, col): k cells of the mask (2 at least, or all), spread over its 8-connected components by size.

    The r-th cell of a component of n, in the order of a hash, has the turn (r - 1) / n, and the k
    cells of least turn are taken: each component has one at turn 0, the larger ones then more.
    ids count from 0 in the order of row and col.
    """
    k = max(2, min(k, MOST_POINTS))
    labelled = label_components(mask, 8)
    sizes = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    h = F.xxhash64("row", "col", F.lit("points"))
    ranked = labelled.withColumn("r", F.row_number().over(W.partitionBy("component").orderBy(h, "row", "col"))).where(F.col("r") <= k)
    some = ranked.join(sizes, "component").orderBy((F.col("r") - 1) / F.col("n"), h, "row", "col").limit(k)
    return some.select((F.row_number().over(W.orderBy("row", "col")) - 1).alias("id"), "row", "col")


def drawn_pairs(points: DataFrame, order: list[Column], target: int) -> DataFrame:
    """(i, j) with i < j: the `target` pairs first in an order of the columns i and j, of points (id) numbered from 0."""
    last = points.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("last"))
    pairs = last.where("last > 0").select(F.explode(F.sequence(F.lit(0), F.col("last") - 1)).alias("i"), "last")
    return pairs.select("i", F.explode(F.sequence(F.col("i") + 1, F.col("last"))).alias("j")).orderBy(*order).limit(max(1, target))


def terminal_pairs(mask: DataFrame, points: int = 50, pairs: int = 200, step: float = 1.0) -> DataFrame:
    """(i, r1, c1, j, r2, c2, euclid): pairs of stratified points, all of them if `pairs` allows."""
    p = stratified_points(mask, points)
    drawn = drawn_pairs(p, [F.xxhash64("i", "j", F.lit("pairs")), F.col("i"), F.col("j")], pairs)
    a = p.select(F.col("id").alias("i"), F.col("row").alias("r1"), F.col("col").alias("c1"))
    b = p.select(F.col("id").alias("j"), F.col("row").alias("r2"), F.col("col").alias("c2"))
    far = F.hypot(F.col("r1") - F.col("r2"), F.col("c1") - F.col("c2")) * step
    return drawn.join(a, "i").join(b, "j").select("i", "r1", "c1", "j", "r2", "c2", far.alias("euclid"))


def separated_pairs(points: DataFrame, target: int | None = None, pool: int = 4) -> DataFrame:
    """(u, v, distance) of points (id, x, y): pairs that lie far apart.

    All pairs if there is no target, or if it covers them. Else, of at most MOST_POINTS points, `target` of the `pool` times as many farthest are
    drawn without replacement, weighted by distance (at least 1e-9): those with the least
    -ln(h) / distance, h a hash of the pair between 0 and 1. Ties in distance go by the ids.
    """
    if target is None:
        one, two = (points.select(F.col("id").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k in "uv")
        return one.join(two, F.col("u") < F.col("v")).select("u", "v", F.hypot(F.col("xu") - F.col("xv"), F.col("yu") - F.col("yv")).alias("distance"))
    if points.limit(MOST_POINTS + 1).count() > MOST_POINTS:
        raise ValueError("sample the points first")
    p = points.select(F.col("id").alias("p"), "x", "y", (F.row_number().over(W.orderBy("id")) - 1).alias("id"))
    n = F.count(F.lit(1)).over(W.partitionBy())
    a, b = (p.select(F.col("id").alias(k), F.col("p").alias(q), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k, q in (("i", "u"), ("j", "v")))
    every = drawn_pairs(p, [F.col("i"), F.col("j")], MOST_POINTS**2).join(a, "i").join(b, "j")
    far = every.select("u", "v", F.hypot(F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj")).alias("distance"))
    near = W.orderBy(F.desc("distance"), "u", "v")
    ranked = far.withColumn("k", F.row_number().over(near)).withColumn("n", n).where(F.col("k") <= max(1, target) * pool)
    h = (F.pmod(F.xxhash64("u", "v", F.lit("draw")), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    drawn = F.row_number().over(W.orderBy(-F.ln(h) / F.greatest("distance", F.lit(1e-9)), "u", "v"))
    return ranked.withColumn("d", drawn).where((F.col("n") <= target) | (F.col("d") <= max(1, target))).select("u", "v", "distance")


def hashed_points(labelled: DataFrame, k: int) -> DataFrame:
    """(row, col, patch_id): of each patch the cells of least hash, in number by its share of all, at least one."""
    n = labelled.agg(F.count(F.lit(1)).alias("_t"))
    sizes = labelled.groupBy("patch_id").agg(F.count(F.lit(1)).alias("_n")).crossJoin(n).withColumn("_k", F.greatest(F.lit(1), F.floor(F.col("_n") / F.col("_t") * k)))  # one row
    rank = F.row_number().over(W.partitionBy("patch_id").orderBy(F.xxhash64("row", "col"), "row", "col"))
    return labelled.withColumn("_r", rank).join(sizes, "patch_id").where("_r <= _k").select("row", "col", "patch_id")
