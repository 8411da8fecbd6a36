"""Pairs of places within a distance, connectivity probability, and aggregates over pair tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.scalars import clamp01, decay_by_distance


def pairs_within(points: DataFrame, cutoff: float) -> DataFrame:
    """(p1, p2, distance) of (id, x, y) with p1 < p2 and distance <= cutoff: buckets as wide as the cutoff, joined by equal keys."""
    if not 0 < cutoff < float("inf"):
        raise ValueError("the cutoff must be positive and finite")
    b = points.select("id", "x", "y", F.floor(F.col("x") / cutoff).alias("bx"), F.floor(F.col("y") / cutoff).alias("by"))
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = b.select(F.col("id").alias("p1"), F.col("x").alias("x1"), F.col("y").alias("y1"), "bx", "by", near.alias("o")).select("p1", "x1", "y1", (F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by"))
    both = left.join(b.select(F.col("id").alias("p2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "bx", "by"), ["bx", "by"]).where("p1 < p2")
    return both.select("p1", "p2", F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")).alias("distance")).where(F.col("distance") <= cutoff)


def pc_norm(pairs: DataFrame, areas: DataFrame, alpha: float, graph: DataFrame | None = None) -> DataFrame:
    """One row `pc`: normalised probability of connectivity over (p1, p2, distance) and (id, area).

    graph: (src, dst, d); where the way through it is shorter than the distance, it counts.
    """
    d = F.col("distance")
    if graph is not None:
        pairs = pairs.join(graph.select(F.col("src").alias("p1"), F.col("dst").alias("p2"), "d"), ["p1", "p2"], "left")
        d = F.least("distance", F.coalesce("d", F.lit(float("inf"))))
    a = areas.select("id", F.greatest(F.col("area"), F.lit(0.0)).alias("area"))
    both = pairs.join(a.select(F.col("id").alias("p1"), F.col("area").alias("a1")), "p1").join(a.select(F.col("id").alias("p2"), F.col("area").alias("a2")), "p2")
    cross = both.agg(F.coalesce(F.sum(F.col("a1") * F.col("a2") * decay_by_distance(d, alpha)), F.lit(0.0)).alias("cross"))
    own = a.agg(F.coalesce(F.sum(F.col("area") * F.col("area")), F.lit(0.0)).alias("own"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("total"))
    # One row each.
    return own.crossJoin(cross).select(F.when(F.col("total") <= 0, 0.0).otherwise(clamp01((F.col("own") + 2 * F.col("cross")) / F.greatest(F.col("total") * F.col("total"), F.lit(1e-12)))).alias("pc"))


def pc_raw(dist: DataFrame, areas: DataFrame, alpha: float = 0.002, none: float | None = 0.0) -> DataFrame:
    """One row `pc`: sum of a_u a_v exp(-alpha d) over pairs src < dst, `none` without a pair; areas default to 1."""
    a = areas.select("id", "area")
    both = dist.where("src < dst").join(a.select(F.col("id").alias("src"), F.col("area").alias("a1")), "src", "left").join(a.select(F.col("id").alias("dst"), F.col("area").alias("a2")), "dst", "left")
    return both.agg(F.coalesce(F.sum(F.coalesce("a1", F.lit(1.0)) * F.coalesce("a2", F.lit(1.0)) * F.exp(-alpha * F.col("d"))), F.lit(none).cast("double")).alias("pc"))


def pair_metrics(pairs: DataFrame, detour_cap: float = 8.0) -> DataFrame:
    """One row over (euclid, d), d null where there is no way: mean path resistance, fluidity, IME and strategic mobility."""
    d, eu = F.col("d"), F.col("euclid")
    cap = max(detour_cap, 1.0)
    ratio = F.when(d.isNull(), cap).otherwise(F.least(F.lit(cap), F.greatest(F.lit(1.0), d / F.greatest(eu, F.lit(1e-9)))))
    sums = pairs.agg(F.count(F.lit(1)).alias("n"), F.max("euclid").alias("far"), F.sum(F.greatest(d, F.lit(0.0))).alias("len"), F.count(F.when(d.isNull(), 1)).alias("cut"), F.sum(F.when(d.isNotNull(), 1 / (d + 1e-9)).otherwise(0.0)).alias("num"), F.sum(1 / (F.greatest(eu, F.lit(0.0)) + 1e-9)).alias("den"), F.avg(ratio).alias("ratio"))
    penalty = F.greatest(F.lit(1.0), 20 * F.col("far"))
    some: Column = F.col("n") > 0
    resist = F.when(some, (F.coalesce("len", F.lit(0.0)) + F.col("cut") * penalty) / F.col("n")).otherwise(0.0)
    return sums.select(resist.alias("path_resistance"), (1 / F.greatest(resist, F.lit(1e-9))).alias("fluidity"), F.when(some, clamp01(F.col("num") / F.col("den"))).otherwise(0.0).alias("ime"), F.when(some, clamp01(1 / F.col("ratio"))).otherwise(0.0).alias("mobility"))


def composite(mesh: Column, lcc: Column, pc: Column, flow: Column, weights: tuple[float, ...]) -> Column:
    return sum((w * c for w, c in zip(weights, (mesh, lcc, pc, flow), strict=True)), F.lit(0.0))
