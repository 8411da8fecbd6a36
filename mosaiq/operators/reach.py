"""Reachable habitat: effective areas of patches within dispersal distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.scalars import scale_area
from mosaiq.operators.components import components
from mosaiq.operators.paths import distances

#: The cutoff in dispersal distances, and the least alpha.
CUTOFF, LEAST_ALPHA = 3.0, 1e-9


def reach_nodes(patches: DataFrame, scaling: str = "sqrt", min_area: float = 0.0) -> DataFrame:
    """(node, raw_area, area) of patches (patch_id, area[, quality]); patches under min_area or without weight are left out."""
    quality = F.coalesce("quality", F.lit(1.0)) if "quality" in patches.columns else F.lit(1.0)
    raw = F.greatest(F.lit(0.0), F.col("area")) * F.greatest(F.lit(0.0), quality)
    eff = F.when(F.col("area") >= min_area, scale_area(F.col("area"), quality, scaling)).otherwise(0.0)
    return patches.select(F.col("patch_id").cast("long").alias("node"), raw.alias("raw_area"), eff.alias("area")).where("area > 0")


def candidate_edges(candidates: DataFrame) -> DataFrame:
    """(cand_id, u, v, weight): all pairs of the patches that a candidate (cand_id, patch_ids, length) touches."""
    c = candidates.select("cand_id", F.array_sort(F.array_distinct("patch_ids")).alias("ps"), F.col("length").alias("weight"))
    one = c.select("cand_id", "ps", "weight", F.posexplode("ps").alias("i", "u"))
    return one.select("cand_id", "u", F.explode(F.slice("ps", F.col("i") + 2, F.size("ps"))).alias("v"), "weight")


def reach_distances(nodes: DataFrame, edges: DataFrame, dispersal: float) -> DataFrame:
    """(src, dst, d) within 3 dispersal distances, among the nodes."""
    own = nodes.select("node")
    inside = edges.join(own.withColumnRenamed("node", "u"), "u", "left_semi").join(own.withColumnRenamed("node", "v"), "v", "left_semi")
    return distances(inside, own, cutoff=CUTOFF * dispersal)


def reach_metrics(nodes: DataFrame, dist: DataFrame, dispersal: float) -> DataFrame:
    """One row: ha, mean_reachable, median_reachable and largest_cluster; zeros without nodes."""
    alpha = max(dispersal / 3, LEAST_ALPHA)
    w = nodes.select(F.col("node").alias("dst"), F.col("area").alias("wj"))
    reach = dist.join(w, "dst").groupBy("src").agg(F.sum(F.exp(-F.col("d") / alpha) * F.col("wj")).alias("reach"))
    sums = nodes.join(reach, nodes.node == reach.src).agg(F.coalesce(F.sum(F.col("area") * F.col("reach")), F.lit(0.0)).alias("ha"), F.coalesce(F.avg("reach"), F.lit(0.0)).alias("mean_reachable"), F.coalesce(F.median("reach"), F.lit(0.0)).alias("median_reachable"))
    near = dist.where(F.col("d") <= dispersal + 1e-12).select(F.col("src").alias("u"), F.col("dst").alias("v"))
    top = components(near, nodes.select("node")).join(nodes, "node").groupBy("component").agg(F.sum("raw_area").alias("s")).agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("largest_cluster"))
    return sums.crossJoin(top)  # one row each
