"""Corridor candidates between patches: our own specification.

A candidate joins two patches whose nearest cells are within the search distance. Its length is
that gap, its cost the gap times the corridor's width, and its base score the root of the product
of both areas per cost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.grid import neighbours


def grid_candidates(labelled: DataFrame, table: DataFrame, reach: float, width: float = 1.0, cell: float = 1.0, obstacles: DataFrame | None = None) -> DataFrame:
    """(cand_id, seq, p1, p2, patch_ids, length, cost, base_roi, r1, c1, r2, c2) of labelled cells.

    Only cells on the outline take part, bucketed by the reach. Candidates whose straight line, sampled at
    each cell, meets an obstacle are left out.
    """
    edge = neighbours(labelled, "patch_id").where("nbrs < 4").select("row", "col", "patch_id")
    size = max(1, int(-(-reach // cell)))
    b = edge.withColumns({"bx": F.floor(F.col("col") / size), "by": F.floor(F.col("row") / size)})
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = b.select(F.col("patch_id").alias("p1"), F.col("row").alias("r1"), F.col("col").alias("c1"), "bx", "by", near.alias("o")).select("p1", "r1", "c1", (F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by"))
    both = left.join(b.select(F.col("patch_id").alias("p2"), F.col("row").alias("r2"), F.col("col").alias("c2"), "bx", "by"), ["bx", "by"]).where("p1 < p2")
    gap = F.hypot(F.col("r1") - F.col("r2"), F.col("c1") - F.col("c2")) * cell
    best = both.withColumn("length", gap).where(F.col("length") <= reach).groupBy("p1", "p2").agg(F.min(F.struct("length", "r1", "c1", "r2", "c2")).alias("b")).select("p1", "p2", "b.*")
    if obstacles is not None:
        steps = F.greatest(F.abs(F.col("r1") - F.col("r2")), F.abs(F.col("c1") - F.col("c2")))
        line = best.withColumn("t", F.explode(F.sequence(F.lit(0), steps))).withColumn("n", F.greatest(steps, F.lit(1)))
        at = lambda a, z: F.round(F.col(a) + (F.col(z) - F.col(a)) * F.col("t") / F.col("n")).cast("int")
        hit = line.select("p1", "p2", at("r1", "r2").alias("row"), at("c1", "c2").alias("col")).join(obstacles.select("row", "col"), ["row", "col"], "left_semi").select("p1", "p2").distinct()
        best = best.join(hit, ["p1", "p2"], "left_anti")
    return _scored(best, table, width)


def _scored(best: DataFrame, table: DataFrame, width: float) -> DataFrame:
    a = lambda k: table.select(F.col("patch_id").alias(f"p{k}"), F.col("area").alias(f"a{k}"))
    df = best.join(a(1), "p1").join(a(2), "p2").withColumn("cost", F.col("length") * width)
    seq = F.shiftleft(F.col("p1").cast("long"), 32) + F.col("p2")
    return df.select(seq.alias("cand_id"), seq.alias("seq"), "p1", "p2", F.array(F.col("p1").cast("long"), F.col("p2").cast("long")).alias("patch_ids"), "length", "cost", (F.sqrt(F.col("a1") * F.col("a2")) / F.col("cost")).alias("base_roi"), *[c for c in ("r1", "c1", "r2", "c2") if c in best.columns])


def box_candidates(boxes: DataFrame, reach: float, width: float) -> DataFrame:
    """The same between axis-parallel boxes (patch_id, xmin, ymin, xmax, ymax) in metres; cost in hectares."""
    b = boxes.withColumn("area", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")) / 10_000)
    bucket = lambda lo, hi: F.explode(F.sequence(F.floor(lo / reach), F.floor(hi / reach)))
    names = ["patch_id", "xmin", "ymin", "xmax", "ymax"]
    left = b.select(*[F.col(c).alias(f"{c}_1") for c in names], bucket(F.col("xmin") - reach, F.col("xmax") + reach).alias("bx")).withColumn("by", bucket(F.col("ymin_1") - reach, F.col("ymax_1") + reach))
    right = b.select(*[F.col(c).alias(f"{c}_2") for c in names], bucket(F.col("xmin"), F.col("xmax")).alias("bx")).withColumn("by", bucket(F.col("ymin_2"), F.col("ymax_2")))
    apart = lambda k: F.greatest(F.lit(0.0), F.col(f"{k}min_1") - F.col(f"{k}max_2"), F.col(f"{k}min_2") - F.col(f"{k}max_1"))
    both = left.join(right, ["bx", "by"]).where("patch_id_1 < patch_id_2").select(F.col("patch_id_1").alias("p1"), F.col("patch_id_2").alias("p2"), F.hypot(apart("x"), apart("y")).alias("length")).where(F.col("length").between(1e-12, reach)).distinct()
    return _scored(both, b, width / 10_000)


def contiguous_areas(labelled: DataFrame, corridor_cells: DataFrame) -> DataFrame:
    """(component, cells, patches): patches and corridors dissolved into connected areas."""
    from mosaiq.operators.grid import label_components, mask_union

    comp = label_components(mask_union(labelled, corridor_cells), 8)
    return comp.join(labelled.select("row", "col", "patch_id"), ["row", "col"], "left").groupBy("component").agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("patch_id").alias("patches"))
