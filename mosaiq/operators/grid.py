"""Grids as sparse cells (row, col, value): masks, neighbourhoods, patches and their metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.model import Scenario, ScenarioError
from mosaiq.operators.components import components

#: Rows and columns fit 31 bits; a cell's number orders cells by row, then column.
STRIDE = 1 << 32


def cell_id(row: str = "row", col: str = "col") -> Column:
    return F.col(row).cast("long") * STRIDE + F.col(col)


def valid(cells: DataFrame, nodata: float | None, tolerance: float = 1e-6) -> DataFrame:
    """Cells that are not nodata, compared as floats."""
    value = F.col("value").cast("float")
    return cells.where("value is not null") if nodata is None else cells.where(F.abs(value - F.lit(nodata).cast("float")) >= tolerance)


def _near(values: tuple[float, ...], tolerance: float) -> Column:
    value = F.col("value").cast("float")
    return reduce(lambda a, b: a | b, [F.abs(value - F.lit(v).cast("float")) < tolerance for v in values], F.lit(False))


def habitat(cells: DataFrame, s: Scenario, nodata: float | None = None) -> DataFrame:
    """Habitat cells: values near one of patch_values, or within the range as given (bounds aren't swapped)."""
    nodata = s.nodata_fallback if nodata is None else nodata
    if s.patch_mode == "range":
        found = F.col("value").between(s.range_lower, s.range_upper)
    elif s.patch_values:
        found = _near(s.patch_values, s.value_tolerance)
    else:
        raise ScenarioError("habitat needs values or a range")
    return valid(cells, nodata, s.value_tolerance).where(found)


def obstacles(cells: DataFrame, s: Scenario, nodata: float | None = None) -> DataFrame:
    """Obstacle cells; bounds may stand in either order. Habitat isn't taken out."""
    nodata = s.nodata_fallback if nodata is None else nodata
    some = valid(cells, nodata, s.value_tolerance)
    if not s.obstacle_enabled:
        return some.where(F.lit(False))
    if s.obstacle_mode == "range":
        lo, hi = sorted((s.obstacle_range_lower, s.obstacle_range_upper))
        return some.where(F.col("value").between(lo, hi))
    return some.where(_near(s.obstacle_values, s.value_tolerance))


def mask_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("row", "col").union(b.select("row", "col")).distinct()


def mask_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("row", "col").join(b.select("row", "col"), ["row", "col"], "left_semi").distinct()


def mask_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("row", "col").join(b.select("row", "col"), ["row", "col"], "left_anti").distinct()


def downsample(mask: DataFrame, factor: int) -> DataFrame:
    """Blocks with a cell in them."""
    return mask.select(F.expr(f"row div {factor}").cast("int").alias("row"), F.expr(f"col div {factor}").cast("int").alias("col")).distinct()


def shifted(mask: DataFrame, offsets: list[tuple[int, int]], *keep: str) -> DataFrame:
    """The mask moved by each offset."""
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets]))
    return mask.select("row", "col", *keep, at.alias("o")).select((F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), *keep)


def dilate(mask: DataFrame, offsets: list[tuple[int, int]] | None = None) -> DataFrame:
    """Cells under the mask moved by the offsets, 3 by 3 by default."""
    return shifted(mask, offsets or [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]).distinct()


def neighbours(mask: DataFrame, *keep: str) -> DataFrame:
    """mask with `nbrs`, the number of its 4 neighbours in the mask: one sort by rows, one by columns."""

    def beside(part: str, along: str) -> Column:
        w = W.partitionBy(part).orderBy(along)
        return (F.coalesce(F.lag(along).over(w) == F.col(along) - 1, F.lit(False))).cast("int") + (F.coalesce(F.lead(along).over(w) == F.col(along) + 1, F.lit(False))).cast("int")

    return mask.select("row", "col", *keep).withColumn("_r", beside("row", "col")).withColumn("nbrs", F.col("_r") + beside("col", "row")).drop("_r")


def erode(mask: DataFrame) -> DataFrame:
    """Cells all of whose 4 neighbours are in the mask."""
    return neighbours(mask).where("nbrs = 4").select("row", "col")


def label_components(mask: DataFrame, connectivity: int = 8) -> DataFrame:
    """(row, col, component): component is the least cell id. Runs along rows are joined by equal places in the next row."""
    cells = mask.select("row", "col").distinct()
    w = W.partitionBy("row").orderBy("col")
    runs = cells.withColumn("_g", F.col("col") - F.row_number().over(w)).withColumn("run", F.min(cell_id()).over(W.partitionBy("row", "_g"))).drop("_g")
    reach = [(1, j) for j in ((0,) if connectivity == 4 else (-1, 0, 1))]
    links = shifted(runs, reach, "run").withColumnRenamed("run", "u").join(runs.withColumnRenamed("run", "v"), ["row", "col"]).select("u", "v").distinct()
    comp = components(links)
    return runs.join(comp.withColumnRenamed("node", "run"), "run", "left").select("row", "col", F.coalesce("component", "run").alias("component"))


def ranked(ids: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): 1, 2, ... in order of distinct values. Ranges are numbered apart; only their counts meet in one task."""
    parts = ids.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column).select(column, F.monotonically_increasing_id().alias("_m"))
    parts = parts.select(column, F.shiftright("_m", 33).alias("_p"), (F.col("_m").bitwiseAND((1 << 33) - 1)).alias("_i"))
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return parts.join(before, "_p").select(column, (F.col("_b") + F.col("_i") + 1).cast("int").alias(name))


def patches(mask: DataFrame, connectivity: int = 8) -> DataFrame:
    """(row, col, patch_id), patches numbered in the order of their first cells by rows."""
    labels = label_components(mask, connectivity)
    return labels.join(ranked(labels, "component", "patch_id"), "component").select("row", "col", "patch_id")


def patch_table(labelled: DataFrame, cell: float = 1.0, cell_area: float = 1.0) -> DataFrame:
    """One row for each patch: cells, area, perimeter (cell sides), core cells, centroid and gyration (cells)."""
    return neighbours(labelled, "patch_id").groupBy("patch_id").agg(
        F.count(F.lit(1)).alias("cells"),
        (F.count(F.lit(1)) * F.lit(float(cell_area))).alias("area"),
        F.sum(4 - F.col("nbrs")).alias("perimeter"),
        F.count(F.when(F.col("nbrs") == 4, 1)).alias("core"),
        (F.avg("row") * cell).alias("y"),
        (F.avg("col") * cell).alias("x"),
        F.sqrt(F.var_pop("row") + F.var_pop("col")).alias("gyration"),
    )


#: The metrics of a mask, in their order.
METRICS = ("total_area", "num_patches", "mesh", "lps", "split", "pd", "lpi", "total_edge", "msi", "ed", "mean_para", "frac", "ai", "cai", "mean_gyrate")


def patch_metrics(table: DataFrame, res_x: float = 1.0, res_y: float = 1.0, metric: bool = False) -> DataFrame:
    """One row with the METRICS of a patch table; all 0 for an empty one.

    metric: cells have sides of res_x and res_y metres, areas are in hectares and total_edge in
    kilometres; else all is in cells. Perimeters count res_x for every side. With over 1000 patches
    the gyration is averaged over the first 200. Undefined fractal dimensions (one-cell patches
    in cells) are left out.
    """
    rx, cell_m2 = (res_x, res_x * res_y) if metric else (1.0, 1.0)
    ha = cell_m2 / 10_000 if metric else 1.0
    t = table.withColumns({"a": F.col("cells") * ha, "m2": F.col("cells") * cell_m2, "p": F.col("perimeter") * rx})
    sums = t.agg(
        F.count(F.lit(1)).alias("n"), F.sum("cells").alias("cells"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.max("a").alias("top"), F.sum("perimeter").alias("edge"), F.sum("core").alias("core"),
        F.avg(0.25 * F.col("p") / F.sqrt("m2")).alias("msi"), F.avg(F.col("p") / F.col("m2")).alias("para"),
        F.avg(F.try_divide(2 * F.ln(0.25 * F.col("p")), F.ln("m2"))).alias("frac"),
        F.avg(F.when((F.col("cells") >= 2), F.col("gyration"))).alias("g_all"), F.avg(F.when((F.col("cells") >= 2) & (F.col("patch_id") <= 200), F.col("gyration"))).alias("g_some"),
    )
    area = F.col("cells") * ha
    denom = 2 * F.col("cells") - 2 * F.floor(F.sqrt("cells")) - 2
    out = {
        "total_area": area, "num_patches": F.col("n").cast("double"), "mesh": F.try_divide(F.col("aa"), area), "lps": F.col("top"), "split": F.try_divide(area * area, F.col("aa")),
        "pd": F.try_divide(F.col("n"), area) * 100, "lpi": F.try_divide(F.col("top"), area) * 100, "total_edge": F.col("edge") * rx / (1000 if metric else 1),
        "msi": F.col("msi"), "ed": F.try_divide(F.col("edge") * rx, area), "mean_para": F.col("para"), "frac": F.col("frac"),
        "ai": F.when(denom > 0, (4 * F.col("cells") - F.col("edge")) / 2 / denom * 100), "cai": F.try_divide(F.col("core"), F.col("cells")) * 100,
        "mean_gyrate": F.when(F.col("n") > 1000, F.col("g_some")).otherwise(F.col("g_all")) * rx,
    }
    return sums.select(*[F.coalesce(out[k].cast("double"), F.lit(0.0)).alias(k) for k in METRICS])


def touches(added: DataFrame, pre: DataFrame) -> DataFrame:
    """(corridor_id, patch_id): patches of `pre` within 8-reach of labelled components (row, col, component)."""
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    return shifted(added, around, "corridor_id").join(pre.select("row", "col", "patch_id"), ["row", "col"]).select("corridor_id", "patch_id").distinct()


def corridor_records(added: DataFrame, pre: DataFrame, table: DataFrame, cell: float = 1.0, cell_area: float = 1.0) -> DataFrame:
    """One record for each added component: patches touched, cost, length, benefit and score; none if nothing was added."""
    size = added.groupBy("corridor_id").agg(F.count(F.lit(1)).alias("cells"))
    met = touches(added, pre).join(table.select("patch_id", "area"), "patch_id", "left").groupBy("corridor_id").agg(F.sort_array(F.collect_list("patch_id")).alias("patch_ids"), F.slice(F.sort_array(F.collect_list("area"), asc=False), 1, 2).alias("top"))
    cost = F.col("cells") * float(cell_area)
    benefit = F.when(F.size("top") >= 2, F.get("top", 0) * F.get("top", 1)).when(F.size("top") == 1, F.get("top", 0)).otherwise(0.0)
    out = size.join(met, "corridor_id", "left").withColumn("benefit", F.coalesce(benefit, F.lit(0.0)))
    return out.select("corridor_id", F.coalesce("patch_ids", F.array().cast("array<int>")).alias("patch_ids"), cost.alias("area_cost"), F.greatest(F.sqrt("cells") * cell, F.lit(cell)).alias("length"), "benefit", (F.col("benefit") / F.greatest(cost, F.lit(1e-9))).alias("score"))


def polygon_edges(labelled: DataFrame) -> DataFrame:
    """(patch_id, x1, y1, x2, y2): the cell sides on each patch's outline, for ring export."""
    sides = [((-1, 0), (0, 0, 1, 0)), ((0, 1), (1, 0, 1, 1)), ((1, 0), (1, 1, 0, 1)), ((0, -1), (0, 1, 0, 0))]
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), *[F.lit(v).alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), e, strict=True)]) for (i, j), e in sides]))
    out = labelled.select("row", "col", "patch_id", at.alias("s")).select((F.col("row") + F.col("s.i")).alias("r2"), (F.col("col") + F.col("s.j")).alias("c2"), "row", "col", "patch_id", "s")
    bare = out.join(labelled.select(F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("patch_id")), ["r2", "c2", "patch_id"], "left_anti")
    return bare.select("patch_id", *[(F.col("col" if k[0] == "x" else "row") + F.col(f"s.{k}")).alias(k) for k in ("x1", "y1", "x2", "y2")])
