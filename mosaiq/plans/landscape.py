"""The before-and-after report of a landscape, and scenario runs from cells to picks and stats."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.functions.scalars import delta_percent, format_value
from mosaiq.model import Scenario
from mosaiq.operators import bottleneck, candidates, grid, pairs, selection
from mosaiq.operators.components import components
from mosaiq.operators.graph import flow_resistance_index
from mosaiq.operators.paths import grid_distances
from mosaiq.operators.reach import candidate_edges, reach_distances, reach_metrics, reach_nodes
from mosaiq.operators.terminals import terminal_pairs
from mosaiq.scratch import Scratch

#: Cells on the longer side to which masks are reduced for path sampling.
SIDE = 320
#: The printed rows with their decimals, texts and sources.
PRINTED = {
    "connected_area": ("Total Connected Habitat Area", 2, "Habitat area connected into multi-patch networks", ""),
    "largest_network": ("Largest Network Area", 2, "Habitat area in the largest connected network", ""),
    "reachable_habitat": ("Reachable Habitat Score", 4, "Reachable habitat weighted by dispersal probability", "Kupfer 2012"),
    "path_resistance": ("Mean Effective Resistance", 4, "Average difficulty of movement across network", "Wagner & Fortin 2005"),
}


def connected(table: DataFrame, records: DataFrame) -> DataFrame:
    """One row: connected_area (networks of two patches or more), largest_network and largest_patch."""
    links = records.where(F.size("patch_ids") >= 2).select(F.get("patch_ids", 0).alias("u"), F.explode("patch_ids").alias("v"))
    comp = components(links, table.select(F.col("patch_id").alias("node")))
    sums = comp.join(table.select(F.col("patch_id").cast("long").alias("node"), "area"), "node").groupBy("component").agg(F.sum("area").alias("a"), F.count(F.lit(1)).alias("n"), F.max("area").alias("m"))
    return sums.agg(*[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in (("connected_area", F.sum(F.when(F.col("n") >= 2, F.col("a")))), ("largest_network", F.max("a")), ("largest_patch", F.max("m")))])


def landscape_report(pre: DataFrame, post: DataFrame, s: Scenario, res_x: float = 1.0, res_y: float = 1.0, metric: bool = False, overrides: dict[str, float] | None = None) -> DataFrame:
    """(metric, pre, post, delta_pct, printed): all metrics of both masks, and those of the graph that what was added makes of the patches.

    overrides: values by name_pre or name_post that stand in for mesh, lcc, path_resistance,
    fluidity and mobility where they are 0 or more.
    """
    spark, given = pre.sparkSession, overrides or {}
    cuts = Scratch(spark, "report")
    cell = max(abs(res_x), abs(res_y)) or 1.0 if metric else 1.0
    cell_area = res_x * res_y / 10_000 if metric else 1.0
    pre, post = cuts.cut(pre.select("row", "col").distinct(), "pre"), cuts.cut(grid.mask_union(pre, post), "post")
    labelled = cuts.cut(grid.patches(pre), "labelled")
    table = cuts.cut(grid.patch_table(labelled, cell, cell_area), "table")
    after = grid.patch_table(grid.patches(post), cell, cell_area)
    m = [grid.patch_metrics(t, res_x, res_y, metric).first().asDict() for t in (table, after)]
    added = grid.label_components(grid.mask_except(post, pre))
    added = added.join(grid.ranked(added, "component", "corridor_id"), "component").select("row", "col", "corridor_id")
    records = cuts.cut(grid.corridor_records(added, labelled, table, cell, cell_area), "records")
    reachable = [row.asDict() for row in _reach(table, records, s)]
    near = cuts.cut(pairs.pairs_within(table.select(F.col("patch_id").alias("id"), "x", "y"), s.cutoff), "near")
    areas = table.select(F.col("patch_id").alias("id"), "area")
    edges = candidate_edges(records.where(F.size("patch_ids") >= 2).select(F.col("corridor_id").alias("cand_id"), "patch_ids", "length"))
    ways = _ways(edges, s.cutoff)
    pc = [pairs.pc_norm(near, areas, s.alpha).first().pc, pairs.pc_norm(near, areas, s.alpha, ways).first().pc]
    net = connected(table, records).first()
    lcc = [net.largest_patch, net.largest_network]
    flows = _flows(pre, post, s, cell)
    total = m[0]["total_area"]
    rows: dict[str, list[float]] = {k: [m[0][k], m[1][k]] for k in grid.METRICS}
    one = lambda x: max(0.0, min(1.0, x))
    rows["mesh_norm"] = [one(x["mesh"] / x["total_area"]) if x["total_area"] else 0.0 for x in m]
    rows["lcc_norm"] = [one(m[i]["lps"] / total) if total else 0.0 for i in (0, 1)]
    rows |= {"pc": pc, "connected_area": [0.0, net.connected_area], "largest_network": lcc, "reachable_habitat": [r["ha"] for r in reachable]}
    for k in ("mean_reachable", "median_reachable", "largest_cluster"):
        rows[k] = [r[k] for r in reachable]
    for k in ("path_resistance", "ime", "mobility", "fri"):
        rows[k] = [f[k] for f in flows]
    for k in ("mesh_norm", "lcc_norm", "path_resistance", "mobility"):
        rows[k] = [v if (g := given.get(f"{k}_{side}", -1.0)) < 0 else g for v, side in zip(rows[k], ("pre", "post"), strict=True)]
    fluid = [given.get(f"fluidity_{side}", -1.0) for side in ("pre", "post")]
    rows["fluidity"] = fluid if min(fluid) >= 0 else [1 / max(r, 1e-9) for r in rows["path_resistance"]]
    w = s.normal_weights()
    rows["composite"] = [sum(a * b for a, b in zip(w, x, strict=True)) for x in zip(rows["mesh_norm"], rows["lcc_norm"], rows["pc"], rows["fri" if s.redundancy_method.strip().lower() == "fri" else "ime"], strict=True)]
    df = spark.createDataFrame([(k, float(a), float(b), k in PRINTED) for k, (a, b) in rows.items()], "metric string, pre double, post double, printed boolean")
    return df.select("metric", "pre", "post", delta_percent(F.col("pre"), F.col("post")).alias("delta_pct"), "printed")


def _ways(edges: DataFrame, cutoff: float) -> DataFrame | None:
    from mosaiq.operators.paths import distances

    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    return distances(edges, nodes, cutoff) if not edges.isEmpty() else None


def _reach(table: DataFrame, records: DataFrame, s: Scenario) -> list:
    nodes = reach_nodes(table, s.scaling, s.min_species_area)
    edges = candidate_edges(records.where(F.size("patch_ids") >= 2).select(F.col("corridor_id").alias("cand_id"), "patch_ids", "length"))
    return [reach_metrics(nodes, reach_distances(nodes, e, s.dispersal), s.dispersal).first() for e in (edges.limit(0), edges)]


def _flows(pre: DataFrame, post: DataFrame, s: Scenario, cell: float) -> list[dict]:
    top = post.agg(F.greatest(F.max("row"), F.max("col"))).first()[0]
    factor = max(1, math.ceil(((top or 0) + 1) / SIDE))
    small = [grid.downsample(x, factor) for x in (pre, post)]
    points = terminal_pairs(small[0], s.sample_points, s.pair_samples, cell * factor)
    out = []
    for mask in small:
        d = points.select("i", "j", "euclid").join(grid_distances(mask, points, cell * factor), ["i", "j"])
        out.append(pairs.pair_metrics(d, s.mobility_detour_cap).first().asDict() | flow_resistance_index(d).first().asDict())
    return out


def report_lines(report: DataFrame) -> DataFrame:
    """(n, line): the printed rows in fixed columns."""
    spark = report.sparkSession
    texts = spark.createDataFrame([(k, n, *v) for n, (k, v) in enumerate(PRINTED.items(), 2)], "metric string, n int, name string, decimals int, description string, source string")
    rows = report.where("printed").join(F.broadcast(texts), "metric")  # four rows
    show = lambda c: F.when(F.col("decimals") == 4, format_value(F.col(c), 4)).otherwise(format_value(F.col(c), 2))
    delta = F.when(F.col("metric") == "connected_area", "n/a").otherwise(F.format_string("%+.3f%%", "delta_pct"))
    fields = (("name", 44), (show("pre"), 15), (show("post"), 15), (delta, 11), ("description", 72), ("source", 26))
    wide = lambda c, n: F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(0), n - F.length(c))))  # noqa: E731  longer texts are not cut
    line = F.concat_ws(" | ", *[wide(F.col(c) if isinstance(c, str) else c, n) for c, n in fields])
    head = " | ".join(t.ljust(n) for t, n in zip(("METRIC NAME", "PRE", "POST", "DELTA %", "DESCRIPTION", "SOURCE"), (44, 15, 15, 11, 72, 26), strict=True))
    top = spark.createDataFrame([(0, head), (1, "-" * len(head))], "n int, line string")
    return top.union(rows.select("n", line.alias("line")))


def run_scenarios(labelled: DataFrame, table: DataFrame, runs: list[Scenario], cell: float = 1.0, obstacles: DataFrame | None = None) -> DataFrame:
    """(scenario_id, pick_order, cand_id, corr_type, score, overlap_ratio, cost) of all scenarios over one labelled grid."""
    spark = labelled.sparkSession
    cuts = Scratch(spark, "scenarios")
    out = None
    sizes = table.select(F.col("patch_id").cast("long").alias("patch_id"), F.col("area").alias("size"))
    for reach, width in sorted({(s.max_search_distance, s.min_corridor_width) for s in runs}):
        found = cuts.cut(candidates.grid_candidates(labelled, table, reach, width, cell, obstacles), f"c{reach}-{width}")
        for s in (s for s in runs if (s.max_search_distance, s.min_corridor_width) == (reach, width)):
            own = found.withColumn("scenario_id", F.lit(s.scenario_id))
            budget = spark.createDataFrame([(s.scenario_id, float(s.budget))], "scenario_id string, budget double")
            if s.strategy == "largest_single_network":
                ends = own.select("scenario_id", "cand_id", "seq", F.col("p1").alias("u"), F.col("p2").alias("v"), "cost")
                picks = selection.largest_network(selection.select_backbone(ends, budget), own, sizes)
            elif s.strategy == "reachable_habitat_advanced":
                picks = selection.select_reach(own, reach_nodes(table, s.scaling, s.min_species_area), budget, s.dispersal)
            elif s.strategy == "landscape_fluidity":
                picks = _fluidity(own, labelled, table, budget, s)
            else:
                picks = selection.select_utility(own, sizes, budget)
            picks = cuts.cut(picks, f"picks-{s.scenario_id}")
            if s.strategy != "landscape_fluidity":
                more = selection.fill_budget(own, picks, budget)
                n = picks.agg(F.coalesce(F.max("pick_order"), F.lit(0)).alias("n"))
                picks = picks.union(more.crossJoin(n).withColumn("pick_order", F.col("pick_order") + F.col("n")).drop("n"))  # one row
            out = picks if out is None else out.union(picks)
    return out


def _fluidity(found: DataFrame, labelled: DataFrame, table: DataFrame, budget: DataFrame, s: Scenario) -> DataFrame:
    """Picks over patches cut at their narrow passages: a passage is a way of its resistance, and a corridor inside a network must shorten ways by the shortcut threshold.

    Corridors end at the part of a patch on whose side they touch it. Where bottlenecks are not
    allowed, patches stay whole and no way exists before the first pick.
    """
    table = table.select("patch_id", "cells")
    narrow = bottleneck.detect(labelled) if s.allow_bottlenecks else bottleneck.detect(labelled.limit(0))
    subs, passages = bottleneck.decompose(table, Scratch(labelled.sparkSession, "fluidity").cut(narrow, "passages"))
    ends = found.select("cand_id", F.col("p1").alias("patch_id"), F.col("r1").alias("row"), F.col("c1").alias("col"), F.lit(0).alias("end")).union(found.select("cand_id", "p2", "r2", "c2", F.lit(1)))
    nodes = bottleneck.to_subnodes(ends, passages).groupBy("cand_id").agg(F.max(F.when(F.col("end") == 0, F.col("node"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("node"))).alias("b"))
    sizes = subs.select(F.col("node").alias("patch_id"), F.col("size").cast("double").alias("size"))
    area = lambda k: sizes.select(F.col("patch_id").alias(k), F.col("size").alias(f"s{k}"))
    cut = found.drop("patch_ids", "base_roi").join(nodes, "cand_id").join(area("a"), "a").join(area("b"), "b")
    cut = cut.withColumns({"patch_ids": F.array("a", "b"), "base_roi": F.sqrt(F.col("sa") * F.col("sb")) / F.col("cost")})
    return selection.select_utility(cut, sizes, budget, ways=passages.select(F.col("node_a").alias("u"), F.col("node_b").alias("v"), F.col("resistance").alias("length")), gate=s.shortcut_threshold)


def network_stats(picks: DataFrame, found: DataFrame, sizes: DataFrame) -> DataFrame:
    """(scenario_id, key, value) of the networks that picks make of patches (patch_id, size): components_remaining, total_connected_area, largest_group_area, avg_degree and redundant_links.

    found: (scenario_id, cand_id, patch_ids) of all candidates.
    """
    order = picks.select("scenario_id").distinct().withColumn("s", F.row_number().over(W.orderBy("scenario_id")).cast("long"))
    e = picks.join(found.select("scenario_id", "cand_id", "patch_ids"), ["scenario_id", "cand_id"]).join(order, "scenario_id").withColumn("p", F.explode("patch_ids"))
    # Nodes of different scenarios are kept apart by a number in the upper bits.
    e = e.select("scenario_id", "s", "cand_id", "corr_type", (F.shiftleft("s", 40) + F.get("patch_ids", 0)).alias("u"), (F.shiftleft("s", 40) + F.col("p")).alias("v"))
    every = order.crossJoin(sizes.select("patch_id", "size")).select("scenario_id", (F.shiftleft("s", 40) + F.col("patch_id")).alias("node"), "size")  # a row for each scenario and patch
    comp = components(e, every.select("node"))
    groups = every.join(comp, "node").groupBy("scenario_id", "component").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    parts = groups.groupBy("scenario_id").agg(F.count(F.lit(1)).cast("double").alias("components_remaining"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("size"))), F.lit(0.0)).alias("total_connected_area"), F.max("size").alias("largest_group_area"), F.sum("n").alias("n"))
    links = e.where("u <> v").groupBy("scenario_id").agg(F.count(F.lit(1)).alias("m"), F.count_distinct(F.when(F.col("corr_type") == "redundant", F.col("cand_id"))).cast("double").alias("redundant_links"))
    wide = parts.join(links, "scenario_id", "left").select("scenario_id", "components_remaining", "total_connected_area", "largest_group_area", (2 * F.coalesce("m", F.lit(0)) / F.col("n")).alias("avg_degree"), F.coalesce("redundant_links", F.lit(0.0)).alias("redundant_links"))
    return wide.unpivot("scenario_id", wide.columns[1:], "key", "value")


def scenario_stats(picks: DataFrame, budgets: DataFrame) -> DataFrame:
    """(scenario_id, key, value): corridors used, budget used and total, primary, redundant and wasteful links."""
    n = lambda k: F.count(F.when(F.col("corr_type") == k, 1)).cast("double").alias(k)
    wide = budgets.join(picks, "scenario_id", "left").groupBy("scenario_id").agg(F.count("cand_id").cast("double").alias("corridors_used"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("budget_used"), F.max("budget").alias("budget_total"), n("primary"), n("redundant"), n("wasteful"))
    return wide.unpivot("scenario_id", ["corridors_used", "budget_used", "budget_total", "primary", "redundant", "wasteful"], "key", "value")
