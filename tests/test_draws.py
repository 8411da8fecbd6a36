"""Drawn points and pairs, names of saved projects, distance transforms, and the fluidity strategy."""

from collections import Counter

import numpy as np
import pytest

from mosaiq.functions import scalars
from mosaiq.model import Scenario, strategy
from mosaiq.operators import bottleneck, graph, grid, paths, selection, terminals
from mosaiq.plans import landscape


def cells(spark, rows):
    return spark.createDataFrame(rows, "row int, col int")


def test_points_are_spread_over_components(spark):
    big, small = [(r, c) for r in range(10) for c in range(10)], [(50, 50), (50, 51), (70, 70)]
    mask = cells(spark, big + small)
    got = [(r.row, r.col) for r in terminals.stratified_points(mask, 12).collect()]
    assert len(set(got)) == 12 and set(got) <= set(big + small)
    assert Counter("big" if r < 20 else "two" if r == 50 else "one" for r, _ in got) in ({"big": 10, "two": 1, "one": 1}, {"big": 9, "two": 2, "one": 1})
    again = [(r.row, r.col) for r in terminals.stratified_points(mask.repartition(5), 12).collect()]
    assert sorted(got) == sorted(again) and terminals.stratified_points(mask, 999).count() == 103
    assert terminals.stratified_points(mask.where("false"), 5).count() == 0


def test_pairs_of_points(spark):
    mask = cells(spark, [(0, 0), (0, 9), (9, 0)])
    got = terminals.terminal_pairs(mask, 5, 100, 2.0).collect()
    assert sorted((r.i, r.j) for r in got) == [(0, 1), (0, 2), (1, 2)] and sorted(r.euclid for r in got) == pytest.approx([18, 18, 2 * 162**0.5])
    assert terminals.terminal_pairs(mask, 5, 2).count() == 2 and terminals.terminal_pairs(mask.where("false")).count() == 0


def test_separated_pairs(spark):
    p = spark.createDataFrame([(i, float(i * i), 0.0) for i in range(8)], "id long, x double, y double")
    every = {(i, j): float(j * j - i * i) for i in range(8) for j in range(i + 1, 8)}
    assert {(r.u, r.v): r.distance for r in terminals.separated_pairs(p, 28).collect()} == every
    far = sorted(every, key=lambda k: (-every[k], k))[:12]
    got = [(r.u, r.v) for r in terminals.separated_pairs(p, 3).collect()]
    assert len(set(got)) == 3 and set(got) <= set(far)
    same = spark.createDataFrame([(i, 1.0, 1.0) for i in range(6)], "id long, x double, y double")
    assert terminals.separated_pairs(same, 2).count() == 2


def test_names_of_saved_projects():
    want = {"largest_network": "largest_single_network", "bigconnect": "most_connected_habitat", "Most Connected Area": "most_connected_habitat", "habitat_availability": "reachable_habitat_advanced", "landscape_fluidity_a": "landscape_fluidity", "landscape_fluidity_a1": "landscape_fluidity", "??": "most_connected_habitat"}
    assert {k: strategy(k) for k in want} == want
    modes = {"sum_patches_connected": "sum_direct_connected_patches", "newly_connected_area": "sum_total_network_area", "sum direct connected patches": "sum_direct_connected_patches", "efficiency": "efficiency", "x": "sum_total_network_area"}
    assert {k: Scenario(corridor_cell_assignment=k).corridor_cell_assignment for k in modes} == modes


def test_credited_area(spark):
    df = spark.createDataFrame([(4.0, 9.0, 2.0)], "a double, b double, c double")
    got = [df.select(scalars.connected_area("a", "b", "c", m)).first()[0] for m in ("sum_direct_connected_patches", "sum_total_network_area", "efficiency")]
    assert got == [4.0, 9.0, 0.5]


def test_distances_to_the_outside():
    rng = np.random.default_rng(3)
    for shape in ((9, 14), (30, 5), (1, 6)):
        m = rng.random(shape) < 0.8
        m[0, 0] = False
        out = np.argwhere(~m)
        want = np.array([[np.sqrt(((out - [r, c]) ** 2).sum(axis=1)).min() for c in range(shape[1])] for r in range(shape[0])])
        assert np.allclose(bottleneck.distance_transform(m), want)


def test_ways_there_were_and_the_gate(spark):
    c = spark.createDataFrame([("s", 1, 1, [1, 2], 1.0, 2.0, 5.0), ("s", 2, 2, [1, 3], 1.0, 2.0, 4.0)], "scenario_id string, cand_id long, seq long, patch_ids array<long>, cost double, length double, base_roi double")
    sizes = spark.createDataFrame([(i, 10.0) for i in (1, 2, 3)], "patch_id long, size double")
    budget = spark.createDataFrame([("s", 9.0)], "scenario_id string, budget double")
    ways = spark.createDataFrame([(1, 2, 5.0)], "u long, v long, length double")
    pick = lambda gate: [r.cand_id for r in selection.select_utility(c, sizes, budget, False, ways, gate).collect()]
    assert sorted(pick(2.0)) == [1, 2] and pick(3.0) == [2]
    assert {r.reason: r.n for r in selection.select_utility(c, sizes, budget, False, ways, 3.0, trace=True).collect()} == {"primary": 1, "rejected": 1}


def test_fluidity_cuts_patches_at_passages(spark):
    block = lambda r0, c0: [(r0 + r, c0 + c) for r in range(9) for c in range(9)]
    mask = cells(spark, [*block(0, 0), *[(4, c) for c in range(9, 13)], *block(0, 13), *block(12, 6)])
    lab = grid.patches(mask)
    runs = [Scenario(scenario_id=k, strategy=k, budget=60, max_search_distance=12) for k in ("landscape_fluidity", "most_connected_habitat")]
    table = grid.patch_table(lab)
    picks = landscape.run_scenarios(lab, table, runs)
    assert {r.scenario_id for r in picks.collect()} == {"landscape_fluidity", "most_connected_habitat"}
    stats = {(r.scenario_id, r.key): r.value for r in landscape.network_stats(picks, spark.createDataFrame([(k, r.cand_id, [1, 2]) for k in ("landscape_fluidity", "most_connected_habitat") for r in picks.select("cand_id").distinct().collect()], "scenario_id string, cand_id long, patch_ids array<long>"), table.select("patch_id", "cells").withColumnRenamed("cells", "size")).collect()}
    assert stats["landscape_fluidity", "components_remaining"] == 1 and stats["landscape_fluidity", "total_connected_area"] == 247


def test_all_of_a_component_are_reached(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (5, 6, 1.0)], "u long, v long, weight double")
    n = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6, 9)], "node long")
    got = {(r.src, r.dst) for r in paths.has_path(e, n.where("node in (1, 9)"), n).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (9, 9)} and graph.is_connected(e, n) is False


def test_report_has_three_decimals(spark):
    rows = [("largest_network", 3.0, 3.5, 16.6666, True), ("connected_area", 0.0, 1.0, 0.0, True)]
    lines = [r.line for r in landscape.report_lines(spark.createDataFrame(rows, "metric string, pre double, post double, delta_pct double, printed boolean")).orderBy("n").collect()]
    assert "| +16.667%    |" in lines[3] and "| n/a         |" in lines[2]
