"""Grids against hand-derived values and brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaiq.model import Scenario, ScenarioError, parse_numbers, strategy, to_cells
from mosaiq.operators import bottleneck, grid, pairs
from mosaiq.operators.components import components, label
from mosaiq.plans import landscape
from mosaiq.sources import grids

BLOCKS = [(2, 8, 2, 8), (3, 9, 12, 18), (12, 18, 5, 11), (20, 26, 20, 26)]


def fixture(spark):
    m = np.zeros((30, 30), np.float32)
    for a, b, c, d in BLOCKS:
        m[a:b, c:d] = 1
    return grids.from_array(spark, m, 0.0)


def test_patch_metrics(spark):
    cells = grid.habitat(fixture(spark), Scenario(patch_values=(1.0,), nodata_fallback=0.0))
    table = grid.patch_table(grid.patches(cells), 20.0, 0.04)
    m = grid.patch_metrics(table, 20.0, 20.0, True).first().asDict()
    want = {"total_area": 5.76, "num_patches": 4, "mesh": 1.44, "split": 4, "lps": 1.44, "lpi": 25, "pd": 69.444444, "total_edge": 1.92, "ed": 333.333333, "msi": 1, "mean_para": 0.033333, "frac": 1, "ai": 91.603053, "cai": 44.444444, "mean_gyrate": 48.304589}
    assert {k: round(m[k], 6) for k in want} == want
    near = pairs.pairs_within(table.selectExpr("patch_id id", "x", "y"), 600.0)
    got = {(r.p1, r.p2): round(r.distance, 4) for r in near.collect()}
    assert got == {(1, 2): 200.9975, (1, 3): 208.8061, (1, 4): 509.1169, (2, 3): 228.0351, (2, 4): 375.7659, (3, 4): 340.0}
    assert round(pairs.pc_norm(near, table.selectExpr("patch_id id", "area"), 200.0).first().pc, 6) == 0.431466


def test_empty_grid_is_all_zero(spark):
    none = fixture(spark).where("false")
    assert set(grid.patch_metrics(grid.patch_table(grid.patches(none))).first().asDict().values()) == {0.0}


def test_corridors_of_zero_one_and_three_added_parts(spark):
    pre = fixture(spark).select("row", "col")
    lab = grid.patches(pre)
    for rows in ([], [(5, c) for c in range(8, 12)], [(5, 9), (15, 15), (28, 1)]):
        added = spark.createDataFrame(rows, "row int, col int")
        a = grid.label_components(added)
        a = a.join(grid.ranked(a, "component", "corridor_id"), "component")
        got = grid.corridor_records(a, lab, grid.patch_table(lab)).orderBy("corridor_id").collect()
        assert len(got) == (0 if not rows else 1 if len(rows) == 4 else 3)
        if len(rows) == 4:
            assert got[0].patch_ids == [1, 2] and got[0].benefit == 36 * 36 and got[0].area_cost == 4 and got[0].length == 2


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=40, unique=True), st.sampled_from([4, 8]))
def test_labels_by_brute_force(spark, cells, connectivity):
    df = spark.createDataFrame(cells, "row int, col int")
    got = {(r.row, r.col): r.component for r in grid.label_components(df, connectivity).collect()}
    left, want = set(cells), {}
    while left:
        todo, part = [min(left)], set()
        while todo:
            x = todo.pop()
            if x in left:
                left.discard(x)
                part.add(x)
                todo += [(x[0] + i, x[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if connectivity == 8 or abs(i) + abs(j) == 1]
        for x in part:
            want[x] = min(part)[0] * grid.STRIDE + min(part)[1]
    assert got == want


def test_components_by_rounds_and_in_one_task_agree(spark):
    rng = np.random.default_rng(3)
    e = spark.createDataFrame(rng.integers(0, 60, (45, 2)).tolist(), "u long, v long")
    one, many = (sorted(map(tuple, components(e, one_task=n).collect())) for n in (10**6, 0))
    assert one == many
    ids, low = label(np.array([1, 5]), np.array([2, 5]))
    assert list(zip(ids.tolist(), low.tolist(), strict=True)) == [(1, 1), (2, 1), (5, 5)]


def test_distance_transform_and_passage(spark):
    m = np.zeros((11, 24), bool)
    m[1:10, 1:10] = m[1:10, 14:23] = True
    m[5, 10:14] = True
    d = bottleneck.distance_transform(m)
    want = [[min(math.hypot(r - i, c - j) for i, j in np.argwhere(~m)) if m[r, c] else 0.0 for c in range(24)] for r in range(11)]
    assert np.allclose(d, want)
    got = bottleneck.passages(m)
    assert len(got) == 1 and got[0]["width"] == 2.0


def test_report_and_scenarios(spark):
    pre = fixture(spark).select("row", "col")
    post = grid.mask_union(pre, spark.createDataFrame([(5, c) for c in range(8, 12)], "row int, col int"))
    s = Scenario(patch_connectivity=8, pc_alpha=200.0, pc_cutoff=600.0, dispersal=250.0, sample_points=8, pair_samples=10)
    rows = {r.metric: r for r in landscape.landscape_report(pre, post, s, 20.0, 20.0, True).collect()}
    assert round(rows["reachable_habitat"].pre, 6) == 5.76 and round(rows["connected_area"].post, 6) == 2.88 and rows["connected_area"].pre == 0
    assert rows["pc"].post >= rows["pc"].pre and rows["path_resistance"].post <= rows["path_resistance"].pre
    assert [r.n for r in landscape.report_lines(landscape.landscape_report(pre, post, s)).orderBy("n").collect()] == list(range(6))
    lab = grid.patches(pre)
    runs = [Scenario(scenario_id=k, strategy=k, budget=30, max_search_distance=10) for k in ("lsn", "mca", "rh")]
    picks = landscape.run_scenarios(lab, grid.patch_table(lab), runs)
    spent = {r.scenario_id: r.s for r in picks.groupBy("scenario_id").agg({"cost": "sum"}).withColumnRenamed("sum(cost)", "s").collect()}
    assert spent and all(x <= 30 for x in spent.values())


def test_parameters():
    assert strategy("Most Connected-Area") == "most_connected_habitat" and strategy("no such") == "most_connected_habitat"
    assert Scenario().normal_weights() == (0.25,) * 4 and Scenario(weights=(0, 0, 0, 0)).normal_weights() == (0.25,) * 4
    assert Scenario(pc_alpha=10).cutoff == 30 and to_cells(2.5, "cells", 1) == 2
    assert parse_numbers("1, 2.5,") == [1, 2.5]
    with pytest.raises(ScenarioError):
        parse_numbers("1,x")
    with pytest.raises(ScenarioError):
        Scenario(patch_mode="range")


def test_ascii_grid_source(spark, tmp_path):
    p = tmp_path / "g.asc"
    p.write_text("ncols 3\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 20\nNODATA_value -9999\n1 2 -9999\n4 5 6\n")
    spark.dataSource.register(grids.AsciiGrid)
    got = sorted(map(tuple, spark.read.format("ascii_grid").load(str(p)).collect()))
    assert got == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 4.0), (1, 1, 5.0), (1, 2, 6.0)]
    assert grids.grid_meta(spark, str(p)).first().origin_y == 40.0
