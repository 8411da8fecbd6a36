"""Graphs against closed forms, and selection against its rules."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import scalars
from mosaiq.operators import candidates, graph, pairs, paths, reach, selection
from mosaiq.sources import vectors

TRIANGLE = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0)]


def edges(spark, rows):
    return spark.createDataFrame(rows, "u long, v long, weight double")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def test_triangle(spark):
    e, n = edges(spark, TRIANGLE), nodes(spark, [1, 2, 3])
    assert {round(r.r, 9) for r in graph.effective_resistance(e, e).collect()} == {round(2 / 3, 9)}
    assert graph.resistance_score(e, n).first().score == pytest.approx(0.5)
    assert graph.algebraic_connectivity(e, n).first().lambda2 == pytest.approx(3)
    assert graph.bridges(e).count() == 0 and graph.redundancy(e, n).first().rho2 == 1
    assert graph.topology(e, n).first().penalty == 1 and graph.failure_probability(e).first().p == 0
    assert graph.failure_probability(e, k=2, draws=20).first().p == 1


def test_path(spark):
    e, n = edges(spark, [(1, 2, 1.0), (2, 3, 2.0)]), nodes(spark, [1, 2, 3])
    ask = spark.createDataFrame([(1, 3, 5.0)], "u long, v long, euclid double")
    assert graph.effective_resistance(e, ask).first().r == pytest.approx(3)
    assert graph.bridges(e).count() == 2 and paths.diameter(e, n).first().diameter == 2 and graph.failure_probability(e).first().p == 1
    d = paths.distances(e, n, through=True)
    assert {(r.src, r.dst): r.d for r in d.collect()}[1, 3] == 3.0 and paths.path(d, 1, 3) == [1, 2, 3]
    with pytest.raises(paths.NoPath):
        paths.path(d, 1, 9)
    assert not graph.is_connected(e, nodes(spark, [1, 2, 3, 4])) and graph.is_connected(e, n)
    assert graph.algebraic_connectivity(e, nodes(spark, [1, 2, 3, 4])).first().lambda2 == 0


def test_parted_pairs_pay_the_penalty(spark):
    e = edges(spark, [(1, 2, 1.0), (3, 4, 1.0)])
    ask = spark.createDataFrame([(1, 3, 5.0)], "u long, v long, euclid double")
    assert graph.mean_resistance(e, ask).first().r == 100
    d = spark.createDataFrame([(5.0, None), (5.0, 5.0)], "euclid double, d double")
    m = pairs.pair_metrics(d).first()
    assert m.path_resistance == 52.5 and m.ime == pytest.approx(0.5) and m.mobility == pytest.approx(1 / 4.5)


def test_parallel_edges_are_no_bridge(spark):
    e = edges(spark, [(1, 2, 3.0), (2, 1, 2.0), (2, 3, 1.0)])
    assert [tuple(r) for r in graph.bridges(e).collect()] == [(2, 3)]
    assert {tuple(r) for r in graph.multigraph(e).collect()} == {(1, 2, 2.0, 2), (2, 3, 1.0, 1)}


def test_penalty_scale(spark):
    want = {0.001: 0.05, 0.0025: 0.05, 0.005: 0.1, 0.0075: 0.2, 0.01: 0.3, 0.03: 0.65, 0.05: 1.0}
    df = spark.createDataFrame([(k,) for k in want], "s double").select("s", scalars.penalty_scale(F.col("s") * 1000, F.col("s") * 5000, F.lit(1000.0)).alias("p"))
    assert {r.s: round(r.p, 6) for r in df.collect()} == want


def test_reach_of_one_edge(spark):
    p = spark.createDataFrame([(1, 1.44), (2, 1.44), (3, 1.44), (4, 1.44)], "patch_id long, area double")
    n = reach.reach_nodes(p)
    ha = [reach.reach_metrics(n, reach.reach_distances(n, edges(spark, e), 250.0), 250.0).first().ha for e in ([], [(1, 2, 120.0)])]
    assert ha[0] == pytest.approx(5.76) and ha[1] - ha[0] == pytest.approx(0.682352, abs=1e-6)


def test_reach_step_by_step_equals_all_at_once(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 7, 12), rng.integers(0, 7, 12), rng.uniform(1, 90, 12), strict=True) if a != b]
    n = reach.reach_nodes(spark.createDataFrame([(i, float(i + 1)) for i in range(7)], "patch_id long, area double"))
    want = reach.reach_metrics(n, reach.reach_distances(n, edges(spark, rows), 50.0), 50.0).first().ha
    r = selection.Reach(list(range(7)), [(i + 1) ** 0.5 for i in range(7)], 50.0)
    for u, v, w in rows:
        r.d = r.with_edge(r.d, u, v, w)
    assert r.value(r.d) == pytest.approx(want)


def test_backbone_ends_at_the_first_edge_that_does_not_fit():
    e = pd.DataFrame([(1, 1, 1, 2, 1.0), (2, 2, 2, 3, 1.0), (3, 3, 1, 3, 1.5), (4, 4, 3, 4, 1.9)], columns=["cand_id", "seq", "u", "v", "cost"])
    got, _, spent = selection.backbone(e, dict.fromkeys(range(1, 5), 1.0), 3.0, None)
    assert [c for c, _ in got] == [1, 2] and spent == 2.0
    got, _, _ = selection.backbone(e, dict.fromkeys(range(1, 5), 1.0), 10.0, 0.5)
    assert got == [(1, "primary"), (2, "primary"), (4, "primary"), (3, "redundant")]


def test_utility_selection(spark):
    c = spark.createDataFrame([("s", 1, 1, [1, 2], 2.0, 2.0, 5.0), ("s", 2, 2, [2, 3], 2.0, 2.0, 4.0), ("s", 3, 3, [1, 3], 2.0, 2.0, 3.0), ("s", 4, 4, [1, 4], 50.0, 1.0, 9.0)], "scenario_id string, cand_id long, seq long, patch_ids array<long>, cost double, length double, base_roi double")
    sizes = spark.createDataFrame([(i, 10.0) for i in range(1, 5)], "patch_id long, size double")
    budget = spark.createDataFrame([("s", 6.0)], "scenario_id string, budget double")
    got = selection.select_utility(c, sizes, budget, bridges=False).orderBy("pick_order").collect()
    assert [(r.cand_id, r.corr_type) for r in got] == [(1, "primary"), (2, "primary"), (3, "redundant")] and got[2].score == pytest.approx(1.5)
    both = selection.select_utility(c, sizes, budget).collect()
    assert sum(r.cost for r in both) <= 6 and {r.cand_id for r in both} == {1, 2, 3}
    assert selection.bridge_pairs(c, sizes, budget).count() == 3


def test_boxes(spark):
    rows = [(1, 1.0, 0.0, 0.0, 120.0, 120.0), (2, 0.8, 220.0, 20.0, 320.0, 120.0), (3, 0.6, 500.0, 0.0, 620.0, 120.0), (4, 0.9, 0.0, 260.0, 140.0, 380.0), (5, 0.7, 260.0, 260.0, 380.0, 380.0)]
    got = {(r.p1, r.p2): round(r.length, 3) for r in candidates.box_candidates(vectors.boxes(spark, rows), 250.0, 20.0).collect()}
    assert got == {(1, 2): 100.0, (1, 4): 140.0, (1, 5): 197.99, (2, 3): 180.0, (2, 4): 161.245, (2, 5): 140.0, (3, 5): 184.391, (4, 5): 120.0}


def test_polygon_round_trips(spark, tmp_path):
    one, two = [vectors.box_ring(0, 0, 1, 2)], [vectors.box_ring(5, 5, 6, 6)]
    for shape in ([one], [one, two]):
        assert vectors.wkb_polygons(vectors.to_wkb(shape)) == shape
    path = str(tmp_path / "a.gpkg")
    vectors.write_geopackage(path, "mask", [(vectors.to_wkb([one]), 1), (vectors.to_wkb([two]), 0)])
    spark.dataSource.register(vectors.GeoPackage)
    got = spark.read.format("geopackage").load(f"{path}|layername=mask").where("attributes['value'] = '1'").collect()
    assert [vectors.wkb_polygons(bytes(r.geom)) for r in got] == [[one]]


def test_resistance_free_pairs(spark):
    d = spark.createDataFrame([(0, 1, 2.0, 2.0), (1, 2, 2.0, 2.0)], "i int, j int, euclid double, d double")
    assert graph.flow_resistance_index(d).first().fri == pytest.approx(0.5)


def test_thinned_edges_keep_cuts_of_one_and_two(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    for n, m in ((60, 75), (40, 400), (30, 30)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        u, v = u[u != v], v[u != v]
        keep = graph.sparse(u, v)
        assert keep.sum() <= 2 * (n - 1)

        def two_edge(a, b):
            near = [[] for _ in range(n)]
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                near[x].append(y)
                near[y].append(x)
            pairs = [(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            return sorted((min(p), max(p)) for p in graph._tarjan(n, [sorted(set(x)) for x in near], {p for p in pairs if pairs.count(p) == 1}))

        assert two_edge(u[keep], v[keep]) == two_edge(u, v)
    monkeypatch.setattr(graph, "BLOCK", 50)
    e = spark.createDataFrame(list(zip(u.tolist(), v.tolist(), strict=True)), "u long, v long")
    big = e.crossJoin(spark.range(20).select(F.col("id").alias("k"))).selectExpr("u + k * 100 as u", "v + k * 100 as v").union(spark.createDataFrame([(100 * k + int(u[0]), 100 * k + 100 + int(u[0])) for k in range(19)], "u long, v long"))
    assert graph.two_forests(big).count() <= 2 * 600
    assert {tuple(r) for r in graph.bridges(big).collect()} == {(a + 100 * k, b + 100 * k) for a, b in two_edge(u, v) for k in range(20)} | {(100 * k + int(u[0]), 100 * k + 100 + int(u[0])) for k in range(19)}


def test_selections_take_more_candidates_than_a_task_holds(spark):
    # 1,000,000 candidates of a scenario, of which some fit; nodes beyond 3,000
    c = spark.range(1_000_000).selectExpr("'s' scenario_id", "id cand_id", "id seq", "id % 4000 u", "(id % 4000 + 1 + id div 4000) % 4001 v", "cast(1 + id as double) cost").selectExpr("*", "array(u, v) patch_ids", "cost length", "1 / cost base_roi")
    budget = spark.createDataFrame([("s", 15.5)], "scenario_id string, budget double")
    got = selection.select_backbone(c, budget).orderBy("pick_order").collect()
    assert [r.cand_id for r in got] == [0, 1, 2, 3, 4]
    assert [r.cand_id for r in selection.fill_budget(c, selection.select_backbone(c, budget), budget.withColumn("budget", F.lit(25.0))).collect()] == [5]
    n = spark.range(4001).selectExpr("id node", "1.0 raw_area", "1.0 area")
    assert [r.cand_id for r in selection.select_reach(c, n, budget, 40.0).orderBy("pick_order").collect()][:2] == [0, 1]


def test_resistance_of_a_large_component(spark):
    # a star of 4,499 leaves, and a square apart
    e = spark.range(1, 4500).selectExpr("0L u", "id v", "2.0D weight").union(edges(spark, [(9001, 9002, 1.0), (9002, 9003, 1.0), (9003, 9004, 1.0), (9004, 9001, 1.0)]))
    ask = edges(spark, [(0, 7, 1.0), (3, 4, 1.0), (9001, 9003, 1.0), (1, 9001, 1.0), (9002, 9001, 1.0)])
    got = {(r.u, r.v): r.r for r in graph.effective_resistance(e, ask).collect()}
    assert got.pop((1, 9001)) is None
    assert got == {k: pytest.approx(x) for k, x in {(0, 7): 2.0, (3, 4): 4.0, (9001, 9003): 1.0, (9002, 9001): 0.75}.items()}


def test_all_separated_pairs(spark):
    from mosaiq.operators import terminals

    p = spark.range(2100).selectExpr("id", "cast(id as double) x", "0.0D y")
    got = terminals.separated_pairs(p).agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("s")).first()
    assert got.n == 2100 * 2099 // 2 and got.s == sum(d * (2100 - d) for d in range(2100))


def test_hops_in_tasks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(6)
    rows = [(int(a), int(b), 1.0) for a, b in rng.integers(0, 90, (100, 2))] + [(200, 201, 1.0)]
    sources = [*range(0, 90, 2), 200, 300]
    near = {x: {b for a, b, _ in rows if a == x} | {a for a, b, _ in rows if b == x} for x in [*range(90), 200, 201, 300]}
    want = {}
    for s in sources:
        far, front = {s: 0.0}, [s]
        for x in front:
            front += [y for y in near[x] if y not in far and far.setdefault(y, far[x] + 1)]
        want |= {(s, y): d for y, d in far.items()}
    monkeypatch.setattr(paths, "SHARE", 7)
    monkeypatch.setattr(paths, "MOST_ROUNDS", 0)  # no joins
    for cutoff in (None, 2.0):
        got = {(r.src, r.dst): r.d for r in paths.distances(edges(spark, rows), nodes(spark, sources), cutoff, None).collect()}
        assert got == {k: d for k, d in want.items() if cutoff is None or d <= cutoff}


@pytest.mark.parametrize("cutoff", [None, 7.5])
def test_weighted_ways_in_tasks(spark, monkeypatch, cutoff):
    import numpy as np

    rng = np.random.default_rng(3)
    # Few distinct weights (ties), many, and very light ones; two components and a node alone.
    weights = [float(x) for x in rng.choice([1.0, 2.0, 3.5, 9.0, 0.001, 60.0], 250)] + [float(x) for x in rng.random(150) * 20]
    rows = [(int(a), int(b), w) for (a, b), w in zip(rng.integers(0, 90, (400, 2)), weights, strict=True)] + [(200, 201, 1.5)]
    sources = [*range(0, 90, 2), 200, 300]
    low = {}
    for a, b, w in rows:
        if a != b:
            low[a, b] = low[b, a] = min(w, low.get((a, b), w))
    want = {}
    for s in sources:
        d, left = {s: 0.0}, {s}
        while left:
            u = min(left, key=d.get)
            left.discard(u)
            for (a, v), w in low.items():
                if a == u and (cutoff is None or d[u] + w <= cutoff) and d[u] + w < d.get(v, float("inf")):
                    d[v] = d[u] + w
                    left.add(v)
        for v, x in d.items():
            want[s, v] = x, min((u for (u, b), w in low.items() if b == v and u in d and abs(d[u] + w - x) <= 1e-9), default=None)
    monkeypatch.setattr(paths, "SPAN", 7)
    tasks = paths.distances(edges(spark, rows), nodes(spark, sources), cutoff, through=True)
    monkeypatch.setattr(paths, "LINKS", 0)  # joins
    joins = paths.distances(edges(spark, rows), nodes(spark, sources), cutoff, through=True)
    for got in (tasks, joins):
        assert {(r.src, r.dst): (r.d, r.before) for r in got.collect()} == want
    monkeypatch.setattr(paths, "LINKS", 8_000_000)
    monkeypatch.setattr(paths, "MOST_ROUNDS", 0)  # no joins
    plain = paths.distances(edges(spark, rows), nodes(spark, sources), cutoff)
    assert {(r.src, r.dst): r.d for r in plain.collect()} == {k: x for k, (x, _) in want.items()}


@pytest.mark.parametrize("first", [3, 20_000])
def test_reach_picks_are_those_of_all_candidates(spark, first):
    # Against a plain greedy search over every candidate; a task that gets 3 of them first asks for others.
    import numpy as np

    rng = np.random.default_rng(11)
    c = [(k, sorted(map(int, rng.choice(25, 2 if k % 20 else 3, replace=False))), float(rng.integers(1, 6) * 10)) for k in range(150)]
    area = {x: float(rng.uniform(1, 9)) for x in range(24)}  # 24 is no node
    budgets = {"a": 200.0, "b": 45.0}
    rows = spark.createDataFrame([(s, k, k, ps, n, n) for s in budgets for k, ps, n in c], "scenario_id string, cand_id long, seq long, patch_ids array<long>, cost double, length double")
    nodes = spark.createDataFrame([(x, a, a) for x, a in area.items()], "node long, raw_area double, area double")
    got = selection.select_reach(rows, nodes, spark.createDataFrame(list(budgets.items()), "scenario_id string, budget double"), 40.0, first)
    want = []
    for s, left in budgets.items():
        r, open_ = selection.Reach(list(area), list(area.values()), 40.0), {k: (ps, n) for k, ps, n in c}
        while True:
            best = max(((g[0] * (0.25 if g[1] else 1.0) / n, -k, g) for k, (ps, n) in open_.items() if n <= left and (g := r.gain(ps, n))), key=lambda x: (round(x[0], 9), x[1]), default=None)
            if best is None:
                break
            r.d, left = r.laid(r.d, best[2][2]), left - open_.pop(-best[1])[1]
            want.append((s, -best[1], round(best[0], 6)))
    assert [(x.scenario_id, x.cand_id, round(x.score, 6)) for x in got.orderBy("scenario_id", "pick_order").collect()] == want


def test_diameter_in_tasks(spark, monkeypatch):
    # 40,000 nodes around a hub: an all-pairs table would have 1.6e9 rows.
    star = spark.range(1, 40_000).selectExpr("0L u", "id v", "1.0D weight")
    monkeypatch.setattr(paths, "MOST_ROUNDS", 0)  # no joins
    monkeypatch.setattr(paths, "LIST", 7)
    assert paths.diameter(star, spark.range(40_000).toDF("node")).first().diameter == 2
    path = edges(spark, [(k, k + 1, 1.0) for k in range(60)])
    assert paths.diameter(path, nodes(spark, range(61))).first().diameter == 60
    assert paths.diameter(path, nodes(spark, range(62))).first().diameter is None


def test_components_of_thinned_edges(spark, monkeypatch):
    from mosaiq.operators import components

    monkeypatch.setattr(components, "BLOCK", 100)
    monkeypatch.setattr(components, "HELD", 150)
    e = spark.range(3000).selectExpr("id % 1000 * 2 u", "(id % 1000 * 2 + 2 * (1 + id div 1000)) % 2000 v").union(spark.createDataFrame([(5, 5)], "u long, v long"))
    for one_task in (500_000, 10):
        got = {r.node: r.component for r in components.components(e, spark.range(8).toDF("node"), one_task).collect()}
        assert got == {0: 0, 2: 0, 4: 0, 6: 0, 1: 1, 3: 3, 5: 5, 7: 7}


def test_entropy_of_parallel_edges(spark):
    import math

    # Two ways of an edge and a loop: the least weight counts, a missing one is 1.
    e = edges(spark, [(1, 2, 9.0), (2, 1, 3.0), (2, 3, None), (3, 3, 5.0)])
    p = [math.exp(-0.002 * w) for w in (3.0, 1.0)]
    h = [-x * math.log(x + 1e-10) for x in (1.0, 1.0, p[0] / sum(p), p[1] / sum(p))]
    assert graph.movement_entropy(e, nodes(spark, [1, 2, 3])).first().entropy == pytest.approx(sum(h) / 3)
    assert graph.total_entropy(e, nodes(spark, [1, 2, 3])).first().total == pytest.approx(sum(h) / 3 + 2 / 3)
    # Over 16,384 nodes, which went by joins of all pairs.
    star = spark.range(1, 17_000).selectExpr("0L u", "id v", "1.0D weight")
    assert graph.total_entropy(star, spark.range(17_000).toDF("node")).first().total > 0


def test_resistance_of_a_matrix_in_a_file(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(8)
    rows = {(min(a, b), max(a, b)): float(rng.uniform(1, 9)) for a, b in rng.integers(0, 40, (150, 2)).tolist() if a != b} | {(k, k + 1): 2.0 for k in range(39)}
    e = edges(spark, [(u, v, w) for (u, v), w in rows.items()] + [(100, 101, 4.0)])
    lap = np.zeros((40, 40))
    for (u, v), w in rows.items():
        lap[[u, v, u, v], [u, v, v, u]] += np.array([1, 1, -1, -1]) / w
    p = np.linalg.pinv(lap)
    monkeypatch.setattr(graph, "GROUNDED", 10)
    monkeypatch.setattr(graph, "SLAB", 8 * 40 * 7)
    asked = spark.createDataFrame([(a, b) for a in range(0, 40, 3) for b in range(1, 40, 2) if a != b] + [(100, 101), (39, 100), (39, 5), (5, 39)], "u long, v long")
    got = {(r.u, r.v): r.r for r in graph.effective_resistance(e, asked).collect()}
    assert got.pop((39, 100)) is None and got.pop((100, 101)) == pytest.approx(4.0)
    assert len(got) > 200 and all(r == pytest.approx(p[u, u] + p[v, v] - 2 * p[u, v]) for (u, v), r in got.items())


def test_inverse_in_slabs(monkeypatch):
    import numpy as np

    monkeypatch.setattr(graph, "SLAB", 8 * 40 * 7)
    a = np.random.default_rng(3).uniform(0, 1, (40, 40))
    a = a + a.T
    np.fill_diagonal(a, 0)
    full = np.diag(a.sum(axis=1)) - a
    full[-1], full[:, -1], full[-1, -1] = 0, 0, 1
    m = graph.Filed(40)
    assert len(m.slabs()) == 6
    i, j = np.triu_indices(40, 1)
    m.put(i, j, -a[i, j])
    m.mirror(a.sum(axis=1))
    assert np.allclose(m.open(), full)
    m.invert()
    assert np.allclose(m.open(), np.linalg.inv(full))


def test_hops_of_more_nodes(spark, monkeypatch):
    # Over 16,384 nodes, where rounds of joins took over.
    monkeypatch.setattr(paths, "MOST_ROUNDS", 0)
    star = spark.range(1, 17_000).selectExpr("0L u", "id v", "1.0D weight")
    got = paths.distances(star, nodes(spark, [0, 5]), 3.0, None).groupBy("src", "d").count().collect()
    assert {(r.src, r.d): r["count"] for r in got} == {(0, 0.0): 1, (0, 1.0): 16_999, (5, 0.0): 1, (5, 1.0): 1, (5, 2.0): 16_998}
