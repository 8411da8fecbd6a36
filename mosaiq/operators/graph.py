"""Graphs as edge tables (u, v, weight): structure, entropy, redundancy, and linear algebra by component."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.components import components
from mosaiq.operators.paths import symmetric
from mosaiq.scratch import Scratch

#: Nodes of a component for which one task holds a dense matrix.
DENSE = 4000
#: The same for a matrix that is inverted in its place; that of a larger component is inverted in a file.
GROUNDED = 10_000
#: Bytes of the rows that are held at once of a matrix in a file, of which four such parts are in use.
SLAB = 1 << 27
#: Edges that a task thins at once.
BLOCK = 500_000


def canonical(edges: DataFrame) -> DataFrame:
    """Edges with u < v; loops go."""
    return edges.where("u <> v").withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")})


def multigraph(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """(u, v, weight, multiplicity): the least of parallel edges, and how many there are."""
    return canonical(edges).groupBy("u", "v").agg(F.min(weight).alias("weight"), F.count(F.lit(1)).alias("multiplicity"))


def upsert(edges: DataFrame, changes: DataFrame, attrs: list[str]) -> DataFrame:
    """Later attributes, where not null, win: canonical edges with `changes` laid over them."""
    both = canonical(edges).withColumn("_s", F.lit(0)).unionByName(canonical(changes).withColumn("_s", F.lit(1)), allowMissingColumns=True)
    return both.groupBy("u", "v").agg(*[F.max_by(a, F.when(F.col(a).isNotNull(), F.col("_s"))).alias(a) for a in attrs])


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both ends of which are in (node)."""
    return edges.join(nodes.withColumnRenamed("node", "u"), "u", "left_semi").join(nodes.withColumnRenamed("node", "v"), "v", "left_semi")


def corridor_graph(corridors: DataFrame) -> DataFrame:
    """(u, v, weight) of corridors (p1, p2, distance_m); a missing distance is 1."""
    return corridors.select(F.col("p1").alias("u"), F.col("p2").alias("v"), F.coalesce("distance_m", F.lit(1.0)).alias("weight"))


def is_connected(edges: DataFrame, nodes: DataFrame) -> bool:
    """An empty graph is not connected."""
    return components(edges, nodes).select("component").distinct().count() == 1


def _by_component(edges: DataFrame, nodes: DataFrame | None, fn, schema: str) -> DataFrame:  # noqa: ANN001
    """applyInPandas of the edges of each component; a component too large for a dense task is an error."""
    comp = components(edges, nodes)
    own = edges.join(comp.withColumnRenamed("node", "u"), "u")
    return own.groupBy("component").applyInPandas(fn, schema)


def _tarjan(n: int, near: list[list[int]], single: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Bridges by lowest reachable order, without recursion."""
    order, low, out, t = [-1] * n, [0] * n, [], 0
    for root in range(n):
        if order[root] >= 0:
            continue
        stack = [(root, -1, iter(near[root]))]
        order[root] = low[root] = t
        t += 1
        while stack:
            x, parent, rest = stack[-1]
            for y in rest:
                if order[y] < 0:
                    order[y] = low[y] = t
                    t += 1
                    stack.append((y, x, iter(near[y])))
                    break
                if y != parent:
                    low[x] = min(low[x], order[y])
            else:
                stack.pop()
                if parent >= 0:
                    low[parent] = min(low[parent], low[x])
                    if low[x] > order[parent] and (min(x, parent), max(x, parent)) in single:
                        out.append((parent, x))
    return out


def _forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Which edges are in a spanning forest: each set takes its first edge to another one, until none leads out."""
    low, taken, open_ = np.arange(n), np.zeros(len(u), bool), np.arange(len(u))
    while True:
        a, b = low[u[open_]], low[v[open_]]
        out = a != b
        open_, a, b = open_[out], a[out], b[out]
        if not len(open_):
            return taken
        first, back = np.full(n, -1), np.arange(len(open_))[::-1]
        first[a[::-1]] = back  # of equal places the last one written stays
        other = np.full(n, len(open_))
        other[b[::-1]] = back
        first = np.minimum(np.where(first < 0, len(open_), first), other)
        at = np.unique(first[first < len(open_)])
        taken[open_[at]] = True
        while True:
            m = np.minimum(low[u[open_[at]]], low[v[open_[at]]])
            new = low.copy()
            np.minimum.at(new, low[u[open_[at]]], m)
            np.minimum.at(new, low[v[open_[at]]], m)
            while not np.array_equal(jump := new[new], new):
                new = jump
            if np.array_equal(new, low):
                break
            low = new


def sparse(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which edges are in a spanning forest or in one of what it leaves: of each cut two of them, if it has two."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    keep = _forest(a, b, len(ids))
    rest = np.flatnonzero(~keep)
    keep[rest[_forest(a[rest], b[rest], len(ids))]] = True
    return keep


def two_forests(edges: DataFrame) -> DataFrame:
    """(u, v): edges with the bridges and two-edge-connected components of all of them, at most two a node in a task.

    Each task thins its own edges in blocks; the second round thins what all tasks left. Parallel
    edges count as such; loops go.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, held, n, least = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0, BLOCK
        for last, b in _with_end(it):
            if b is not None:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
                n += b.num_rows
            if n >= least or last and n:
                u, v = (np.concatenate([x, *[h[i] for h in held]]) for i, x in enumerate((u, v)))
                keep = sparse(u, v)
                u, v, held, n = u[keep], v[keep], [], 0
                least = max(BLOCK, len(u))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    cuts = Scratch(edges.sparkSession, "forests")
    own = canonical(edges).select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).mapInArrow(run, "u long, v long")
    return cuts.cut(cuts.cut(own, "tasks").coalesce(1).mapInArrow(run, "u long, v long"), "all")


def _with_end(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch | None]]:
    for b in it:
        yield False, b
    yield True, None


def bridges(edges: DataFrame) -> DataFrame:
    """(u, v) of edges whose loss parts their component; parallel edges are none."""
    return _bridges(two_forests(edges))


def _bridges(few: DataFrame) -> DataFrame:
    multi = multigraph(few.withColumn("weight", F.lit(1.0)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate([rows.u, rows.v]), return_inverse=True)
        a, b = at[: len(rows)], at[len(rows) :]
        near: list[list[int]] = [[] for _ in ids]
        for x, y in zip(a, b, strict=True):
            near[x].append(int(y))
            near[y].append(int(x))
        single = {(min(x, y), max(x, y)) for x, y, m in zip(a.tolist(), b.tolist(), rows.multiplicity, strict=True) if m == 1}
        got = [(ids[x], ids[y]) for x, y in _tarjan(len(ids), near, single)]
        return pd.DataFrame({"u": [min(p) for p in got], "v": [max(p) for p in got]}, dtype="int64")

    return _by_component(multi, None, run, "u long, v long")


def two_edge_components(edges: DataFrame, nodes: DataFrame, k: int = 2) -> DataFrame:
    """(node, component) of the graph without its bridges; other k than 2 are refused."""
    if k != 2:
        raise ValueError("only k = 2 is defined")
    few = two_forests(edges)
    return components(few.distinct().join(_bridges(few), ["u", "v"], "left_anti"), nodes)


def redundancy(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row `rho2`: the share of node pairs that stay joined whatever edge is lost; 0 under 3 nodes."""
    s = two_edge_components(edges, nodes).groupBy("component").agg(F.count(F.lit(1)).alias("s"))
    n = F.sum("s")
    return s.agg(F.when(n < 3, 0.0).otherwise(F.coalesce(F.sum(F.col("s") * (F.col("s") - 1) / 2) / (n * (n - 1) / 2), F.lit(0.0))).alias("rho2"))


def _once(edges: DataFrame) -> DataFrame:
    """(u, v, weight) with u < v: the least of parallel edges; missing and zero weights are 1."""
    return canonical(edges.select("u", "v", F.coalesce(F.nullif(F.col("weight").cast("double"), F.lit(0.0)), F.lit(1.0)).alias("weight"))).groupBy("u", "v").agg(F.min("weight").alias("weight"))


def movement_entropy(edges: DataFrame, nodes: DataFrame, alpha: float = 0.002) -> DataFrame:
    """One row `entropy`: mean over all nodes of the entropy of moves, weighted exp(-alpha d)."""
    cuts = Scratch(edges.sparkSession, "entropy")
    e = cuts.cut(_once(edges), "edges").select("u", "v", F.exp(-alpha * F.col("weight")).alias("e"))
    sums = cuts.cut(e.select("u", "e").union(e.select("v", "e")).groupBy("u").agg(F.sum("e").alias("s")), "sums")
    for k in "uv":
        e = e.join(sums.select(F.col("u").alias(k), F.col("s").alias(f"s{k}")), k)
    h = [-p * F.ln(p + 1e-10) for p in (F.col("e") / F.col("su"), F.col("e") / F.col("sv"))]
    total = e.agg(F.coalesce(F.sum(h[0] + h[1]), F.lit(0.0)).alias("h"))
    n = nodes.distinct().agg(F.count(F.lit(1)).alias("n"))
    return total.crossJoin(n).select(F.when(F.col("n") > 0, F.col("h") / F.col("n")).otherwise(0.0).alias("entropy"))  # one row each


def topology(edges: DataFrame, nodes: DataFrame, once: bool = False) -> DataFrame:
    """One row: nodes, edges, components and the penalty max(0, E - (N - C)) for cycles. once: no edges are parallel or loops."""
    comp = components(edges, nodes).agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("component").alias("components"))
    e = (edges if once else canonical(edges).select("u", "v").distinct()).agg(F.count(F.lit(1)).alias("edges"))
    return comp.crossJoin(e).select("nodes", "edges", "components", F.greatest(F.lit(0), F.col("edges") - (F.col("nodes") - F.col("components"))).cast("double").alias("penalty"))  # one row each


def total_entropy(edges: DataFrame, nodes: DataFrame, alpha: float = 0.002, by_component: float = 1.0, by_topology: float = 1.0, by_disturbance: float = 1.0) -> DataFrame:
    """One row `total`: movement entropy and the weighted penalties for parts, cycles and extent."""
    from mosaiq.operators.paths import diameter

    edges = Scratch(edges.sparkSession, "total").cut(_once(edges), "edges")
    rows = movement_entropy(edges, nodes, alpha).crossJoin(topology(edges, nodes, True)).crossJoin(diameter(edges, nodes))  # one row each
    spread = F.when(F.col("nodes") < 2, 0.0).otherwise(F.coalesce(F.col("diameter") / F.col("nodes"), F.lit(1.0)))
    return rows.select((F.col("entropy") + by_component * (F.col("components") - 1) + by_topology * F.col("penalty") + by_disturbance * spread).alias("total"))


def laplacian(edges: DataFrame) -> DataFrame:
    """(i, j, value) with the weights as conductances, at least 1e-9."""
    w = symmetric(edges).select("u", "v", F.greatest("w", F.lit(1e-9)).alias("w"))
    return w.select(F.col("u").alias("i"), F.col("v").alias("j"), (-F.col("w")).alias("value")).union(w.groupBy("u").agg(F.sum("w")).select("u", "u", "sum(w)"))


def dense_laplacian(u: np.ndarray, v: np.ndarray, conductance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    if len(ids) > DENSE:
        raise ValueError(f"a component of {len(ids)} nodes is too large for a dense matrix")
    a, b = at[: len(u)], at[len(u) :]
    m = np.zeros((len(ids), len(ids)))
    np.add.at(m, (a, b), -conductance)
    np.add.at(m, (b, a), -conductance)
    m[np.arange(len(ids)), np.arange(len(ids))] = 0
    np.fill_diagonal(m, -m.sum(axis=1))
    return ids, m


def algebraic_connectivity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row `lambda2`; 0 for under 2 nodes or an unconnected graph."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, m = dense_laplacian(rows.u.to_numpy(), rows.v.to_numpy(), np.maximum(rows.w.to_numpy(), 1e-9))
        return pd.DataFrame({"n": [len(ids)], "l2": [float(np.linalg.eigvalsh(m)[1])]})

    one = symmetric(edges).where("u < v")
    got = _by_component(one, None, run, "n long, l2 double")
    n = nodes.distinct().agg(F.count(F.lit(1)).alias("all"))
    return n.crossJoin(got.agg(F.max("n").alias("n"), F.max_by("l2", "n").alias("l2"))).select(F.when((F.col("n") == F.col("all")) & (F.col("all") >= 2), F.greatest(F.lit(0.0), F.col("l2"))).otherwise(0.0).alias("lambda2"))  # one row each


def resistance_score(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row `score`: 1 / (n trace of the pseudo-inverse), weights as conductances; 0 unless connected."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, m = dense_laplacian(rows.u.to_numpy(), rows.v.to_numpy(), np.maximum(rows.w.to_numpy(), 1e-9))
        return pd.DataFrame({"n": [len(ids)], "s": [1.0 / (len(ids) * float(np.trace(np.linalg.pinv(m))))]})

    got = _by_component(symmetric(edges).where("u < v"), None, run, "n long, s double")
    n = nodes.distinct().agg(F.count(F.lit(1)).alias("all"))
    return n.crossJoin(got.agg(F.max("n").alias("n"), F.max_by("s", "n").alias("s"))).select(F.when(F.col("n") == F.col("all"), F.col("s")).otherwise(0.0).alias("score"))  # one row each


def inverse(m: np.ndarray) -> np.ndarray:
    """The inverse of a positive definite matrix, in its place, by blocks."""
    n = len(m)
    for s in range(0, n, 256):
        e = min(n, s + 256)
        p = np.linalg.inv(m[s:e, s:e])
        row = p @ m[s:e]
        col = m[:, s:e].copy()
        for r in range(0, n, 1024):
            m[r : r + 1024] -= col[r : r + 1024] @ row
        row[:, s:e] = p
        m[:, s:e] = -col @ p
        m[s:e] = row
    return m


class Filed:
    """A symmetric matrix in a temporary file, of which a few slabs of rows are held at once."""

    def __init__(self, n: int) -> None:
        self.n, self.step, self.file = n, max(1, SLAB // (8 * n)), tempfile.TemporaryFile()
        self.file.truncate(8 * n * n)

    def open(self) -> np.ndarray:
        # Opened for each slab, so that what was read does not stay in the task's memory.
        return np.memmap(self.file, np.float64, "r+", shape=(self.n, self.n))

    def slabs(self) -> list[slice]:
        return [slice(s, min(self.n, s + self.step)) for s in range(0, self.n, self.step)]

    def put(self, i: np.ndarray, j: np.ndarray, x: np.ndarray) -> None:
        self.open()[i, j] = x

    def mirror(self, diagonal: np.ndarray) -> None:
        """The lower half, from the upper one; the last node is the ground."""
        for r in self.slabs():
            m = self.open()
            a = np.array(m[r])
            a[:, : r.start] = m[: r.start, r].T
            own = np.triu(a[:, r], 1)
            a[:, r] = own + own.T + np.diag(diagonal[r])
            a[:, -1] = 0
            if r.stop == self.n:
                a[-1], a[-1, -1] = 0, 1
            m[r] = a

    def invert(self) -> None:
        """As `inverse`, slab by slab."""
        for at in self.slabs():
            a = np.array(self.open()[at])
            p = np.linalg.inv(a[:, at])
            row = p @ a
            for r in self.slabs():
                if r != at:
                    m = self.open()
                    a = np.array(m[r])
                    col = a[:, at].copy()
                    a -= col @ row
                    a[:, at] = -col @ p
                    m[r] = a
            row[:, at] = p
            self.open()[at] = row

    def answers(self, i: np.ndarray, j: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        last = self.n - 1  # the ground is at 0
        own = np.where((i == last) | (j == last), 0.0, self.open()[i, j])
        return diagonal[i] + diagonal[j] - 2 * own


def effective_resistance(edges: DataFrame, pairs: DataFrame, cost: str = "weight") -> DataFrame:
    """(u, v, r) of pairs in one component, conductance 1 / cost; r is null across components.

    A component's task reads first its nodes, then its edges into a matrix, and answers the pairs
    batch by batch from its inverse, so it holds the matrix only (800 MB at GROUNDED nodes). The matrix
    of a larger component lies in a temporary file (8 bytes a pair of nodes), of which slabs are held.
    """
    cuts = Scratch(edges.sparkSession, "resistance")
    one = cuts.cut(symmetric(edges, cost).where("u < v"), "edges")
    comp = cuts.cut(components(one), "components")
    cu, cv = (comp.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")) for k in "uv")
    own = comp.select(F.col("component").alias("c"), F.lit(0).alias("kind"), F.col("node").alias("u"), F.col("node").alias("v"), F.lit(0.0).alias("w"))
    links = one.join(cu, "u").select(F.col("cu").alias("c"), F.lit(1).alias("kind"), F.col("u").cast("long"), F.col("v").cast("long"), "w")
    asked = pairs.select("u", "v").distinct().join(cu, "u").join(cv, "v").where("cu = cv").select(F.col("cu").alias("c"), F.lit(2).alias("kind"), F.col("u").cast("long"), F.col("v").cast("long"), F.lit(0.0).alias("w"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, m, solved, diagonal = None, [], None, False, np.zeros(0)
        for b in it:
            c, kind, u, v, w = (b.column(i).to_numpy() for i in range(5))
            at = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (kind[1:] != kind[:-1])]))
            for s, e in zip(at, [*at[1:], len(c)], strict=True):
                if c[s] != now:
                    now, ids, m, solved = c[s], [], None, False
                if kind[s] == 0:
                    ids.append(u[s:e])
                    continue
                if m is None:
                    ids = np.sort(np.concatenate(ids))
                    m = Filed(len(ids)) if len(ids) > GROUNDED else np.zeros((len(ids), len(ids)))
                    diagonal = np.zeros(len(ids))
                i, j = np.searchsorted(ids, u[s:e]), np.searchsorted(ids, v[s:e])
                if kind[s] == 1:
                    g = 1.0 / np.maximum(w[s:e], 1e-9)
                    np.add.at(diagonal, i, g)
                    np.add.at(diagonal, j, g)
                    if isinstance(m, Filed):
                        m.put(i, j, -g)  # u < v
                    else:
                        m[i, j] = m[j, i] = -g  # each pair once
                    continue
                if not solved and isinstance(m, Filed):
                    m.mirror(diagonal)
                    m.invert()
                    diagonal = np.array(m.open().diagonal())
                    diagonal[-1], solved = 0, True
                elif not solved:
                    np.fill_diagonal(m, diagonal)
                    m[-1], m[:, -1] = 0, 0  # the last node is the ground
                    m[-1, -1] = 1
                    m, solved = inverse(m), True
                    m[-1, -1] = 0
                r = m.answers(i, j, diagonal) if isinstance(m, Filed) else m[i, i] + m[j, j] - 2 * m[i, j]
                yield pa.RecordBatch.from_arrays([pa.array(u[s:e]), pa.array(v[s:e]), pa.array(r)], names=["u", "v", "r"])

    got = own.union(links).union(asked).repartition("c").sortWithinPartitions("c", "kind", "u").mapInArrow(run, "u long, v long, r double")
    return pairs.select("u", "v").distinct().join(got, ["u", "v"], "left")


def mean_resistance(edges: DataFrame, pairs: DataFrame, cost: str = "weight", scale: Column | None = None, weighted: bool = False) -> DataFrame:
    """One row `r`: mean effective resistance over pairs (u, v, euclid[, weight_pair]); a parted pair counts the penalty max(1, 20 max euclid), scaled if `scale` is given.

    weighted: by weight_pair, pairs of no positive weight left out; the penalty if none is left.
    """
    far = pairs.agg(F.greatest(F.lit(1.0), 20 * F.max("euclid")).alias("penalty"))
    rows = pairs.join(effective_resistance(edges, pairs, cost), ["u", "v"], "left").crossJoin(far)  # one row
    r = F.coalesce("r", F.col("penalty") * (F.lit(1.0) if scale is None else scale))
    if weighted:
        return rows.agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("weight_pair") > 0, r * F.col("weight_pair"))), F.sum(F.when(F.col("weight_pair") > 0, F.col("weight_pair")))), F.max("penalty")).alias("r"))
    return rows.agg(F.coalesce(F.avg(r), F.lit(0.0)).alias("r"))


def flow_resistance_index(pairs: DataFrame) -> DataFrame:
    """One row `fri` over (i, j, euclid, d): resistance of the graph of pairs with a way (conductance 1 / d), against the mean distance."""
    have = pairs.where("d > 0").select(F.col("i").cast("long").alias("u"), F.col("j").cast("long").alias("v"), F.col("d").alias("weight"))
    asked = pairs.select(F.col("i").cast("long").alias("u"), F.col("j").cast("long").alias("v"), "euclid")
    got = asked.join(effective_resistance(have, asked), ["u", "v"]).where("r is not null").agg(F.avg("r").alias("r"), F.avg("euclid").alias("eu"))
    return got.select(F.when(F.coalesce("eu", F.lit(0.0)) > 0, 1 / (1 + F.col("r") / F.col("eu"))).otherwise(0.0).alias("fri"))


def failure_probability(edges: DataFrame, k: int = 1, draws: int = 1000, seed: int = 7) -> DataFrame:
    """One row `p`: chance that the loss of k random edges parts a component; exact for k = 1, seeded draws else; 1 where m <= k."""
    edges = Scratch(edges.sparkSession, "failure").cut(edges.select("u", "v"), "edges")  # made once
    flat = canonical(edges).select("u", "v").distinct()
    m = flat.count()
    spark = edges.sparkSession
    if m <= k:
        return spark.range(1).select(F.lit(1.0).alias("p"))
    if k == 1:
        return bridges(edges).agg((F.count(F.lit(1)) / m).alias("p"))
    if m > 200_000:
        raise ValueError("too many edges to draw from in one task")
    rows = np.array(flat.orderBy("u", "v").collect(), dtype=np.int64)
    shared = spark.sparkContext.broadcast(rows)

    def run(it):  # noqa: ANN001, ANN202
        from mosaiq.operators.components import label

        e = shared.value
        before = len(np.unique(label(e[:, 0], e[:, 1])[1]))
        n = len(np.unique(e))
        for x in it:
            hits = 0
            for i in x["id"]:
                keep = np.delete(np.arange(len(e)), np.random.default_rng([seed, int(i)]).choice(len(e), k, replace=False))
                ids, low = label(e[keep, 0], e[keep, 1])
                hits += len(np.unique(low)) + n - len(ids) > before
            yield pd.DataFrame({"hits": [hits]})

    return spark.range(draws).mapInPandas(run, "hits long").agg((F.sum("hits") / draws).alias("p"))


def weighted_redundancy(edges: DataFrame, nodes: DataFrame, connected: float, gamma: float = 1.0, delta: float = 1.0, k: int = 1) -> DataFrame:
    """One row `wmr`: connected * (1 + gamma rho2) * (1 - delta p_fail)."""
    edges = Scratch(edges.sparkSession, "weighted").cut(edges.select("u", "v"), "edges")  # made once
    rows = redundancy(edges, nodes).crossJoin(failure_probability(edges, k, 20))  # one row each
    return rows.select((connected * (1 + gamma * F.col("rho2")) * (1 - delta * F.col("p"))).alias("wmr"))


def loop_score(dist: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (u, v, weight) with `score`: the way through the graph over the weight, 0 without a way."""
    ways = dist.select(F.col("src").alias("u"), F.col("dst").alias("v"), "d")
    return candidates.join(ways, ["u", "v"], "left").withColumn("score", F.coalesce(F.col("d") / F.greatest("weight", F.lit(1e-9)), F.lit(0.0))).drop("d")
