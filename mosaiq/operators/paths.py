"""Shortest paths: searches in tasks, rounds of relaxation joins over edges too many for one, and a kernel for grids."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.components import components
from mosaiq.scratch import Scratch

MOST_ROUNDS = 10_000
#: Nodes of a component whose edges a task holds as bits, and the sources that it searches from.
BITS, SHARE = 65_536, 500
#: Tasks of a component, each with all its bits (512 MB at BITS nodes), edges that are sorted at once, and edges of a list.
PARTS, PACK, LIST = 4, 500_000, 100
#: Nodes and edges of a component that a task holds sorted by weight, and the sources that it searches from.
NODES, LINKS, SPAN = 16_384, 8_000_000, 1_000
#: Cells of a grid that is sent to the executors for path search (a side of at most 320 after downsampling).
GRID_CELLS = 320 * 320


class NoPath(ValueError):
    """There is no way between the two nodes."""


def symmetric(edges: DataFrame, weight: str | None = "weight") -> DataFrame:
    """(u, v, w) both ways, the least of parallel edges; loops go. Missing and zero weights are 1; no weight: hops."""
    w = F.lit(1.0) if weight is None else F.coalesce(F.nullif(F.col(weight).cast("double"), F.lit(0.0)), F.lit(1.0))
    one = edges.where("u <> v").select("u", "v", w.alias("w"))
    return one.union(one.select("v", "u", "w")).groupBy("u", "v").agg(F.min("w").alias("w"))


def distances(edges: DataFrame, sources: DataFrame, cutoff: float | None = None, weight: str | None = "weight", through: bool = False) -> DataFrame:
    """(src, dst, d) from each source (node) to all it reaches within the cutoff, itself at 0.

    Components of at most BITS nodes are searched in tasks for hops, over bits; those of at most NODES nodes and LINKS
    edges for weights (finite and above 0), over sorted edges. Else rounds of joins, in which
    only distances that fell in a round are relaxed in the next. through: adds `before`, the node
    before dst on a shortest path (the least such node on ties).
    """
    spark = edges.sparkSession
    cuts = Scratch(spark, "paths")
    if weight is None and not through and (got := _hops(edges, sources, cutoff)):
        return got
    hops = symmetric(edges, weight)
    hops = cuts.cut(hops if cutoff is None else hops.where(F.col("w") <= cutoff + 1e-12), "edges")
    if (weight is not None or through) and hops.where(~((F.col("w") > 0) & (F.col("w") < float("inf")))).isEmpty():
        comp = cuts.cut(components(hops.where("u < v"), sources.select("node").union(hops.select("u"))), "components")
        links = hops.where("u < v").groupBy(F.col("u").cast("long").alias("node")).agg(F.count(F.lit(1)).alias("links"))
        most = comp.join(links, "node", "left").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("links").alias("links")).agg(F.max("n").alias("n"), F.max("links").alias("links")).first()
        if (most.n or 0) <= NODES and (most.links or 0) <= LINKS:
            return _weighted(hops, comp, sources, cutoff, through)
    best = cuts.cut(sources.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("d"), F.lit(True).alias("new")).distinct(), "best")
    for _ in range(MOST_ROUNDS):
        step = best.where("new").join(hops, F.col("dst") == F.col("u")).select("src", F.col("v").alias("dst"), (F.col("d") + F.col("w")).alias("d"), F.lit(True).alias("new"))
        if cutoff is not None:
            step = step.where(F.col("d") <= cutoff + 1e-12)
        both = best.withColumn("new", F.lit(False)).union(step).groupBy("src", "dst").agg(F.min("d").alias("d"), F.min(F.when(~F.col("new"), F.col("d"))).alias("old"))
        best = cuts.cut(both.select("src", "dst", "d", (F.col("old").isNull() | (F.col("d") < F.col("old") - 1e-12)).alias("new")), "best")
        if best.where("new").isEmpty():
            out = best.select("src", "dst", "d")
            return _with_before(out, hops) if through else out
    raise RuntimeError("distances did not settle")


def _hops(edges: DataFrame, sources: DataFrame, cutoff: float | None, farthest: bool = False) -> DataFrame | None:
    """Distances in hops of components of at most BITS nodes, else None: a task holds a component's edges as bits, and searches from a share of its sources.

    farthest: (src, m, far), how many nodes a source reaches and how far the last is, instead.
    """
    cuts = Scratch(edges.sparkSession, "hops")
    one = edges.where("u <> v" if cutoff is None or cutoff + 1e-12 >= 1 else "false").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    one = cuts.cut(one, "edges")
    comp = cuts.cut(components(one), "ends")
    asked = cuts.cut(sources.select(F.col("node").cast("long").alias("node")).distinct(), "sources")
    comp = cuts.cut(comp.union(asked.join(comp, "node", "left_anti").select("node", F.col("node").alias("component"))), "components")
    parts = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).select("component", "n", F.least(F.lit(PARTS), F.ceil(F.col("n") / SHARE).cast("int")).alias("parts"))
    if (parts.agg(F.max("n").alias("n")).first().n or 0) > BITS:
        return None
    own = comp.join(parts, "component").select("component", "node", "parts")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges by component and block, in order, as lists that compress well."""
        held, n = [], 0
        for b in chain(it, [None]):
            if b is not None:
                held.append([b.column(i).to_numpy() for i in range(4)])
                n += b.num_rows
            if n >= PACK or b is None and n:
                c, p, u, v = (np.concatenate(x) for x in zip(*held, strict=True))
                by = np.lexsort((v, u, c))
                c, p, u, v = c[by], p[by], u[by], v[by]
                at = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (np.arange(1, len(c)) % LIST == 0)]))
                ends = pa.array(np.append(at, len(c)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c[at]), pa.array(p[at]), pa.ListArray.from_arrays(ends, pa.array(u)), pa.ListArray.from_arrays(ends, pa.array(v))], names=["component", "parts", "u", "v"])
                held, n = [], 0

    lists = one.join(own.withColumnRenamed("node", "u"), "u").select("component", "parts", "u", "v").mapInArrow(pack, "component long, parts int, u array<long>, v array<long>")
    single = F.array("node")
    rows = own.select("component", every, F.lit(0).alias("kind"), single.alias("u"), single.alias("v"))
    rows = rows.union(lists.select("component", every, F.lit(1), "u", "v"))
    rows = rows.union(own.join(asked, "node", "left_semi").select("component", F.pmod(F.xxhash64("node"), "parts").cast("int"), F.lit(2), single, single))

    def search(bits: np.ndarray, s: int) -> np.ndarray:
        n = len(bits)
        far, every_bit = np.full(n, -1), np.packbits(np.ones(n, bool))
        far[s], front, level = 0, np.array([s]), 0
        while len(front) and (cutoff is None or level + 1 <= cutoff + 1e-12):
            level += 1
            seen = np.packbits(far >= 0)
            for i in range(0, len(front), 64):
                seen |= np.bitwise_or.reduce(bits[front[i : i + 64]], axis=0)
                if np.array_equal(seen, every_bit):
                    break
            front = np.flatnonzero(np.unpackbits(seen, count=n).astype(bool) & (far < 0))
            far[front] = level
        return far

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, bits = None, [], None
        for b in it:
            c, part, kind = (b.column(i).to_numpy() for i in range(3))
            at = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])]))
            for s, e in zip(at, [*at[1:], len(c)], strict=True):
                u, v = (b.column(i).slice(s, e - s).flatten().to_numpy() for i in (3, 4))
                if (c[s], part[s]) != now:
                    now, ids, bits = (c[s], part[s]), [], None
                if kind[s] == 0:
                    ids.append(u)
                    continue
                if bits is None:
                    ids = np.sort(np.concatenate(ids))
                    bits = np.zeros((len(ids), (len(ids) + 7) // 8), np.uint8)
                i = np.searchsorted(ids, u)
                if kind[s] == 1:
                    j = np.searchsorted(ids, v)
                    for q in range(0, len(i), PACK):
                        for x, y in ((i[q : q + PACK], j[q : q + PACK]), (j[q : q + PACK], i[q : q + PACK])):
                            np.bitwise_or.at(bits, (x, y >> 3), (128 >> (y & 7)).astype(np.uint8))
                    continue
                if farthest:
                    m = [(int((x >= 0).sum()), float(x.max())) for x in (search(bits, int(k)) for k in i)]
                    yield pa.RecordBatch.from_arrays([pa.array(u), *(pa.array(list(x)) for x in zip(*m, strict=True))], names=["src", "m", "far"])
                    continue
                for k in i:
                    far = search(bits, int(k))
                    to = np.flatnonzero(far >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), ids[k])), pa.array(ids[to]), pa.array(far[to].astype(float))], names=["src", "dst", "d"])

    dealt = rows.repartitionByRange("component", "part").sortWithinPartitions("component", "part", "kind")
    return dealt.mapInArrow(run, "src long, m long, far double" if farthest else "src long, dst long, d double")


class Links:
    """A component's edges, both ways, by node and then weight, for searches that leave out edges too heavy to matter."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, cutoff: float | None) -> None:
        self.n, self.most = n, np.inf if cutoff is None else cutoff + 1e-12
        self.values, code = np.unique(w, return_inverse=True)
        # Node, rank of the weight and other end in one key; n * n * ranks is far below 2**63.
        self.ranks = len(self.values)
        self.keys = np.concatenate([(i * self.ranks + code) * n + j, (j * self.ranks + code) * n + i])
        self.keys.sort()
        self.to, self.rank = (self.keys % n).astype(np.int32), (self.keys // n % max(1, self.ranks)).astype(np.int32)
        self.start = np.searchsorted(self.keys, np.arange(n, dtype=np.int64) * self.ranks * n)
        # The width of a step: within the least weight distances are final; a node in a wider one may be taken again.
        self.width = max(self.values[0], w.mean() * n / len(self.keys)) if self.ranks else 1.0
        self.within = np.full(n, np.inf)
        if self.ranks and cutoff is None:
            root = self.far(int(np.argmax(np.diff(self.start, append=len(self.keys)))))
            self.within = (root + root.max()) * (1 + 1e-9)

    def light(self, u: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(at, place of the edge) of the edges of u[at] that weigh no more than room[at]."""
        rank = np.searchsorted(self.values, room, "right")
        stop = np.searchsorted(self.keys, (u * self.ranks + rank) * self.n)
        m = stop - self.start[u]
        return np.repeat(np.arange(len(u)), m), np.arange(m.sum()) + np.repeat(self.start[u] - (np.cumsum(m) - m), m)

    def far(self, s: int) -> np.ndarray:
        """Distances from s, inf beyond the cutoff."""
        d, left = np.full(self.n, np.inf), np.zeros(self.n, bool)
        d[s], left[s] = 0, self.ranks > 0
        while len(u := np.flatnonzero(left)):
            u = u[d[u] <= d[u].min() + self.width]
            left[u] = False
            # No way longer than the longest so far, or than the one by the root, is a shortest one.
            top = min(d.max(), self.within[s], self.most)
            at, edge = self.light(u, (top - d[u]) + 1e-9 * (1 + (top if top < np.inf else 0)))
            new, v = d[u][at] + self.values[self.rank[edge]], self.to[edge]
            less = (new < d[v]) & (new <= self.most)
            np.minimum.at(d, v[less], new[less])
            left[v[less]] = True
        return d

    def before(self, d: np.ndarray) -> np.ndarray:
        """The least node before each on a shortest way, -1 where there is none."""
        u = np.flatnonzero(d < np.inf)
        out = np.full(self.n, self.n)
        if self.ranks:
            top = d[u].max()
            at, edge = self.light(u, (top - d[u]) + 2e-9 * (1 + top))
            v = self.to[edge]
            on = np.abs(d[u][at] + self.values[self.rank[edge]] - d[v]) <= 1e-9
            np.minimum.at(out, v[on], u[at[on]])
        return np.where(out < self.n, out, -1)


def _weighted(hops: DataFrame, comp: DataFrame, sources: DataFrame, cutoff: float | None, through: bool) -> DataFrame:
    """Distances by weight in components of at most BITS nodes and LINKS edges: a task holds a component's edges, and searches from a share of its sources."""
    mine = comp.join(sources.select(F.col("node").cast("long").alias("node")).distinct(), "node", "left_semi")
    parts = mine.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / SPAN).cast("int").alias("parts"))
    own = comp.join(parts, "component").select("component", "node", "parts")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    none = F.lit(None).cast("array<struct<v:bigint,w:double>>").alias("to")
    # A node's edges come in some lists, which are dealt instead of single edges.
    lists = hops.where("u < v").groupBy(F.col("u").cast("long").alias("node"), F.pmod(F.xxhash64("v"), F.lit(16))).agg(F.collect_list(F.struct(F.col("v").cast("long").alias("v"), "w")).alias("to"))
    rows = own.select("component", every, F.lit(0).alias("kind"), "node", none)
    rows = rows.union(lists.join(own, "node").select("component", every, F.lit(1), "node", "to"))
    rows = rows.union(mine.join(parts, "component").select("component", F.pmod(F.xxhash64("node"), "parts").cast("int"), F.lit(2), "node", none))
    schema = "src long, dst long, d double" + (", before long" if through else "")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, ends, links = None, [], [], None
        for b in it:
            c, part, kind, node = (b.column(i).to_numpy() for i in range(4))
            at = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])]))
            for s, e in zip(at, [*at[1:], len(c)], strict=True):
                if (c[s], part[s]) != now:
                    now, ids, ends, links = (c[s], part[s]), [], [], None
                if kind[s] == 0:
                    ids.append(node[s:e])
                    continue
                if isinstance(ids, list):
                    ids = np.sort(np.concatenate(ids))
                if kind[s] == 1:
                    to = b.column(4).slice(s, e - s)
                    flat, i = to.flatten(), np.searchsorted(ids, node[s:e])
                    ends.append((np.repeat(i, to.value_lengths().to_numpy()).astype(np.int32), np.searchsorted(ids, flat.field(0).to_numpy()).astype(np.int32), flat.field(1).to_numpy()))
                    continue
                if links is None:
                    i, j, w = (np.concatenate(x) for x in zip(*ends, strict=True)) if ends else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))
                    ends = []
                    links = Links(len(ids), i.astype(np.int64), j.astype(np.int64), w, cutoff)
                for k in np.searchsorted(ids, node[s:e]):
                    d = links.far(int(k))
                    to = np.flatnonzero(d < np.inf)
                    out = [pa.array(np.full(len(to), ids[k])), pa.array(ids[to]), pa.array(d[to])]
                    if through:
                        was = links.before(d)[to]
                        out.append(pa.array(ids[was], mask=was < 0))
                    yield pa.RecordBatch.from_arrays(out, names=["src", "dst", "d", "before"][: len(out)])

    dealt = rows.repartition("component", "part").sortWithinPartitions("component", "part", "kind")
    return dealt.mapInArrow(run, schema)


def _with_before(dist: DataFrame, hops: DataFrame) -> DataFrame:
    back = dist.alias("a").join(hops, F.col("a.dst") == F.col("v")).join(dist.select(F.col("src").alias("s2"), F.col("dst").alias("u"), F.col("d").alias("du")), ["u"]).where("src = s2")
    got = back.where(F.abs(F.col("du") + F.col("w") - F.col("d")) <= 1e-9).groupBy("src", "dst").agg(F.min("u").alias("before"))
    return dist.join(got, ["src", "dst"], "left")


def path(dist: DataFrame, src: int, dst: int) -> list[int]:
    """Nodes of a shortest path, from distances with `before`; one row per step is fetched."""
    mine, out = dist.where(F.col("src") == src), [dst]
    while out[-1] != src:
        row = mine.where(F.col("dst") == out[-1]).select("before").first()
        if row is None:
            raise NoPath(f"{src} to {dst}")
        out.append(row.before)
    return out[::-1]


def has_path(edges: DataFrame, sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst) of each source (node) and each node that a way leads to, itself included: the nodes of its component."""
    comp = components(edges, nodes)
    of = comp.join(sources.distinct(), "node", "left_semi").select(F.col("node").alias("src"), "component")
    return of.join(comp, "component").select("src", F.col("node").alias("dst"))


def diameter(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row `diameter` in hops, null if the graph is empty or not connected."""
    dist = _hops(edges, nodes, None, farthest=True)
    if dist is None:
        dist = distances(edges, nodes, weight=None).groupBy("src").agg(F.count(F.lit(1)).alias("m"), F.max("d").alias("far"))
    n = nodes.distinct().agg(F.count(F.lit(1)).alias("n"))
    return dist.agg(F.sum("m").alias("m"), F.max("far").alias("far")).crossJoin(n).select(F.when((F.col("n") > 0) & (F.col("m") == F.col("n") * F.col("n")), F.col("far").cast("long")).alias("diameter"))  # one row each


def grid_dijkstra(open_: np.ndarray, start: tuple[int, int], targets: set[tuple[int, int]], step: float = 1.0) -> dict[tuple[int, int], float]:
    """Distances over open cells in 8 directions, corners may be cut; ends when all targets are settled."""
    if not open_[start]:
        return {}
    moves = [(i, j, step * (2**0.5 if i and j else 1.0)) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    best, done, left, heap = {start: 0.0}, set(), set(targets), [(0.0, start)]
    found: dict[tuple[int, int], float] = {}
    while heap and left:
        d, at = heapq.heappop(heap)
        if at in done:
            continue
        done.add(at)
        if at in left:
            left.discard(at)
            found[at] = d
        for i, j, w in moves:
            n = at[0] + i, at[1] + j
            if 0 <= n[0] < open_.shape[0] and 0 <= n[1] < open_.shape[1] and open_[n] and d + w < best.get(n, float("inf")):
                best[n] = d + w
                heapq.heappush(heap, (d + w, n))
    return found


def grid_distances(mask: DataFrame, pairs: DataFrame, step: float = 1.0) -> DataFrame:
    """(i, j, d) for pairs (i, r1, c1, j, r2, c2) over a mask's cells, null where there is no way; spread over starting points.

    The mask, checked to be at most GRID_CELLS, is collected and sent to the executors.
    """
    cells = mask.select("row", "col").limit(GRID_CELLS + 1).toPandas()
    if len(cells) > GRID_CELLS:
        raise ValueError("the grid is too large: downsample it first")
    shape = (int(cells.row.max()) + 1, int(cells.col.max()) + 1) if len(cells) else (1, 1)
    open_ = np.zeros(shape, bool)
    open_[cells.row, cells.col] = True
    shared = mask.sparkSession.sparkContext.broadcast(open_)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        start = int(rows.r1.iloc[0]), int(rows.c1.iloc[0])
        ends = list(zip(rows.r2.astype(int), rows.c2.astype(int), strict=True))
        got = grid_dijkstra(shared.value, start, {e for e in ends if e[0] < shared.value.shape[0] and e[1] < shared.value.shape[1]}, step) if start[0] < shared.value.shape[0] and start[1] < shared.value.shape[1] else {}
        return pd.DataFrame({"i": rows.i, "j": rows.j, "d": [got.get(e) for e in ends]}).astype({"d": "float64"})

    out = pairs.groupBy("i", "r1", "c1").applyInPandas(run, "i int, j int, d double")
    return out.withColumn("d", F.when(~F.isnan("d"), F.col("d")))

