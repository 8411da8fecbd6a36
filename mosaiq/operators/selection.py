"""Choice of corridors under a budget: sequential kernels, one group for each scenario."""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict, deque
from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import chain, groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.scratch import Scratch

#: Overlap limits, shortcut ratios and multipliers of the utility strategy.
OVERLAP_REJECT, GLOBAL_REJECT, PRIOR_KEPT, PER_MID = 0.30, 0.60, 3, 25
RATIO_HIGH, RATIO_MID, MULT_HIGH, MULT_MID, MULT_LOW, NO_PATH = 3.0, 1.5, 0.9, 0.5, 0.1, 0.5
DOMINANCE, FLOOR, TINY = 1.35, 0.20, 0.01
REDUNDANT_PROBABILITY, REDUNDANT_FACTOR, LEAST_GAIN = 0.7, 0.25, 1e-12
#: Candidates that a task of the reach strategy gets at first, best of their own score first.
FIRST = 20_000

PICKS = "scenario_id string, pick_order int, cand_id long, corr_type string, score double, overlap_ratio double, cost double"


class Forest:
    """Sets with sizes (`unknown` where none is given); the larger set's root stays, the first's on ties."""

    def __init__(self, size: dict[int, float], unknown: float = 1.0) -> None:
        self.unknown = unknown
        self.up, self.size, self.count = {x: x for x in size}, dict(size), dict.fromkeys(size, 1)

    def root(self, x: int) -> int:
        if x not in self.up:
            self.up[x], self.size[x], self.count[x] = x, self.unknown, 1
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.up[b] = a
        self.size[a] += self.size[b]
        self.count[a] += self.count[b]
        return True


def _way(near: dict[int, dict[int, float]], a: int, b: int) -> float | None:
    """Shortest way, None without one."""
    best, heap = {a: 0.0}, [(0.0, a)]
    while heap:
        d, x = heapq.heappop(heap)
        if x == b:
            return d
        if d > best[x]:
            continue
        for y, w in near[x].items():
            if d + w < best.get(y, math.inf):
                best[y] = d + w
                heapq.heappush(heap, (d + w, y))
    return None


def _share(cells: frozenset[int], others: list[frozenset[int]]) -> float:
    """Greatest share of a candidate's cells in one of the others."""
    return max((len(cells & o) / len(cells) for o in others), default=0.0) if cells else 0.0


class Candidate(NamedTuple):
    id: int
    ps: list[int]
    cost: float
    length: float
    cells: frozenset[int]


class Utility:
    """Picks by score times the size of what a corridor joins, scored anew only when popped.

    The queue starts with plain scores, so the order of picks is not that of true scores: an entry
    whose score changed goes back in, and one that doesn't fit the budget is gone for good.
    """

    def __init__(self, sizes: dict[int, float], budget: float, ways: list[tuple[int, int, float]] = (), gate: float | None = None) -> None:
        self.left, self.gate = budget, gate
        self.forest = Forest(sizes, 0.0)
        self.near: dict[int, dict[int, float]] = defaultdict(dict)
        for u, v, n in ways:
            self.forest.join(u, v)
            self.near[u][v] = self.near[v][u] = n
        self.of_pair: dict[tuple[int, int], deque] = defaultdict(lambda: deque(maxlen=PRIOR_KEPT))
        self.all: list[frozenset[int]] = []
        self.taken: set[int] = set()
        self.picks: list[tuple] = []
        self.stats: Counter = Counter()

    @staticmethod
    def pair(k: Candidate) -> tuple[int, int]:
        s = sorted(set(k.ps))
        return (s[0], s[1]) if len(s) > 1 else (s[0], s[0]) if s else (0, 0)

    @staticmethod
    def length(k: Candidate) -> float:
        return k.length if k.length > 0 else k.cost

    def commit(self, k: Candidate, kind: str, score: float, overlap: float) -> None:
        ps = k.ps
        for p in ps[1:]:
            self.forest.join(ps[0], p)
            self.near[ps[0]][p] = self.near[p][ps[0]] = self.length(k)
        self.left -= k.cost
        self.of_pair[self.pair(k)].append(k.cells)
        if k.cells:
            self.all.append(k.cells)
        self.taken.add(k.id)
        self.stats[kind] += 1
        self.picks.append((len(self.picks) + 1, k.id, kind, float(score), float(overlap), float(k.cost)))

    def bridge(self, pairs: Iterator[tuple[float, float, int, int, Callable[[], tuple[Candidate, Candidate, int, int]]]]) -> None:
        """Pairs (score, cost, ids of both, what gives both and their ends a and c) in order of score; each half is committed on its own."""
        for score, cost, c1, c2, get in pairs:
            if self.left <= 0:
                return
            if cost > self.left or c1 in self.taken or c2 in self.taken:
                self.stats["bridge_rejected"] += 1
                continue
            first, second, a, c = get()
            if self.forest.root(a) == self.forest.root(c):
                self.stats["bridge_rejected"] += 1
                continue
            for k in (first, second):
                if k.cost <= self.left:
                    self.commit(k, "primary", score, 0.0)

    def multiplier(self, k: Candidate, roots: set[int]) -> tuple[float | None, float]:
        """(multiplier, overlap with the pair's earlier picks); None: rejected."""
        cells, pair = k.cells, self.pair(k)
        if len(roots) > 1:
            size = min(self.forest.size[r] for r in roots)
            return (size if size > 0 else 1.0), 0.0
        over_all = _share(cells, self.all)
        if over_all > GLOBAL_REJECT:
            return None, 0.0
        overlap = _share(cells, list(self.of_pair[pair]))
        if overlap > OVERLAP_REJECT:
            return TINY, overlap
        ps, n = k.ps, self.length(k)
        way = _way(self.near, ps[0], ps[-1]) if n > 0 else None
        ratio = None if way is None else way / max(n, 1e-9)
        if self.gate is not None and ratio is not None and ratio < self.gate:
            return None, 0.0
        m = MULT_LOW if n <= 0 else NO_PATH if ratio is None else MULT_HIGH if ratio >= RATIO_HIGH else MULT_MID if ratio >= RATIO_MID else MULT_LOW
        if over_all > 0:
            m *= max(FLOOR, 1 - over_all)
            if ratio is not None and ratio <= DOMINANCE:
                m = min(m, MULT_LOW / 2)
        return m, overlap

    def run(self, rows: Iterator[tuple[float, Candidate | None]]) -> None:
        """rows: (base score, candidate, or None for one that can't fit), best score first, read as far as the queue comes to them."""
        queue: list[tuple[float, int, float, Candidate]] = []
        n, fresh = 0, next(rows, None)
        while (queue or fresh) and self.left > 0:
            if fresh and (not queue or -fresh[0] <= queue[0][0]):
                (score, k), roi, fresh = (-fresh[0], fresh[1]), fresh[0], next(rows, None)
            else:
                score, _, roi, k = heapq.heappop(queue)
            if k is None or k.id in self.taken or k.cost > self.left or len(k.ps) < 2:
                self.stats["skipped"] += 1
                continue
            roots = {self.forest.root(p) for p in k.ps}
            m, overlap = self.multiplier(k, roots)
            if m is None:
                self.stats["rejected"] += 1
                continue
            new = roi * m
            if abs(new + score) > 1e-12:
                n += 1
                heapq.heappush(queue, (-new, n, roi, k))
                continue
            self.commit(k, "primary" if len(roots) > 1 else "wasteful" if m <= MULT_LOW else "redundant", new, overlap)


def _cells(candidates: DataFrame) -> Column:
    return F.col("overlap_cells").cast("array<bigint>") if "overlap_cells" in candidates.columns else F.lit(None).cast("array<bigint>")


def bridge_pairs(candidates: DataFrame, sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(scenario_id, score, total, c1, c2, a, c, seq): candidates that share a mid patch, with other ends and within the budget.

    For each mid the 25 of greatest base score (all, in given order, if no more) take part.
    """
    one = candidates.where("base_roi > 0 and cost > 0 and size(patch_ids) = 2").withColumn("cells", _cells(candidates))
    a, b = F.get("patch_ids", 0), F.get("patch_ids", 1)
    own = ["scenario_id", "cand_id", "seq", "cost", "base_roi", "length", "cells"]
    ends = one.select(*own, a.alias("mid"), b.alias("other"), F.lit(True).alias("ahead")).union(one.select(*own, b, a, F.lit(False)))
    by = W.partitionBy("scenario_id", "mid")
    top = ends.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("k", F.row_number().over(by.orderBy(F.desc("base_roi"), "seq"))).where(F.col("k") <= PER_MID)
    top = top.withColumn("k", F.when(F.col("n") > PER_MID, F.col("k")).otherwise(F.row_number().over(by.orderBy("seq"))))
    top = top.withColumn("mid_seq", F.min("seq").over(by)).drop("n")
    x = top.select("scenario_id", "mid", "mid_seq", F.col("k").alias("k1"), F.col("cand_id").alias("c1"), F.col("other").alias("a"), F.col("cost").alias("cost1"), F.col("length").alias("length1"), F.col("cells").alias("cells1"), F.col("ahead").alias("ahead1"))
    y = top.select("scenario_id", "mid", F.col("k").alias("k2"), F.col("cand_id").alias("c2"), F.col("other").alias("c"), F.col("cost").alias("cost2"), F.col("length").alias("length2"), F.col("cells").alias("cells2"), F.col("ahead").alias("ahead2"))
    both = x.join(y, ["scenario_id", "mid"]).where("k1 < k2 and a <> c").join(budgets, "scenario_id").withColumn("total", F.col("cost1") + F.col("cost2")).where("total > 0 and total <= budget")
    s = lambda k: sizes.select(F.col("patch_id").alias(k), F.col("size").alias(f"s_{k}"))
    both = both.join(s("a"), "a").join(s("c"), "c").where("s_a > 0 and s_c > 0")
    return both.select("scenario_id", (F.sqrt(F.col("s_a") * F.col("s_c")) / F.col("total")).alias("score"), "total", "c1", "c2", "a", "c", "mid_seq", "mid", "k1", "k2", *[f"{x}{i}" for i in (1, 2) for x in ("cost", "length", "cells", "ahead")])


def select_utility(candidates: DataFrame, sizes: DataFrame, budgets: DataFrame, bridges: bool = True, ways: DataFrame | None = None, gate: float | None = None, trace: bool = False) -> DataFrame:
    """Picks of every scenario. candidates: (scenario_id, cand_id, seq, patch_ids, cost, length, base_roi[, overlap_cells]); sizes: (patch_id, size); budgets: (scenario_id, budget).

    ways: (u, v, length) that exist before any pick. gate: a corridor inside a network is a pick
    only if the way there was is so many times as long. trace: instead of the picks, (scenario_id,
    reason, n): how many were picked of each kind, rejected and skipped.

    A scenario's task reads sizes, ways, pairs and candidates in this order, the last two best
    score first, and holds only what was picked or is to be scored again.
    """
    candidates = Scratch(candidates.sparkSession, "utility").cut(candidates.join(F.broadcast(budgets.select("scenario_id")), "scenario_id", "left_semi").where("base_roi > 0 and cost > 0"), "candidates")
    long, double = (lambda c: F.col(c).cast("long")), (lambda c: F.col(c).cast("double"))
    names = ["score", "s1", "s2", "s3", "s4", "cand1", "cand2", "cost1", "cost2", "length1", "length2", "cells1", "cells2", "ahead1", "ahead2", "total"]

    def of(df: DataFrame, kind: int, **have: Column) -> DataFrame:
        none = {"patch_ids": "array<bigint>"} | {n: "double" if n in ("score", "cost1", "cost2", "length1", "length2", "total") else "array<bigint>" if n.startswith("cells") else "boolean" if n.startswith("ahead") else "bigint" for n in names}
        return df.select(F.col("scenario_id"), F.lit(kind).alias("kind"), *[(have[n] if n in have else F.lit(0 if t == "bigint" else None)).cast(t).alias(n) for n, t in none.items()])

    used = candidates.select("scenario_id", F.explode(F.col("patch_ids").cast("array<bigint>")).alias("patch_id")).distinct()
    rows = of(used.join(sizes, "patch_id"), 0, s1=long("patch_id"), score=double("size"))
    if ways is not None:
        both = ways.crossJoin(F.broadcast(budgets.select("scenario_id")))  # few scenarios
        rows = rows.union(of(both, 1, s1=long("u"), s2=long("v"), length1=double("length")))
        ends = both.select("scenario_id", F.explode(F.array(F.col("u").cast("long"), F.col("v").cast("long"))).alias("patch_id")).distinct()
        rows = rows.union(of(ends.join(sizes, "patch_id"), 0, s1=long("patch_id"), score=double("size")))
    if bridges:
        pairs = bridge_pairs(candidates, sizes, budgets)
        rows = rows.union(of(pairs, 2, score=F.col("score"), s1=long("mid_seq"), s2=long("mid"), s3=long("k1"), s4=long("k2"), cand1=long("c1"), cand2=long("c2"), total=F.col("total"), patch_ids=F.array(F.col("a").cast("long"), F.col("c").cast("long")), **{n: F.col(n) for n in names[7:15]}))
    mine = candidates.withColumn("cells", _cells(candidates))
    mine = of(mine, 3, score=double("base_roi"), s1=long("seq"), cand1=long("cand_id"), cost1=double("cost"), length1=double("length"), patch_ids=F.col("patch_ids"), cells1=F.col("cells"))
    rows = rows.union(mine).join(F.broadcast(budgets), "scenario_id")

    out_schema = pa.schema([("scenario_id", pa.string()), ("reason", pa.string()), ("n", pa.int64())] if trace else [("scenario_id", pa.string()), ("pick_order", pa.int32()), ("cand_id", pa.int64()), ("corr_type", pa.string()), ("score", pa.float64()), ("overlap_ratio", pa.float64()), ("cost", pa.float64())])

    def pick(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: list = [None, math.inf]  # the scenario, and what is left of its budget

        def frames() -> Iterator[pd.DataFrame]:
            for b in it:
                if not trace:  # what doesn't fit what is left never will, and only a trace counts it
                    fits = pc.less_equal(pc.coalesce(b["total"], b["cost1"]), at[1].left if isinstance(at[1], Utility) else at[1])
                    b = b.filter(pc.or_(pc.or_(pc.less(b["kind"], 2), pc.fill_null(fits, False)), pc.not_equal(b["scenario_id"], at[0] or "")))
                if b.num_rows:
                    yield b.to_pandas()

        for scenario, parts in _by_scenario(frames()):
            at[:] = scenario, math.inf
            u: Utility | None = None
            size: dict[int, float] = {}
            known: list[tuple[int, int, float]] = []
            kinds = ((k, p[p.kind == k]) for p in parts for k in sorted(set(p.kind.tolist())))
            cells = lambda x: frozenset(map(int, x)) if x is not None else frozenset()

            def pairs_of(some: Iterator[tuple[int, pd.DataFrame]], cells: Callable = cells) -> Iterator[tuple]:
                for _, p in some:
                    p = p.reset_index(drop=True)
                    for i, (score, total, c1, c2) in enumerate(zip(p.score.tolist(), p.total.tolist(), p.cand1.astype("int64").tolist(), p.cand2.astype("int64").tolist(), strict=True)):

                        def get(p: pd.DataFrame = p, i: int = i, ids: tuple[int, int] = (c1, c2)) -> tuple[Candidate, Candidate, int, int]:
                            r = p.iloc[i]
                            mid, (a, c) = int(r.s2), map(int, r.patch_ids)
                            halves = [Candidate(k, [mid, x] if ahead else [x, mid], float(cost), float(n), cells(z)) for k, x, cost, n, z, ahead in ((ids[0], a, r.cost1, r.length1, r.cells1, r.ahead1), (ids[1], c, r.cost2, r.length2, r.cells2, r.ahead2))]
                            return *halves, a, c

                        yield score, total, c1, c2, get

            def rows_of(some: Iterator[tuple[int, pd.DataFrame]], u: Utility, cells: Callable = cells) -> Iterator[tuple]:
                for _, p in some:
                    ids, ps, ns, zs = p.cand1.astype("int64").tolist(), list(p.patch_ids), p.length1.tolist(), list(p.cells1)
                    for i, (roi, cost) in enumerate(zip(p.score.tolist(), p.cost1.tolist(), strict=True)):
                        if cost <= u.left:
                            yield roi, Candidate(ids[i], list(map(int, ps[i])), cost, ns[i], cells(zs[i]))
                        elif trace:
                            yield roi, None

            for kind, some in groupby(kinds, key=lambda x: x[0]):
                first = next(some)
                budget = float(first[1].budget.iloc[0])
                some = chain([first], some)
                if kind < 2:
                    for _, p in some:
                        if kind == 0:
                            size |= dict(zip(p.s1.astype("int64").tolist(), p.score.tolist(), strict=True))
                        else:
                            known += zip(p.s1.astype("int64").tolist(), p.s2.astype("int64").tolist(), p.length1.tolist(), strict=True)
                    continue
                u = u or Utility(size, budget, known, gate)
                at[1] = u
                if kind == 2:
                    u.bridge(pairs_of(some))
                else:
                    u.run(rows_of(some, u))
            out = [] if u is None else sorted(u.stats.items()) if trace else u.picks
            yield pa.RecordBatch.from_pylist([dict(zip(out_schema.names, (scenario, *x), strict=True)) for x in out], out_schema)

    schema = "scenario_id string, reason string, n long" if trace else PICKS
    return _in_order(rows, F.col("kind"), F.desc("score"), *[F.col(n) for n in names[1:5]]).mapInArrow(pick, schema)


def backbone(edges: pd.DataFrame, sizes: dict[int, float], budget: float, loop_fraction: float | None = 0.05, most_loops: int = 2) -> tuple[list[tuple[int, str]], Forest, float]:
    """Least spanning forest within the budget, then short loops.

    The first part ends at the first edge, cheapest first, that doesn't fit, even if it would close
    a circle. The second takes edges up to a share of the budget, at most `most_loops` inside a
    set as it is then, and ends at the first that doesn't fit.
    """
    ordered = edges.sort_values(["cost", "seq"], kind="stable")
    return grown(((e.cand_id, e.u, e.v, e.cost) for e in ordered.itertuples()), Forest(sizes), budget, loop_fraction, most_loops)


def grown(ordered: Iterator[tuple[int, int, int, float]], f: Forest, budget: float, loop_fraction: float | None, most_loops: int) -> tuple[list[tuple[int, str]], Forest, float]:
    """The backbone of edges (cand_id, u, v, cost) that come cheapest first. No more are taken than its two parts look at."""
    spent, out, seen = 0.0, [], []
    limit = budget * loop_fraction if loop_fraction else None
    for e in ordered:
        # The second part looks at no edge above its limit but for its end, and costs only rise.
        if limit is None or e[3] <= limit:
            seen.append(e)
        if spent + e[3] > budget:
            break
        if e[1] != e[2] and f.join(int(e[1]), int(e[2])):
            out.append((int(e[0]), "primary"))
            spent += e[3]
    # What the first part ended at doesn't fit, nor does anything after it.
    have, loops = {c for c, _ in out}, Counter()
    for c, u, v, cost in seen:
        if spent >= budget or c in have:
            continue
        if cost > budget - spent:
            break
        if u == v:
            continue
        a, b = f.root(int(u)), f.root(int(v))
        if a == b:
            if loops[a] >= most_loops:
                continue
            loops[a] += 1
        out.append((int(c), "redundant" if a == b else "primary"))
        spent += cost
        f.join(a, b)
    return out, f, spent


def _in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows of each scenario in one task, in an order, without being held: kernels read them batch by batch."""
    return rows.repartition("scenario_id").sortWithinPartitions("scenario_id", *order)


def _by_scenario(it: Iterator[pd.DataFrame]) -> Iterator[tuple[str, Iterator[pd.DataFrame]]]:
    """(scenario, its rows in batches). What the caller leaves of a scenario is skipped."""
    parts = (p for b in it for p in (b[m] for m in [b.scenario_id == s for s in b.scenario_id.unique()]))
    for s, some in groupby(parts, key=lambda p: p.scenario_id.iloc[0]):
        yield s, some


def select_backbone(candidates: DataFrame, budgets: DataFrame, loop_fraction: float = 0.05, most_loops: int = 2) -> DataFrame:
    """Picks of every scenario from (scenario_id, cand_id, seq, u, v, cost), read in the order of their costs up to the last that matters."""
    rows = candidates.join(F.broadcast(budgets), "scenario_id").where("cost <= budget").select("scenario_id", "cand_id", "seq", "u", "v", "cost", "budget")

    def pick(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for scenario, parts in _by_scenario(it):
            first = next(parts)
            cost: dict[int, float] = {}

            def ordered(first: pd.DataFrame = first, parts: Iterator[pd.DataFrame] = parts, cost: dict[int, float] = cost) -> Iterator[tuple]:
                for p in chain([first], parts):
                    for e in zip(p.cand_id.tolist(), p.u.tolist(), p.v.tolist(), p.cost.tolist(), strict=True):
                        cost[e[0]] = e[3]
                        yield e

            got, _, _ = grown(ordered(), Forest({}), float(first.budget.iloc[0]), loop_fraction, most_loops)
            yield pd.DataFrame([(scenario, i, c, kind, 1.0 / max(cost[c], 1e-9), 0.0, cost[c]) for i, (c, kind) in enumerate(got, 1)], columns=["scenario_id", "pick_order", "cand_id", "corr_type", "score", "overlap_ratio", "cost"])

    return _in_order(rows, F.col("cost"), F.col("seq")).mapInPandas(pick, PICKS)


Rows = dict[int, dict[int, float]]


class Reach:
    """Reachable habitat of a growing graph, updated edge by edge. Only distances within the cutoff are held, by node."""

    def __init__(self, ids: list[int], weight: list[float], dispersal: float) -> None:
        self.w = dict(zip(ids, map(float, weight), strict=True))
        self.alpha, self.cutoff = max(dispersal / 3, 1e-9), 3 * dispersal
        self.d: Rows = {x: {x: 0.0} for x in ids}

    def chance(self, d: float) -> float:
        return math.exp(-d / self.alpha) if d <= self.cutoff + 1e-12 else 0.0

    def value(self, d: Rows) -> float:
        return math.fsum(self.w[x] * self.w[y] * (1.0 if x == y else self.chance(n)) for x, row in d.items() for y, n in row.items())

    def changes(self, d: Rows, u: int, v: int, n: float) -> dict[tuple[int, int], float]:
        """Distances (of pairs both ways) that an edge of length n shortens."""
        out: dict[tuple[int, int], float] = {}
        for x, dx in d[u].items():
            row = d[x]
            for y, dy in d[v].items():
                new = dx + n + dy
                if new <= self.cutoff and new < row.get(y, math.inf) and new < out.get((x, y), math.inf):
                    out[x, y] = out[y, x] = new
        return out

    @staticmethod
    def laid(d: Rows, changes: dict[tuple[int, int], float]) -> Rows:
        new = dict(d)
        for x in {x for x, _ in changes}:
            new[x] = dict(d[x])
        for (x, y), n in changes.items():
            new[x][y] = n
        return new

    def with_edge(self, d: Rows, u: int, v: int, n: float) -> Rows:
        return self.laid(d, self.changes(d, u, v, n))

    def gain(self, ps: list[int], n: float) -> tuple[float, bool, dict[tuple[int, int], float]] | None:
        """(gain, whether an end was likely reached before, distances that change); None without a gain."""
        ps = sorted({p for p in ps if p in self.w})
        d, likely, all_ = self.d, False, {}
        for i, u in enumerate(ps):
            for v in ps[i + 1 :]:
                was = d[u].get(v, math.inf)
                likely |= was <= self.cutoff and math.exp(-was / self.alpha) > REDUNDANT_PROBABILITY
                got = self.changes(d, u, v, n)
                all_ |= got
                if len(ps) > 2:
                    d = self.laid(d, got)
        g = math.fsum(self.w[x] * self.w[y] * (self.chance(new) - self.chance(self.d[x].get(y, math.inf))) for (x, y), new in all_.items() if x != y)
        return (g, likely, all_) if g > LEAST_GAIN else None


def _two(task: Callable) -> Callable:
    """A function of two frames: Spark counts the parameters."""
    return lambda a, b: task(a, b)


def select_reach(candidates: DataFrame, nodes: DataFrame, budgets: DataFrame, dispersal: float, first: int = FIRST) -> DataFrame:
    """Greedy picks by gain in reachable habitat per cost. nodes: (node, raw_area, area).

    A candidate's score is that of its own patches until a pick touches one of them. So a scenario's
    task gets the `first` candidates by this score, and all that touch a picked patch. It says
    what else it must see (the candidates at more patches, or further ones within what is left), and is run again until it needs
    no more. Candidates of over two patches are all sent to it.
    """
    spark = candidates.sparkSession
    cuts, reach = Scratch(spark, "reach"), Reach([], [], dispersal)
    nodes = cuts.cut(nodes.select(F.col("node").cast("long").alias("node"), "area"), "nodes")
    w = lambda k: nodes.select(F.col("node").alias(k), F.col("area").alias(f"a{k}"))
    rows = candidates.join(F.broadcast(budgets), "scenario_id").where("cost > 0 and cost <= budget").select("scenario_id", "cand_id", "seq", F.array_distinct(F.col("patch_ids").cast("array<bigint>")).alias("ps"), "cost", "length")
    two = rows.where("size(ps) = 2").select("scenario_id", "cand_id", "seq", F.get("ps", 0).alias("u"), F.get("ps", 1).alias("v"), F.lit(None).cast("array<bigint>").alias("ps"), "cost", "length").join(w("u"), "u").join(w("v"), "v")
    two = two.where(F.col("length") <= reach.cutoff)
    many = rows.where("size(ps) > 2").select("scenario_id", "cand_id", "seq", *[F.lit(0).cast("long").alias(k) for k in "uv"], "ps", "cost", "length", *[F.lit(None).cast("double").alias(k) for k in ("au", "av")])
    rows = cuts.cut(two.unionByName(many), "rows").withColumn("base", 2 * F.col("au") * F.col("av") * F.exp(-F.col("length") / reach.alpha) / F.col("cost"))
    many = rows.where("ps is not null")

    def pick(key: tuple, rows: pd.DataFrame, used: pd.DataFrame, known: set[int], floors: list[tuple]) -> pd.DataFrame:
        rows = rows.drop_duplicates(["seq", "cand_id"]).sort_values("seq").reset_index(drop=True)
        used = used.sort_values("node")
        r, out = Reach([int(x) for x in used.node], list(used.area), dispersal), []
        (scenario, left), touched, more = key, set(), []
        cost, length, base, seq = rows.cost.to_numpy(float), rows.length.tolist(), rows.base.to_numpy(float), rows.seq.tolist()
        ps = [[int(u), int(v)] if x is None else list(map(int, x)) for u, v, x in zip(rows.u, rows.v, rows.ps, strict=True)]
        at: dict[int, list[int]] = defaultdict(list)
        for k, x in enumerate(ps):
            for p in x:
                at[p].append(k)
        # Scores that hold until a pick touches a patch of the candidate; others are taken anew.
        plain, gone = np.where(base * cost > LEAST_GAIN, base, -np.inf), np.zeros(len(rows), bool)
        anew = {k for k in range(len(rows)) if len(ps[k]) > 2}
        gains: dict[int, tuple | None] = {}
        while True:
            gone |= cost > left
            best = None
            k = int(np.argmax(np.where(gone, -np.inf, plain))) if len(rows) else 0
            if len(rows) and not gone[k] and plain[k] > -np.inf:
                best = plain[k], -seq[k], k
            anew = {k for k in anew if not gone[k]}
            for k in anew:
                if k not in gains:
                    gains[k] = r.gain(ps[k], length[k])
                if g := gains[k]:
                    s = g[0] * (REDUNDANT_FACTOR if g[1] else 1.0) / cost[k]
                    if best is None or (s, -seq[k]) > best[:2]:
                        best = s, -seq[k], k
            # What was not sent comes after the floor, unless it touches what was picked.
            floor = min(((s, -n) for most, s, n in floors if most >= left), default=None)
            if floor and floor[0] > -np.inf and (best is None or best[:2] < floor):
                more.append(left)
                break
            if best is None:
                break
            s, _, k = best
            g = gains.get(k) or r.gain(ps[k], length[k])
            r.d, left, gone[k] = r.laid(r.d, g[2]), left - cost[k], True
            new = {x for x, _ in g[2]} | set(ps[k])
            touched |= set(ps[k])
            # All of the network that it joined: ways between others may have changed with it.
            new |= {y for x in new for y in r.d.get(x, ())}
            for j in {j for x in new for j in at[x]}:
                plain[j] = -np.inf
                anew.add(j)
                gains.pop(j, None)
            out.append((scenario, len(out) + 1, int(rows.cand_id[k]), "redundant" if g[1] else "primary", float(s), 0.0, float(cost[k])))
        out += [(scenario, 0, x, "touch", 0.0, 0.0, 0.0) for x in sorted(touched - known)]
        out += [(scenario, 0, 0, "more", 0.0, 0.0, float(x)) for x in more]
        return pd.DataFrame(out, columns=[x.split()[0] for x in PICKS.split(", ")])

    results = []
    for scenario, budget in budgets.select("scenario_id", F.col("budget").cast("double")).collect():
        mine = rows.where(F.col("scenario_id") == scenario)
        known: set[int] = set()
        sent, floors = [many.where(F.col("scenario_id") == scenario)], []
        size, most = first, budget
        while True:
            if most is not None:
                # Of what fits, the first by score, and the place of the last one sent if there are others.
                near = mine.where((F.col("cost") <= most) & (F.col("base") * F.col("cost") > LEAST_GAIN)).orderBy(F.desc("base"), "seq")
                top = cuts.cut(near.limit(size), f"top-{len(sent)}")
                last = top.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("base", -F.col("seq"))).alias("last")).first()
                floors.append((most, last["last"][0], -last["last"][1]) if last.n == size else (most, float("-inf"), 0))
                sent.append(top)
            have = reduce(DataFrame.union, sent)
            used = have.select(F.explode(F.coalesce("ps", F.array("u", "v"))).alias("node")).distinct().join(nodes.select("node", "area"), "node")
            task = partial(pick, (scenario, budget), known=frozenset(known), floors=tuple(floors))
            got = cuts.cut(have.groupBy("scenario_id").cogroup(used.withColumn("of", F.lit(scenario)).groupBy("of")).applyInPandas(_two(task), PICKS), f"picks-{len(results)}")
            asks = got.where("pick_order = 0").collect()
            if not asks:
                results.append(got)
                break
            most = next((x.cost for x in asks if x.corr_type == "more"), None)
            if touch := sorted({x.cand_id for x in asks if x.corr_type == "touch"}):
                known |= set(touch)
                sent.append(cuts.cut(mine.where(F.col("u").isin(touch) | F.col("v").isin(touch)), f"touch-{len(sent)}"))
                most = None  # what is left may be otherwise with them
            elif any(f[0] == most for f in floors):
                size *= 8
    return reduce(DataFrame.union, results) if results else spark.createDataFrame([], PICKS)


def fill_budget(candidates: DataFrame, picks: DataFrame, budgets: DataFrame) -> DataFrame:
    """Further candidates, best base score first, that fit what the picks left of the budget (own specification)."""
    spent = picks.groupBy("scenario_id").agg(F.sum("cost").alias("spent"))
    rest = candidates.select("scenario_id", "cand_id", "seq", "base_roi", "cost").join(picks.select("scenario_id", "cand_id"), ["scenario_id", "cand_id"], "left_anti")
    rest = rest.join(budgets, "scenario_id").join(spent, "scenario_id", "left").withColumn("left", F.col("budget") - F.coalesce("spent", F.lit(0.0))).where((F.col("cost") > 0) & (F.col("cost") <= F.col("left"))).drop("budget", "spent")

    def fill(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for scenario, parts in _by_scenario(it):
            left, out = None, []
            for p in parts:
                left = float(p.left.iloc[0]) if left is None else left
                p = p[p.cost <= left]
                for cand, roi, cost in zip(p.cand_id.tolist(), p.base_roi.tolist(), p.cost.tolist(), strict=True):
                    if cost <= left:
                        left -= cost
                        out.append((scenario, len(out) + 1, cand, "fill", roi, 0.0, cost))
            yield pd.DataFrame(out, columns=["scenario_id", "pick_order", "cand_id", "corr_type", "score", "overlap_ratio", "cost"])

    return _in_order(rest, F.desc_nulls_last("base_roi"), F.col("seq")).mapInPandas(fill, PICKS)


def largest_network(picks: DataFrame, candidates: DataFrame, sizes: DataFrame) -> DataFrame:
    """The picks of each scenario in its network of greatest total patch size."""
    from mosaiq.operators.components import components

    e = picks.join(candidates.select("scenario_id", "cand_id", "patch_ids"), ["scenario_id", "cand_id"])
    # Nodes of different scenarios are kept apart by a number in the upper bits.
    order = e.select("scenario_id").distinct().withColumn("s", F.row_number().over(W.orderBy("scenario_id")).cast("long"))
    e = e.join(order, "scenario_id").withColumn("v", F.explode("patch_ids")).withColumns({"u": F.shiftleft("s", 40) + F.get("patch_ids", 0), "v": F.shiftleft("s", 40) + F.col("v")})
    comp = components(e)
    total = comp.withColumn("s", F.shiftright("node", 40)).withColumn("patch_id", F.col("node") - F.shiftleft("s", 40)).join(sizes, "patch_id").groupBy("s", "component").agg(F.sum("size").alias("size"))
    best = total.groupBy("s").agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("component"))
    keep = e.join(comp.withColumnRenamed("node", "u"), "u").join(best, ["s", "component"], "left_semi").select("scenario_id", "cand_id").distinct()
    return picks.join(keep, ["scenario_id", "cand_id"], "left_semi")
