"""Narrow passages inside patches: distance transforms, passages, sub-patches and inner corridors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.scalars import disk_offsets, inner_corridor_resistance, passage_resistance
from mosaiq.operators.grid import ranked, shifted

#: Fixed values of the detector.
MIN_AREA, LEAST_WIDTH, WIDE_KEPT, ZONE, MOST, OFFSET = 40, 1.5, 4, 12, 3, 100_000


def distance_transform(inside: np.ndarray) -> np.ndarray:
    """Distance of each cell to the nearest cell outside the mask; the array's border is none. A row pass, then lower envelopes of parabolas along columns."""
    far = float(sum(inside.shape) ** 2 + 1)
    rows, cols = inside.shape
    g = np.where(inside, far, 0.0)
    for c in range(1, cols):
        g[:, c] = np.where(inside[:, c], np.minimum(g[:, c], g[:, c - 1] + 1), 0)
    for c in range(cols - 2, -1, -1):
        g[:, c] = np.minimum(g[:, c], g[:, c + 1] + 1)
    return np.sqrt(_lower_envelopes(np.minimum(g, far) ** 2))


def _lower_envelopes(sq: np.ndarray) -> np.ndarray:
    """min over s of sq[s] + (r - s)^2 for each row r, all columns side by side.

    Each column holds the rows whose parabolas make its lower envelope, and from where on each is
    the lowest; a new row drops those that it undercuts over all of their range.
    """
    rows, cols = sq.shape
    owner, since = np.zeros((rows, cols), np.int64), np.full((rows + 1, cols), np.inf)
    since[0] = -np.inf
    top, every = np.zeros(cols, np.int64), np.arange(cols)
    for r in range(1, rows):
        busy = every
        at = np.empty(cols)
        while len(busy):
            s = owner[top[busy], busy]
            at[busy] = (sq[r, busy] + r * r - sq[s, busy] - s * s) / (2 * (r - s))
            busy = busy[at[busy] <= since[top[busy], busy]]
            top[busy] -= 1
        top += 1
        owner[top, every], since[top, every] = r, at
        since[top + 1, every] = np.inf
    out, top = np.empty_like(sq), np.zeros(cols, np.int64)
    for r in range(rows):
        while (ahead := since[top + 1, every] < r).any():
            top += ahead
        s = owner[top, every]
        out[r] = sq[s, every] + (r - s) ** 2
    return out


def label_grid(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Labels from 1 in the order of first cells."""
    from mosaiq.operators.components import label

    ids = np.where(mask, np.arange(mask.size).reshape(mask.shape), -1)
    pairs = [(ids[:, :-1], ids[:, 1:]), (ids[:-1], ids[1:])]
    if diagonal:
        pairs += [(ids[:-1, :-1], ids[1:, 1:]), (ids[:-1, 1:], ids[1:, :-1])]
    u = np.concatenate([ids[mask], *[a[(a >= 0) & (b >= 0)] for a, b in pairs]])
    v = np.concatenate([ids[mask], *[b[(a >= 0) & (b >= 0)] for a, b in pairs]])
    out = np.zeros(mask.size, np.int64)
    if len(u):
        cells, low = label(u, v)
        out[cells] = np.unique(low, return_inverse=True)[1] + 1
    return out.reshape(mask.shape)


def passages(inside: np.ndarray, width: float = 2.0, min_fraction: float = 0.05, most: int = MOST, min_area: int = MIN_AREA) -> list[dict]:
    """Narrow bands that join two wide regions of a patch, the most severe first, one for each zone."""
    area = int(inside.sum())
    if area < min_area:
        return []
    dt = distance_transform(inside).astype(np.float32)
    own = dt[inside]
    if not np.isfinite(own).all() or (median := float(np.median(own))) < LEAST_WIDTH:
        return []
    p75 = float(np.percentile(own, 75))
    limit = max(1.05, min(width, 0.55 * median))
    wide, narrow = inside & (dt >= limit), inside & (dt < limit)
    regions, bands = label_grid(wide), label_grid(narrow)
    size = np.bincount(regions.ravel())
    ids = sorted((i for i in range(1, len(size)) if size[i] >= max(5, int(min_fraction * area))), key=lambda i: -size[i])[:WIDE_KEPT]
    if len(ids) < 2 or not narrow.any():
        return []

    def beside(i: int) -> set[int]:
        p = np.pad(regions == i, 1)
        near = np.zeros_like(inside)
        for dr in range(3):
            for dc in range(3):
                near |= p[dr : dr + inside.shape[0], dc : dc + inside.shape[1]]
        return set(np.unique(bands[near & narrow]).tolist()) - {0}

    borders = {i: beside(i) for i in ids}
    found = []
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            for b in sorted(borders[i] & borders[j]):
                cells = np.argwhere(bands == b)
                d = dt[bands == b]
                r, c = cells[int(d.argmin())]
                w = 2.0 * float(d.min())
                found.append({"row": int(r), "col": int(c), "width": w, "area_a": int(size[i]), "area_b": int(size[j]), "severity": max(0.0, min(1.0, 1 - w / max(2 * p75, 1.0))), "cells": [(int(p), int(q)) for p, q in cells]})
    found.sort(key=lambda f: -f["severity"])
    kept: dict[tuple[int, int], dict] = {}
    for f in found:
        kept.setdefault((f["row"] // ZONE, f["col"] // ZONE), f)
    return list(kept.values())[:most]


def detect(labelled: DataFrame, width: float = 2.0, min_area: int = MIN_AREA, most: int = MOST) -> DataFrame:
    """(patch_id, k, row, col, width, area, area_a, area_b, severity, cells) of the passages of each patch of (row, col, patch_id); a patch is held in one task."""
    big = labelled.groupBy("patch_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_area).select("patch_id")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(rows.row.min()) - 1, int(rows.col.min()) - 1
        m = np.zeros((int(rows.row.max()) - r0 + 2, int(rows.col.max()) - c0 + 2), bool)
        m[rows.row - r0, rows.col - c0] = True
        got = passages(m, width, most=most, min_area=min_area)
        # Zones and places count from the grid's corner.
        out = [(int(rows.patch_id.iloc[0]), k, f["row"] + r0, f["col"] + c0, f["width"], len(rows), f["area_a"], f["area_b"], f["severity"], [{"row": r + r0, "col": c + c0} for r, c in f["cells"]]) for k, f in enumerate(got)]
        return pd.DataFrame(out, columns=["patch_id", "k", "row", "col", "width", "area", "area_a", "area_b", "severity", "cells"])

    return labelled.join(big, "patch_id").groupBy("patch_id").applyInPandas(run, "patch_id int, k int, row int, col int, width double, area long, area_a long, area_b long, severity double, cells array<struct<row:int,col:int>>")


def decompose(table: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sub-patches, passages): patches (patch_id, cells) cut at their most severe passage into two nodes, numbered in patch order; the passage's cells are dealt half and half."""
    top = found.where("k = 0")
    base = table.agg(F.greatest(F.coalesce(F.max("patch_id"), F.lit(0)) + OFFSET, F.lit(OFFSET)).alias("_base"))
    cut = top.join(ranked(top, "patch_id", "_rank"), "patch_id").crossJoin(base)  # one row
    first = F.col("_base") + 2 * (F.col("_rank") - 1)
    rest = F.greatest(F.lit(0), F.col("area") - F.col("area_a") - F.col("area_b"))
    half = F.floor(rest / 2)
    cut = cut.withColumns({"node_a": first.cast("long"), "node_b": (first + 1).cast("long"), "size_a": F.col("area_a") + half, "size_b": F.col("area_b") + rest - half})
    whole = table.join(top, "patch_id", "left_anti").select(F.col("patch_id").cast("long").alias("node"), F.col("patch_id").alias("parent"), F.col("cells").cast("long").alias("size"))
    subs = whole.union(cut.select("node_a", "patch_id", "size_a")).union(cut.select("node_b", "patch_id", "size_b"))
    cost = F.greatest(F.size("cells"), F.lit(1))
    return subs, cut.select("node_a", "node_b", F.col("patch_id").alias("parent"), passage_resistance(cost, F.col("width")).alias("resistance"), cost.alias("bridge_cost"), "severity", "width", "row", "col", "cells")


def inner_candidates(edges: DataFrame, labelled: DataFrame, width: float = 1.0) -> DataFrame:
    """(parent, node_a, node_b, cost, resistance, cells): passages that hold a cell outside all patches, widened to a corridor. With the labels that the passages came from there are none."""
    c = edges.select("parent", "node_a", "node_b", "bridge_cost", F.explode("cells").alias("c")).select("parent", "node_a", "node_b", "bridge_cost", "c.row", "c.col")
    own = labelled.select("row", "col")
    keep = ["parent", "node_a", "node_b", "bridge_cost"]
    raw = c.join(own, ["row", "col"], "left_anti").groupBy(*keep).agg(F.collect_set(F.struct("row", "col")).alias("raw"))
    wide = shifted(c, disk_offsets(width), *keep).distinct().join(own, ["row", "col"], "left_anti").groupBy("node_a").agg(F.collect_set(F.struct("row", "col")).alias("wide"))
    both = raw.join(wide, "node_a", "left")
    cells = F.when(F.size("raw") > F.size("wide"), F.col("raw")).otherwise(F.col("wide"))
    return both.select("parent", "node_a", "node_b", F.greatest(F.lit(1), F.size(cells)).alias("cost"), inner_corridor_resistance(F.col("bridge_cost"), F.lit(width)).alias("resistance"), F.array_sort(cells).alias("cells"))


def to_parents(edges: DataFrame, subs: DataFrame) -> DataFrame:
    """Edges (u, v, ...) of sub-nodes as edges of their patches, with the sub-nodes kept as u_sub and v_sub."""
    p = lambda k: subs.select(F.col("node").alias(k), F.col("parent").cast("long").alias(f"_{k}"))
    out = edges.join(p("u"), "u", "left").join(p("v"), "v", "left").withColumns({"u_sub": F.col("u"), "v_sub": F.col("v")})
    return out.withColumns({"u": F.coalesce("_u", "u"), "v": F.coalesce("_v", "v")}).drop("_u", "_v")


def to_subnodes(ends: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidate ends (patch_id, row, col) with `node`: the half on whose side of the patch's passage the end lies, by the longer extent; the patch where it isn't cut."""
    e = edges.select(F.col("parent").alias("patch_id"), "node_a", "node_b", F.col("row").alias("_r"), F.col("col").alias("_c"))
    far = F.greatest(F.abs(F.col("row") - F.col("_r")), F.abs(F.col("col") - F.col("_c")))
    first = F.when(F.abs(F.col("row") - F.col("_r")) == far, F.col("row") < F.col("_r")).otherwise(F.col("col") < F.col("_c"))
    return ends.join(e, "patch_id", "left").withColumn("node", F.when(F.col("node_a").isNull(), F.col("patch_id").cast("long")).when(first, F.col("node_a")).otherwise(F.col("node_b"))).drop("node_a", "node_b", "_r", "_c")
