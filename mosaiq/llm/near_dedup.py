"""Near-duplicate documents: minima of universal hashes, bands, verified signatures and full sets, components.

Documents with the same set of word shingles are one class, and only classes go on. A class's
signature is cut into bands; classes that agree on a band are candidates. Links are found from
stars within the bands' buckets, then between what is still apart, and confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm import textkernel as tk
from mosaiq.llm.common import batches
from mosaiq.llm.components import components, root
from mosaiq.scratch import Scratch

_U = np.uint64
#: Members of a bucket that one row holds; blocks of a bucket are compared with each other.
BLOCK = 512
#: Standard deviations of the estimate by which a candidate may fall short of the least similarity.
SLACK = 4.0
#: Bytes of sets of a block, or one set.
BLOCK_BYTES = 2_000_000


@dataclass(frozen=True)
class Params:
    """k-word shingles, least similarity (percent), bands and rows of a band."""

    k: int = 3
    percent: int = 85
    bands: int = 25
    rows: int = 5

    @property
    def size(self) -> int:
        return self.bands * self.rows


def _universal(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of n multiply-shift hashes of 64-bit keys."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, n, _U) | _U(1), rng.integers(0, 1 << 64, n, _U)


def sets_of(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct shingle hashes) of each row of a text column."""
    text = tk.binary(column)
    lengths = np.diff(tk.buffers(text)[1])
    for i, j in tk.steps(lengths):
        words = tk.Words(text.slice(i, j - i))
        h, bounds = tk.shingle_hashes(words.hashes(), words.bounds, k)
        for r in range(j - i):
            yield i + r, np.unique(h[bounds[r] : bounds[r + 1]])


def minima(found: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the least value of each hash; the set is taken in pieces."""
    best = np.full(len(mul), ~_U(0))
    with np.errstate(over="ignore"):
        for i in range(0, len(found), 2048):
            np.minimum(best, (found[i : i + 2048, None] * mul + add).min(axis=0), out=best)
    return (best >> _U(32)).astype(np.uint32)


def _signatures(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sig): two 64-bit sums stand for the set; sig is null for an empty set."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _universal(p.size)
        for b in batches(it):
            n, a, c, sig = [], [], [], []
            with np.errstate(over="ignore"):
                for _, s in sets_of(b.column(1), p.k):
                    n.append(len(s))
                    a.append(int(tk.mix(s).sum().astype(np.int64)))
                    c.append(int(tk.mix(s ^ _U(0xA5A5A5A55A5A5A5A)).sum().astype(np.int64)))
                    sig.append(minima(s, mul, add).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "set_a", "set_b", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, sig binary")


def _bands(classes: DataFrame, p: Params) -> DataFrame:
    """(bucket, rep): one row for each band of each class."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, p.bands, p.rows).astype(_U)
            with np.errstate(over="ignore"):
                h = np.broadcast_to(np.arange(1, p.bands + 1, dtype=_U), sig.shape[:2]).copy()
                for j in range(p.rows):
                    h = tk.mix(h * _U(0x9E3779B97F4A7C15) + sig[:, :, j])
            rep = np.repeat(b.column(0).to_numpy(), p.bands)
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(rep)], names=["bucket", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "bucket long, rep long")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two ascending distinct arrays, in whole numbers."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """(u, v, ok) of each pair: whether the full sets are similar enough, in whole numbers."""
    a = sets.select(F.col("rep").alias("u"), F.col("shingles").alias("su"))
    b = sets.select(F.col("rep").alias("v"), F.col("shingles").alias("sv"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 8_000_000):
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                ok.append(_similar(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U), p.percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["u", "v", "ok"])

    return pairs.join(a, "u").join(b, "v").select("u", "v", "su", "sv").mapInArrow(run, "u long, v long, ok boolean")


def _own(sets: DataFrame) -> DataFrame:
    """(rep, full, own): shingles of each set, and how many no other of the sets has."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            found = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), [len(x) for x in found])), pa.array(np.concatenate(found))], names=["rep", "x"])

    alone = sets.mapInArrow(run, "rep long, x long").groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("rep")).where("n = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("own"))
    return sets.select("rep", F.expr("length(shingles) div 8").cast("long").alias("full")).join(alone, "rep", "left").select("rep", "full", F.coalesce("own", F.lit(0)).cast("long").alias("own"))


def _apart(members: DataFrame, p: Params) -> DataFrame:
    """Links (u, v) between components of the same bucket, enough to join all that links join.

    members: (bucket, rep, comp, sig, main, full, own, n, shingles), main where comp is the bucket's
    largest. What two sets have for their own bounds their similarity from above; pairs whose bound
    is too low, or whose estimate falls short by more than the slack, are left out. The others are
    confirmed on full sets, block by block, likeliest first; a pair whose components a link of the
    same two blocks has joined already needs no link of its own.
    """
    least = p.percent / 100 - SLACK * (p.percent / 100 * (1 - p.percent / 100) / p.size) ** 0.5

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks are runs of one bucket and main, of whatever length the batches give."""
        for x in it:
            if not x.num_rows:
                continue
            bucket, rep, comp, full, own = (x.column(i).to_numpy() for i in (0, 2, 3, 4, 5))
            main = x.column(1).to_numpy(zero_copy_only=False)
            change = np.flatnonzero((bucket[1:] != bucket[:-1]) | (main[1:] != main[:-1])) + 1
            sets = x.column(7).to_pylist()
            length, heads, cuts, held = np.array([len(v) // 8 for v in sets], np.int64), set(change.tolist()), [0], 0
            for i in range(x.num_rows):
                if i > cuts[-1] and (i in heads or i - cuts[-1] == BLOCK or held + len(sets[i]) > BLOCK_BYTES):
                    cuts.append(i)
                    held = 0
                held += len(sets[i])
            cuts.append(x.num_rows)
            sizes, sig = np.stack([full, own, length], axis=1), x.column(6)
            out = [(int(bucket[i]), bool(main[i]), int(rep[i]), rep[i:j].tobytes(), comp[i:j].tobytes(), sizes[i:j].tobytes(), b"".join(sig.slice(i, j - i).to_pylist()), b"".join(sets[i:j])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            types = [pa.int64(), pa.bool_(), pa.int64(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["bucket", "main", "first", "reps", "comps", "sizes", "sigs", "sets"])

    n_parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / (4 * BLOCK))))
    dealt = salted.repartition(n_parts, "bucket", "salt").sortWithinPartitions("bucket", "main", "rep").select("bucket", "main", "rep", "comp", "full", "own", "sig", "shingles")
    blocks = Scratch(members.sparkSession, "blocks").cut(dealt.mapInArrow(pack, "bucket long, main boolean, first long, reps binary, comps binary, sizes binary, sigs binary, sets binary"), "blocks")
    left = blocks.where("not main").select("bucket", F.col("first").alias("f1"), F.col("reps").alias("r1"), F.col("comps").alias("c1"), F.col("sizes").alias("n1"), F.col("sigs").alias("s1"), F.col("sets").alias("t1"))
    both = left.join(blocks, "bucket").where("main or f1 <= first")

    def unpack(r: dict, *names: str) -> tuple:
        """ids, components, sizes, signatures and sets of a block."""
        ids, comps, sizes = (np.frombuffer(r[k], np.int64) for k in names[:3])
        sizes = sizes.reshape(-1, 3)
        # The low byte of each hash: a little too much agreement, never too little.
        sig = np.frombuffer(r[names[3]], np.uint32).reshape(-1, p.size).astype(np.uint8)
        return ids, comps, sizes, sig, np.split(np.frombuffer(r[names[4]], _U), np.cumsum(sizes[:-1, 2]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                r1, c1, n1, s1, t1 = unpack(r, "r1", "c1", "n1", "s1", "t1")
                r2, c2, n2, s2, t2 = unpack(r, "reps", "comps", "sizes", "sigs", "sets")
                parent: dict[int, int] = {}
                same = r["r1"] == r["reps"]
                for i in range(len(r1)):
                    both_ = np.minimum(n1[i, 0] - n1[i, 1], n2[:, 0] - n2[:, 1])
                    share = np.count_nonzero(s2 == s1[i], axis=1) / p.size
                    fit = np.flatnonzero((share >= least) & (c2 != c1[i]) & (100 * both_ >= p.percent * (both_ + n1[i, 1] + n2[:, 1])))
                    if same:
                        fit = fit[fit > i]
                    for j in fit[np.argsort(-share[fit], kind="stable")].tolist():
                        x, y = root(parent, int(c1[i])), root(parent, int(c2[j]))
                        if x != y and _similar(t1[i], t2[j], p.percent):
                            parent[max(x, y)] = min(x, y)
                            out.append((r1[i], r2[j]))
            cols = np.array(out, np.int64).reshape(-1, 2).T.copy()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["u", "v"])

    # All block pairs of a large family have one key: they are dealt out anew.
    both = both.repartition(n_parts, "f1", "first")
    return both.select("r1", "c1", "n1", "s1", "t1", "reps", "comps", "sizes", "sigs", "sets").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id and kept of every row.

    The set of a text: its distinct k-word shingles, words lower-cased in A-Z; with fewer words the
    whole sequence is one shingle; null texts and texts without words have an empty set and link
    with nothing. Sets link where 100 * intersection >= percent * union. class_id: the least doc_id
    with the same set; component_id: the least doc_id reachable; kept: doc_id equals it. Rows that
    repeat a doc_id each take part, and where one stands for its class the others' texts are linked
    through it. Null ids count as the least
    integer. Bands find a pair at the least similarity but for about 4e-7 of the cases (25 of 5).
    """
    cuts = Scratch(docs.sparkSession, "near")
    rows = docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(-(1 << 63))).alias("doc_id"), docs[text].alias("text"))
    sigs = cuts.cut(_signatures(rows, p), "signatures")
    same = ["n_shingles", "set_a", "set_b"]
    classes = cuts.cut(sigs.where("sig is not null").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    members = cuts.cut(sigs.select("doc_id", *same).join(classes.select(*same, F.col("rep").alias("class_id")), same, "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id")), "members")
    cuts.drop("signatures")
    bands = cuts.cut(_bands(classes, p), "bands")
    sizes = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("pivot")).where("n > 1")
    shared = cuts.cut(bands.join(sizes, "bucket"), "shared")
    cuts.drop("bands")
    wanted = shared.select("rep").distinct()
    chosen = rows.join(wanted, rows.doc_id == wanted.rep, "left_semi")

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            found = [s.tobytes() for _, s in sets_of(b.column(1), p.k)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["rep", "shingles"])

    sets = cuts.cut(chosen.mapInArrow(whole, "rep long, shingles binary").where("length(shingles) > 0"), "sets")
    own = cuts.cut(_own(sets), "own")
    # A set with too much that no other has links with nothing.
    able = own.where(f"100 * (full - own) >= {p.percent} * full")
    shared = cuts.cut(shared.select("bucket", "rep").join(able, "rep"), "able")
    sizes = shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("pivot")).where("n > 1")
    shared = cuts.cut(shared.join(sizes, "bucket"), "shared")
    stars = shared.where("rep <> pivot").select(F.col("pivot").alias("u"), F.col("rep").alias("v")).distinct()
    comp = cuts.cut(components(_confirm(stars, sets, p).where("ok"), cuts), "comp")
    labelled = shared.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("bucket", "rep", "full", "own", F.coalesce("component", "rep").alias("comp"))
    # Buckets that are still split, joined through their members to families: a pair that shares many buckets is compared once.
    split = labelled.groupBy("bucket").agg(F.min("rep").alias("u"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket", "u")
    ties = cuts.cut(labelled.join(split, "bucket").select("u", F.col("rep").alias("v"), "comp", "full", "own"), "ties")
    if not ties.isEmpty():
        family = components(ties, cuts, "families").select(F.col("node").alias("rep"), F.col("component").alias("bucket"))
        open_ = cuts.cut(ties.select(F.col("v").alias("rep"), "comp", "full", "own").distinct().join(family, "rep"), "open")
        parts = open_.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("m"))
        parts = parts.groupBy("bucket").agg(F.max_by("comp", F.struct("m", "comp")).alias("largest"), F.sum("m").alias("n"))
        open_ = open_.join(parts, "bucket").withColumn("main", F.col("comp") == F.col("largest")).drop("largest")
        found = cuts.cut(_apart(open_.join(classes.select("rep", "sig"), "rep").join(sets, "rep"), p), "found")
        comp = cuts.cut(components(comp.select(F.col("node").alias("u"), F.col("component").alias("v")).union(found), cuts), "comp")
    comp = comp.select(F.col("node").alias("class_id"), "component")
    out = members.join(comp, "class_id", "left")
    component = F.coalesce("component", "class_id")
    return out.select("doc_id", "n_shingles", "class_id", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
