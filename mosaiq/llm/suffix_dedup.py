"""Removal of repeated byte strings over a whole corpus with hash-compared suffix sorting.

Equal windows of `width` bytes have the same minimiser: the k-gram of least hash in them. The
minimisers (anchors) of all texts are dealt out by hash; an anchor whose surroundings, all the
bytes that its windows can hold, occurred before makes all its windows repeats. Anchors whose
surroundings differ are sorted as suffixes, to the right and (reversed) to the left: a vectorised
mergesort compares suffixes by their longest common extension, which binary search finds over
prefix polynomial hashes, and neighbours are verified byte by byte. Windows are equal where both
extensions suffice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.llm import textkernel as tk
from mosaiq.llm.common import batches
from mosaiq.scratch import Scratch

_U = np.uint64
#: Bytes of a repeated string, and of the k-gram whose hash picks anchors.
WIDTH, GRAM = 100, 32
#: Suffixes sorted at once; a group of anchors with more distinct surroundings than MANY goes by window hashes.
SORTED, MANY = 20_000, 50_000
#: Window positions taken at once.
PIECE = 2_000_000
#: Added to an anchor's `ends` where a batch holds the same surroundings at an earlier place.
FOUND = 1 << 20
_LOW = _U((1 << 24) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(position, left bytes, right bytes, hash, hash of the surroundings) of the anchors of each piece of the rows' bytes.

    left: bytes of the row before the position, at most width - gram; right: bytes from it on, at most width.
    An anchor that windows of two pieces pick is given once.
    """
    reach = width - gram
    given = -1  # the last position of the pieces before
    for s in range(0, max(0, len(data) - width + 1), PIECE):
        base = max(0, s - reach)
        piece = data[base : min(len(data), s + PIECE + 2 * width)]
        if len(piece) < width:
            continue
        power, inverse = tk._power_tables(len(piece))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(tk._TABLE[piece] * power[: len(piece)])])
            h = tk.mix((sums[gram:] - sums[:-gram]) * inverse[: len(piece) - gram + 1])
        low = h & ~_LOW | np.arange(len(h), dtype=_U)
        least, span = low, 1
        while 2 * span <= reach + 1:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = reach + 1 - span
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        # Windows of this piece that end inside their row.
        p = np.arange(len(least)) + base
        row = np.searchsorted(offsets, p, "right") - 1
        good = (p >= s) & (p < s + PIECE) & (p + width <= offsets[row + 1])
        picked = least[good]
        if not len(picked):
            continue
        at = np.unique(picked[np.concatenate([[True], picked[1:] != picked[:-1]])] & _LOW).astype(np.int64)
        # The places that windows pick never go back, so those up to the last one given are known.
        at = at[at + base > given]
        if not len(at):
            continue
        given = int(at[-1]) + base
        row = np.searchsorted(offsets, at + base, "right") - 1
        left = np.minimum(reach, at + base - offsets[row])
        right = np.minimum(width, offsets[row + 1] - at - base)
        with np.errstate(over="ignore"):
            around = tk.mix((sums[at + right] - sums[at - left]) * inverse[at - left] + (left * 256 + right).astype(_U))
        yield at + base, left, right, h[at], around


def _merge_sorted(order: np.ndarray, less_equal) -> np.ndarray:  # noqa: ANN001
    """Stable mergesort of indices, all runs of a level at once; less_equal compares arrays of indices."""
    n, run = len(order), 1
    while run < n and not less_equal(order[:-1], order[1:]).all():
        start = np.arange(n) // (2 * run) * (2 * run)
        mid, end = np.minimum(start + run, n), np.minimum(start + 2 * run, n)
        first = np.arange(n) < mid
        # The place of each in the other run: before equals for the first run, after them for the second.
        low, high = np.where(first, mid, start), np.where(first, end, mid)
        while (open_ := low < high).any():
            i = np.flatnonzero(open_)
            m = (low[i] + high[i]) // 2
            mine, theirs = order[i], order[m]
            ahead = np.where(first[i], ~less_equal(mine, theirs), less_equal(theirs, mine))
            low[i], high[i] = np.where(ahead, m + 1, low[i]), np.where(ahead, high[i], m)
        place = np.where(first, np.arange(n) + low - mid, np.arange(n) - mid + low)
        out = np.empty_like(order)
        out[place] = order
        order, run = out, 2 * run
    return order


class Suffixes:
    """Suffixes of at most `width` bytes, in groups: rows of a byte matrix with lengths."""

    def __init__(self, group: np.ndarray, data: np.ndarray, length: np.ndarray) -> None:
        self.group, self.data, self.length = group, data, length
        power, _ = tk._power_tables(data.shape[1])
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros((len(data), 1), _U), np.cumsum(tk._TABLE[data] * power[: data.shape[1]], axis=1)], axis=1)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefixes, by binary search over prefix hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        while (low < high).any():
            m = (low + high + 1) // 2
            same = self.sums[i, m] == self.sums[j, m]
            low, high = np.where(same, m, low), np.where(same, high, m - 1)
        return low

    def less_equal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = self.extension(i, j)
        last = self.data.shape[1] - 1
        at_end = (n == self.length[i]) | (n == self.length[j])
        x, y = self.data[i, np.minimum(n, last)], self.data[j, np.minimum(n, last)]
        inside = np.where(at_end, self.length[i] <= self.length[j], x < y)
        return np.where(self.group[i] == self.group[j], inside, self.group[i] < self.group[j])

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """Indices in order and the common prefix of each with the one before (-1 at a group's start), verified on the bytes."""
        order = _merge_sorted(np.arange(len(self.group)), self.less_equal)
        i, j = order[:-1], order[1:]
        n = self.extension(i, j)
        differ = self.data[i] != self.data[j]
        real = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1]), np.minimum(self.length[i], self.length[j]))
        if (real != n).any():  # a collision of hashes: sort by the bytes themselves
            order = np.array(sorted(range(len(self.group)), key=lambda k: (self.group[k], self.data[k, : self.length[k]].tobytes())))
            i, j = order[:-1], order[1:]
            differ = self.data[i] != self.data[j]
            real = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1]), np.minimum(self.length[i], self.length[j]))
        return order, np.concatenate([[-1], np.where(self.group[i] == self.group[j], real, -1)])

    def classes(self, order: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
        """A number for each suffix; equal where the group and the first `least` bytes are."""
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(shared < least)
        return out


def repeats(group: np.ndarray, rank: np.ndarray, around: np.ndarray, left: np.ndarray, right: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """First and last offset (before the anchor) of the repeated windows of each anchor, -1 where there is none.

    around: a matrix of bytes with the anchor at column width - gram; rank: the order of the places.
    """
    reach = width - gram
    ahead = Suffixes(group, np.ascontiguousarray(around[:, reach:]), right)
    back = Suffixes(group, np.ascontiguousarray(around[:, :reach][:, ::-1]), left)
    (o1, n1), (o2, n2) = ahead.sort(), back.sort()
    by_rank = np.argsort(rank, kind="stable")
    first, last = np.full(len(group), -1), np.full(len(group), -1)
    for d in range(reach + 1):
        fits = (left >= d) & (right >= width - d)
        rows = by_rank[fits[by_rank]]
        if len(rows) < 2:
            continue
        key = ahead.classes(o1, n1, width - d)[rows] * (len(group) + 1) + back.classes(o2, n2, d)[rows]
        late = np.ones(len(rows), bool)
        late[np.unique(key, return_index=True)[1]] = False
        hit = rows[late]
        first[hit] = d
        last[hit] = np.where(last[hit] < 0, d, last[hit])
    return first, last


_ANCHORS = "hash long, around long, doc long, seq int, pos long, ends int"
_FOUND = "kind int, hash long, doc long, seq int, a long, b long"


def _found(kind: int, h: np.ndarray, doc: np.ndarray, seq: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(h.astype(np.int64)), pa.array(doc), pa.array(seq.astype(np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["kind", "hash", "doc", "seq", "a", "b"])


def _anchor_rows(rows: DataFrame) -> DataFrame:
    """Anchors of all rows.

    Where equal surroundings come again in a batch, only the first place has to be compared with
    other tasks' ones; the later ones are flagged, and their hash is mixed with the place, so that
    a very common passage is spread over the tasks.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 8_000_000):
            data, offsets = tk.buffers(tk.binary(b.column(2)))
            doc, seq = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at, left, right, h, around in anchors(data, offsets):
                row = np.searchsorted(offsets, at, "right") - 1
                pos = at - offsets[row]
                order = np.lexsort((pos, seq[row], doc[row], around, h))
                late = np.zeros(len(at), bool)
                late[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (around[order[1:]] == around[order[:-1]])
                with np.errstate(over="ignore"):
                    h = np.where(late, tk.mix(h + doc[row].astype(_U) * _U(31) + pos.astype(_U)), h)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(around.view(np.int64)), pa.array(doc[row]), pa.array(seq[row]), pa.array(pos), pa.array((left * 256 + right + late * FOUND).astype(np.int32))], names=["hash", "around", "doc", "seq", "pos", "ends"])

    return rows.mapInArrow(run, _ANCHORS)


def _first_pass(dealt: DataFrame) -> DataFrame:
    """From anchors sorted by (hash, around, doc, seq, pos): spans of repeats (kind 0), and anchors to compare (kind 1)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hash", "around", "doc", "seq", "pos", "ends"]

        def spans_of(c: dict[str, np.ndarray]) -> pa.RecordBatch:
            """All windows with the anchor."""
            left, right = c["ends"] >> 8, c["ends"] & 255
            return _found(0, np.zeros(len(left)), c["doc"], c["seq"], c["pos"] - left, c["pos"] - np.maximum(0, WIDTH - right) + WIDTH)

        last: tuple[int, int] | None = None
        held: tuple | None = None  # the last first-of-its-surroundings, and whether it must be compared
        for b in it:
            if not b.num_rows:
                continue
            c = {k: b.column(i).to_numpy() for i, k in enumerate(names)}
            late = c["ends"] >= FOUND
            if late.any():
                yield spans_of({k: v[late] for k, v in c.items()} | {"ends": c["ends"][late] - FOUND})
                c = {k: v[~late] for k, v in c.items()}
            if late.all():
                continue
            same = np.zeros(len(c["hash"]), bool)
            same[1:] = (c["hash"][1:] == c["hash"][:-1]) & (c["around"][1:] == c["around"][:-1])
            same[0] = last == (c["hash"][0], c["around"][0])
            last = c["hash"][-1], c["around"][-1]
            if same.any():
                yield spans_of({k: v[same] for k, v in c.items()})
            new = {k: v[~same] for k, v in c.items()}
            if held:
                new = {k: np.concatenate([[held[0][k]], v]).astype(v.dtype) for k, v in new.items()}
            if not len(new["hash"]):
                continue
            twin = new["hash"][1:] == new["hash"][:-1]
            ask = np.zeros(len(new["hash"]), bool)
            ask[1:] |= twin
            ask[:-1] |= twin
            if held:
                ask[0] |= held[1]
            out = ask.copy()
            out[-1] = False
            held = {k: v[-1] for k, v in new.items()}, bool(ask[-1])
            yield _found(1, new["hash"][out], new["doc"][out], new["seq"][out], new["pos"][out], new["ends"][out])
        if held and held[1]:
            one = {k: np.array([v]) for k, v in held[0].items()}
            yield _found(1, one["hash"], one["doc"], one["seq"], one["pos"], one["ends"])

    return dealt.mapInArrow(run, _FOUND)


def _surroundings(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The bytes around each anchor to compare."""
    lists = asked.groupBy("doc", "seq").agg(F.collect_list("hash").alias("hs"), F.collect_list("a").alias("ps"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = WIDTH - GRAM
        for b in batches(it, 2_000_000):
            out: list[tuple] = []
            for doc, seq, text, hs, ps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), tk.binary(b.column(2)).to_pylist(), b.column(3), b.column(4), strict=True):
                out += [(h, doc, seq, p, text[max(0, p - reach) : p], text[p : p + WIDTH]) for h, p in zip(hs.as_py(), ps.as_py(), strict=True)]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["hash", "doc", "seq", "pos", "before", "after"])

    return rows.join(lists, ["doc", "seq"]).select("doc", "seq", "text", "hs", "ps").mapInArrow(run, "hash long, doc long, seq int, pos long, before binary, after binary")


def _second_pass(dealt: DataFrame) -> DataFrame:
    """From surroundings sorted by hash: spans (kind 0); for groups with more than MANY, all windows (kind 2: two hashes and the place)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = WIDTH - GRAM

        def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            m = np.zeros((t.num_rows, reach + WIDTH), np.uint8)
            left, right = np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(t["before"].to_pylist(), t["after"].to_pylist(), strict=True)):
                left[i], right[i] = len(x), len(y)
                m[i, reach - len(x) : reach] = np.frombuffer(x, np.uint8)
                m[i, reach : reach + len(y)] = np.frombuffer(y, np.uint8)
            return m, left, right

        def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if t.num_rows < 2:
                return
            doc, seq, pos = t["doc"].to_numpy(), t["seq"].to_numpy(), t["pos"].to_numpy()
            rank = np.empty(t.num_rows, np.int64)
            rank[np.lexsort((pos, seq, doc))] = np.arange(t.num_rows)
            m, left, right = matrix(t)
            far, near = repeats(t["hash"].to_numpy(), rank, m, left, right)
            hit = far >= 0
            yield _found(0, np.zeros(hit.sum()), doc[hit], seq[hit], pos[hit] - far[hit], pos[hit] - near[hit] + WIDTH)

        def windows(t: pa.Table) -> Iterator[pa.RecordBatch]:
            doc, seq, pos = t["doc"].to_numpy(), t["seq"].to_numpy(), t["pos"].to_numpy()
            m, left, right = matrix(t)
            power, inverse = tk._power_tables(m.shape[1])
            with np.errstate(over="ignore"):
                s1 = np.concatenate([np.zeros((len(m), 1), _U), np.cumsum(tk._TABLE[m] * power[: m.shape[1]], axis=1)], axis=1)
                s2 = np.concatenate([np.zeros((len(m), 1), _U), np.cumsum(tk.mix(tk._TABLE[m]) * power[: m.shape[1]], axis=1)], axis=1)
                for d in range(reach + 1):
                    ok = (left >= d) & (right >= WIDTH - d)
                    p = reach - d
                    a, b = ((s[ok, p + WIDTH] - s[ok, p]) * inverse[p] for s in (s1, s2))
                    out = _found(2, a.view(np.int64), doc[ok], seq[ok], pos[ok] - d, b.view(np.int64))
                    if out.num_rows:
                        yield out

        held: list[pa.RecordBatch] = []
        n, hot = 0, None
        for b in it:
            for i in range(0, b.num_rows, SORTED):
                x = b.slice(i, SORTED)
                held.append(x)
                n += x.num_rows
                if n < SORTED:
                    continue
                t = pa.Table.from_batches(held)
                h = t["hash"].to_numpy()
                if hot is not None:
                    k = int(np.searchsorted(h != hot, True)) if (h != hot).any() else len(h)
                    yield from windows(t.slice(0, k))
                    t, h = t.slice(k), h[k:]
                    hot = None if len(h) else hot
                if len(h):
                    k = int(np.argmax(h == h[-1]))  # where the last, perhaps unfinished group starts
                    yield from compare(t.slice(0, k))
                    t = t.slice(k)
                    if t.num_rows > MANY:
                        hot = h[-1]
                        yield from windows(t)
                        t = t.slice(t.num_rows)
                held, n = t.to_batches(), t.num_rows
        if held:
            t = pa.Table.from_batches(held)
            h = t["hash"].to_numpy()
            if hot is not None:
                yield from windows(t.filter(pa.array(h == hot)))
                t = t.filter(pa.array(h != hot))
            yield from compare(t)

    return dealt.mapInArrow(run, _FOUND)


def _large_groups(found: DataFrame) -> DataFrame:
    """Spans of repeated windows among kind 2, from sums per window that each task makes first."""
    w = found.where("kind = 2").select("hash", "b", "doc", "seq", "a")
    least = w.groupBy("hash", "b").agg(F.min(F.struct("doc", "seq", "a")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    late = w.join(least, ["hash", "b"]).where(F.struct("doc", "seq", "a") != F.col("first"))
    return late.select("doc", "seq", F.col("a").alias("start"), (F.col("a") + WIDTH).alias("end"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs under the spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (doc, seq, doc_id, text) of docs; spans (doc, seq, spans) of those with bytes to remove.

    Null texts are empty. Null ids count as the least integer. Rows that share id and text are one
    document; texts that share an id are told apart by seq, in the order of their hashes.
    """
    cuts = Scratch(docs.sparkSession, "suffix")
    rows = docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(-(1 << 63))).alias("doc"), docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    versions = rows.select("doc", F.xxhash64("text").alias("th")).groupBy("doc", "th").agg(F.count(F.lit(1)).alias("n"))
    some = versions.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc")
    if some.isEmpty():
        rows = rows.withColumn("seq", F.lit(0))
    else:
        seqs = versions.join(some, "doc", "left_semi").select("doc", "th", F.row_number().over(W.partitionBy("doc").orderBy("th")).alias("seq"))
        rows = rows.withColumn("th", F.xxhash64("text")).join(seqs, ["doc", "th"], "left").withColumn("seq", F.coalesce("seq", F.lit(0))).drop("th")
    # Rows that repeat an id and text are one document, not repeats of each other.
    repeated = not versions.where("n > 1").isEmpty()
    single = rows.dropDuplicates(["doc", "seq"]) if repeated else rows
    picked = _anchor_rows(single.select("doc", "seq", "text"))
    order = ["hash", "around", "doc", "seq", "pos"]
    found = cuts.cut(_first_pass(picked.repartition("hash").sortWithinPartitions(*order)), "first")
    around = _surroundings(single, found.where("kind = 1"))
    second = cuts.cut(_second_pass(around.repartition("hash").sortWithinPartitions("hash")), "second")
    spans = found.where("kind = 0").union(second.where("kind = 0")).select("doc", "seq", F.col("a").alias("start"), F.col("b").alias("end"))
    if not second.where("kind = 2").isEmpty():
        spans = spans.union(_large_groups(second))
    return rows, spans.groupBy("doc", "seq").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def dedup_bytes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if `texts`, kept (the bytes left) of every row.

    A byte goes if a `WIDTH`-byte string over it also starts earlier: in a document of smaller
    (id, seq), or earlier in the same. Strings don't cross documents and are judged on the input.
    """
    rows, spans = repeated_spans(docs, text, doc_id)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            out = []
            for t, s in zip(tk.binary(b.column(1)).to_pylist(), b.column(2).to_pylist(), strict=True):
                runs = merged([(x["start"], x["end"]) for x in s or []])
                at = [0, *[x for run_ in runs for x in run_], len(t)]
                kept = b"".join(t[at[i] : at[i + 1]] for i in range(0, len(at), 2))
                out.append((len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True))[: 4 + texts]
            types, names = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=False)]], names=names[: 1 + len(cols)])

    both = rows.join(spans, ["doc", "seq"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return both.mapInArrow(run, schema + ", kept binary" * texts)
