"""Benchmark decontamination under edit distance.

Words are the symbols. Windows of the items are embedded by CGK random walks, which turn edit
distance into Hamming distance: at each step the walk writes the word it stands on, and goes on to
the next if a random bit of that word says so. Bit-sampling LSH keeps a few places of an embedded
window as a key, many times over; windows of the texts that have a key in common with an item are
candidates, and nothing else is. Candidates are verified by exact edit distance.

All samples hold place 0, the first word. So an item's windows start at its words that are rarest in
the benchmark, more of them than edits are allowed, and only windows of a text that start with such
a word can agree with any of them: those alone are embedded. A window runs from its start to the
farther end of the item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm import textkernel as tk
from mosaiq.llm.common import batches

_U = np.uint64
#: Word edits per word of an item that still count as the item.
RATE = 0.2
#: Walks, samples of each, and windows of an item besides one more than the edits. Recall at the limit of
#: edits is measured in the tests.
WALKS, SAMPLES, MORE_STARTS = 2, 5, 3
#: Windows are sampled by their length: at least 1, 2, 4, 8, 16 or 32 words; places reach 1.5 times that far.
CLASSES = 6
#: Bytes of benchmark text for which one index (up to some 25 times as large for items of a few words, 6 times for
#: longer ones) is made and sent to the executors; a larger benchmark takes several passes over the texts.
INDEX_BYTES = 4_000_000


def _places(c: int) -> list[list[tuple[int, int]]]:
    """For each walk the two sampled places (besides 0) of each sample of a class; windows of one word have no more than place 0.

    A walk goes one word on in a step at most, so the first sample ends before the shortest window
    of the class does: a window equal to an item's is always found.
    """
    if c == 0:
        return [[(0, 0)], *[[] for _ in range(WALKS - 1)]]
    top, sure = 3 << c >> 1, (1, (1 << c) - 1)
    pairs = [(a, b) for a in range(1, top + 1) for b in range(a + 1, top + 1)]
    rng = np.random.default_rng(61 + c)
    return [[sure, *[pairs[i] for i in rng.permutation(len(pairs)) if pairs[i] != sure][: SAMPLES - 1]] for _ in range(WALKS)]


def window_keys(h: np.ndarray, limit: np.ndarray, at: np.ndarray, masks: np.ndarray, tag: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index into `at`, key) of the sampled windows that start at the words `at` and end before `limit`.

    masks: the classes (as bits) in which a window is wanted. Samples that reach past the end are left out.
    """
    classes = [c for c in range(CLASSES) if (masks >> c & 1).any()]
    for w in range(WALKS):
        wanted = {c: _places(c)[w] for c in classes}
        steps = sorted({t for ps in wanted.values() for p in ps for t in p})
        if not steps:
            continue
        bits = tk.mix(h ^ _U((w + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        now, seen = at.copy(), {0: (h[at], np.ones(len(at), bool))}
        for t in range(1, steps[-1] + 1):
            now += (bits[np.minimum(now, limit - 1)] >> _U(t - 1) & _U(1)).astype(np.int64)
            if t in steps:
                inside = now < limit
                seen[t] = h[np.minimum(now, limit - 1)], inside
        with np.errstate(over="ignore"):
            for c in classes:
                mine = np.flatnonzero(masks >> c & 1)
                for n, (a, b) in enumerate(wanted[c]):
                    ok = mine[(seen[a][1] & seen[b][1])[mine]]
                    key = tk.mix(seen[0][0][ok] * _U(0x9E3779B97F4A7C15) + _U((tag * CLASSES + c) * 4096 + w * 64 + n))
                    yield ok, tk.mix(tk.mix(key + seen[a][0][ok]) * _U(0xD6E8FEB86659FD93) + seen[b][0][ok])


def edit_within(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of `text` nearest to `item` by word edits, the earliest end first; None beyond `most`."""
    # Sellers' alignment: free start and end in the text; starts travel with the least cost, the latest start on ties.
    n = len(text)
    cost, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    order = np.arange(n + 1)
    for w in item:
        diagonal = np.concatenate([[cost[0] + 1], cost[:-1] + (text != w)])
        start = np.concatenate([[begin[0]], begin[:-1]])
        up = cost + 1
        start = np.where(up < diagonal, begin, start)
        best = np.minimum(diagonal, up)
        # Steps along the text: best[j] = min over k <= j of best[k] + (j - k).
        low = np.minimum.accumulate((best - order) * (n + 2) - np.arange(n + 1))
        k = -(low - ((low + n + 1) // (n + 2)) * (n + 2))
        cost, begin = best[k] + order - k, start[k]
    end = int(cost.argmin())
    return (int(cost[end]), int(begin[end]), end) if cost[end] <= most else None


def merged_starts(rows: np.ndarray, items: np.ndarray, starts: np.ndarray, slack: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, least start, greatest start) of runs of candidates whose starts lie within the item's slack of each other."""
    if not len(rows):
        return
    order = np.lexsort((starts, items, rows))
    rows, items, starts = rows[order], items[order], starts[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (items[1:] != items[:-1]) | (starts[1:] - starts[:-1] > np.maximum(1, slack[items[1:]]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    yield from zip(rows[first].tolist(), items[first].tolist(), starts[first].tolist(), starts[last].tolist(), strict=True)


class Index:
    """Items, the words at which their windows start, and the keys of the windows; each window takes room for its own keys only."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        words = tk.Words(tk.binary(pa.array(texts, pa.string())))
        h = words.hashes()
        self.ids, self.words = np.array(ids, np.int64), h
        self.start, self.length = words.bounds[:-1].astype(np.int64), words.counts.astype(np.int64)
        self.most = np.floor(RATE * self.length).astype(np.int64)
        _, place, count = np.unique(h, return_inverse=True, return_counts=True)
        item = words.rows()
        # The starts of each item: its rarest words, ties from the front.
        order = np.lexsort((np.arange(len(h)), count[place] if len(h) else place, item))
        rank = np.arange(len(h)) - self.start[item]
        chosen = np.sort(order[rank < self.most[item] + 1 + MORE_STARTS])
        item, offset = item[chosen], chosen - self.start[item[chosen]]
        ahead = self.length[item] - offset
        forward = ahead >= offset + 1
        size = np.maximum(ahead, offset + 1)
        mask = (1 << np.minimum(CLASSES - 1, np.log2(np.maximum(size, 1)).astype(np.int64))).astype(np.int64)
        ends = (self.start + self.length)[item]
        keys, entry, flags = [], [], []
        n = len(h)
        for tag, mine in enumerate((np.flatnonzero(forward), np.flatnonzero(~forward))):
            if not len(mine):
                continue
            # Backward windows are forward ones of the reversed words.
            a = (h, ends[mine], chosen[mine]) if tag == 0 else (h[::-1], n - self.start[item[mine]], n - 1 - chosen[mine])
            for at, k in window_keys(*a, mask[mine], tag):
                keys.append(k)
                entry.append(mine[at])
            flags.append(np.stack([h[chosen[mine]].view(np.int64), mask[mine] << tag * CLASSES]))
        keys, entry = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, _U), (entry, np.int64)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_item, self.key_offset = keys[order], item[entry[order]].astype(np.int32), offset[entry[order]].astype(np.int32)
        both = np.concatenate(flags, axis=1) if flags else np.zeros((2, 0), np.int64)
        self.heads, place = np.unique(both[0].view(_U), return_inverse=True)
        self.flags = np.zeros(len(self.heads), np.int64)
        np.bitwise_or.at(self.flags, place, both[1])
        self.some_head, self.some_key = _sieve(self.heads), _sieve(self.keys)


def _sieve(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 22, bool)
    table[(keys >> _U(42)).astype(np.int64)] = True
    return table


def _passed(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(table[(keys >> _U(42)).astype(np.int64)])


def candidates(index: Index, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, start): where windows of the rows' words have a key of an item's window, and where the item would start."""
    some = _passed(index.some_head, h)
    place = np.minimum(np.searchsorted(index.heads, h[some]), max(0, len(index.heads) - 1))
    real = index.heads[place] == h[some] if len(index.heads) else np.zeros(0, bool)
    at, flags = some[real], index.flags[place[real]]
    row = np.searchsorted(bounds, at, "right") - 1
    n, found = len(h), []
    for tag in (0, 1):
        masks = flags >> tag * CLASSES & (1 << CLASSES) - 1
        mine = np.flatnonzero(masks)
        if not len(mine):
            continue
        a = (h, bounds[row[mine] + 1], at[mine]) if tag == 0 else (h[::-1], n - bounds[row[mine]], n - 1 - at[mine])
        for k, keys in window_keys(*a, masks[mine], tag):
            hit = _passed(index.some_key, keys)
            low, high = (np.searchsorted(index.keys, keys[hit], side) for side in ("left", "right"))
            m = high - low
            entry = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low, m)
            where = mine[np.repeat(k[hit], m)]
            found.append(np.unique(np.stack([row[where], index.key_item[entry], at[where] - index.key_offset[entry]]), axis=1))
    return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64),) * 3


def search(index: Index, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, first word, end word) of the best place of each item in each row of a text column."""
    text = tk.binary(column)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i, j in tk.steps(np.diff(tk.buffers(text)[1])):
        words = tk.Words(text.slice(i, j - i))
        h = words.hashes()
        for r, x, low, high in merged_starts(*candidates(index, h, words.bounds), index.most):
            most, first, end = int(index.most[x]), int(words.bounds[r]), int(words.bounds[r + 1])
            item = index.words[index.start[x] : index.start[x] + index.length[x]]
            a, b = max(first, low - most), min(end, high + len(item) + most)
            # Words of the item that the place lacks are edits: too many, and no alignment is needed.
            if len(item) - int(np.isin(item, h[a:b]).sum()) > most:
                continue
            got = edit_within(item, h[a:b], most)
            if got:
                here, known = (got[0], a + got[1] - first, a + got[2] - first), best.get((i + r, x))
                best[i + r, x] = min(known, here) if known else here
    return [(r, x, *v) for (r, x), v in sorted(best.items())]


def _parts(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of at most INDEX_BYTES (or one item) at a time, so that what is sent stays bounded."""
    size = items.agg(F.sum(F.octet_length(F.coalesce(items[text], F.lit(""))))).first()[0] or 0
    n = math.ceil(size / INDEX_BYTES) or 1
    rows = items.select(items[item_id].cast("long").alias("i"), items[text].alias("t")).where("t is not null and i is not null").distinct()
    for part in range(n):
        got = rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == part).orderBy("i", "t").collect()
        yield [r.i for r in got], [r.t for r in got]


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, first_word, end_word): each item with at most RATE edits per word in a text, at its best place.

    Words are lower-cased in A-Z. Null texts, empty texts and items without words match nothing.
    Rows that repeat an id give rows of their own; items that repeat an id too, but for items that
    repeat id and text, which are one. Of equally near places the first counts. Empty tables give
    no rows. Other columns are not read, whatever their names.
    """
    cols = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    schema = "doc_id long, item_id long, edits long, first_word long, end_word long"
    out = None
    for ids, texts in _parts(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Index(ids, texts))

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            index = shared.value
            for b in batches(it, 4_000_000):
                found = search(index, b.column(1)) if len(index.ids) else []
                doc = b.column(0).to_pylist()
                cols = list(zip(*[(doc[r], int(index.ids[x]), e, s, t) for r, x, e, s, t in found], strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["doc_id", "item_id", "edits", "first_word", "end_word"])

        part = cols.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the rows whose text holds an item; columns as they were.

    Each row is searched in its own place, so no ids are compared: rows that repeat an id, or have
    none, stand or go by their own text. Rows with null or empty texts stay.
    """
    plain = docs.sparkSession.sparkContext
    kept = docs
    for ids, texts in _parts(items, "item_id", "text"):
        shared = plain.broadcast(Index(ids, texts))
        at = docs.columns.index(text)

        def run(it: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            index = shared.value
            for b in batches(it, 4_000_000):
                bad = {r for r, *_ in search(index, b.column(at))} if len(index.ids) else set()
                yield b.filter(pa.array([r not in bad for r in range(b.num_rows)], pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
