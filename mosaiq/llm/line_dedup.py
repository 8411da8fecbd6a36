"""Line dedup by pairwise alignment.

Documents that share a line, or a run of lines that makes a block, are aligned with patience diff,
and blocks of aligned common lines go from the later one. For each line and each run every later
document is paired with the earliest that has it, however many have it, never all with all.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType
from xxhash import xxh64_digest, xxh64_intdigest

from mosaiq.llm.common import batches
from mosaiq.scratch import Scratch

#: A block of aligned lines must have so many words to go.
BLOCK_WORDS = 8
SALTS = 16


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned equal entries (i, j), both ascending: the longest chain of entries unique in both ranges, then the ranges between them."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        in_a, in_b = Counter(a[i0:i1]), Counter(b[j0:j1])
        place = {x: j for j, x in enumerate(b[j0:j1], j0) if in_b[x] == 1 and in_a.get(x) == 1}
        tops: list[int] = []
        nodes: list[tuple[int, int, int]] = []  # i, j, node before
        ends: list[int] = []
        for i in range(i0, i1):
            j = place.get(a[i])
            if j is None:
                continue
            k = bisect_left(tops, j)
            nodes.append((i, j, ends[k - 1] if k else -1))
            if k == len(tops):
                tops.append(j)
                ends.append(len(nodes) - 1)
            else:
                tops[k], ends[k] = j, len(nodes) - 1
        if not ends:
            continue
        chain, at = [], ends[-1]
        while at >= 0:
            chain.append(nodes[at][:2])
            at = nodes[at][2]
        chain.reverse()
        out += chain
        bounds = [(i0 - 1, j0 - 1), *chain, (i1, j1)]
        todo += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(bounds, bounds[1:], strict=False)]
    return sorted(out)


def common_blocks(later: list[int], words: list[int], earlier: list[int], least: int = BLOCK_WORDS) -> list[int]:
    """Indices in `later` of aligned blocks (runs without a gap in either) with at least `least` words."""
    out: list[int] = []
    block: list[int] = []
    before = (-2, -2)
    for i, j in [*patience(later, earlier), (-9, -9)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            if sum(words[k] for k in block) >= least:
                out += block
            block = []
        block.append(i)
        before = i, j
    return out


def _signed(rows: list[list[int | None]]) -> pa.Array:
    """Lists of 64-bit hashes, or null, as lists of bigint."""
    ends = np.cumsum([0, *map(len, rows)])
    flat = [x for row in rows for x in row]
    values = np.array([x or 0 for x in flat], dtype=np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, mask=np.array([x is None for x in flat], dtype=bool)))


def _keys(digests: list[bytes], words: list[int]) -> Iterator[int]:
    """Hashes of the shortest run of two lines or more from each line on that has BLOCK_WORDS words; every longer block holds one, or such a line."""
    end = total = 0
    for i, w in enumerate(words):
        while total < BLOCK_WORDS and end < len(words):
            total += words[end]
            end += 1
        if total < BLOCK_WORDS:
            return
        if end - i > 1:
            yield xxh64_intdigest(b"".join(digests[i:end]))
        total -= w


def _read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the text in the last column: hash (of its words, single-spaced) and words of each line, and the distinct hashes of its lines and runs; a line without words has hash null. Null texts are empty."""
    for b in batches(it):
        hashes, counts, entries = [], [], []
        for text in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist():
            # Bytes split at the blanks of WORD.
            lines = [x.split() for x in (text or b"").split(b"\n")]
            digests = [xxh64_digest(b" ".join(x)) if x else None for x in lines]
            solid = [x for x in digests if x is not None]
            row = [None if x is None else int.from_bytes(x) for x in digests]
            hashes.append(row)
            counts.append([len(x) for x in lines])
            entries.append(list(dict.fromkeys([*(x for x in row if x is not None), *_keys(solid, [len(x) for x in lines if x])])))
        made = [_signed(hashes), pa.array(counts, pa.list_(pa.int32())), _signed(entries)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*b.schema.names[:-1], "hs", "ws", "keys"])


def repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, key, n_lines and removed (ascending line numbers from 0) of every row.

    The earlier document is the one of smaller (id, hash of the text). Texts with the same lines
    are one class: all but its earliest document lose all lines in blocks of enough words. Lines
    compare by their words; lines without words stay unless all of the document goes. Null texts
    are one line without words. Null ids count as the least integer; rows that repeat an id and a
    text are one document and lose the same lines.
    """
    cuts = Scratch(docs.sparkSession, "lines")
    named = docs.select(docs[doc_id].alias("doc_id"), F.struct(F.coalesce(docs[doc_id].cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(docs[text]).alias("th")).alias("key"), docs[text].alias("text"))
    schema = StructType(named.schema.fields[:2]).add("hs", ArrayType(LongType())).add("ws", ArrayType(IntegerType())).add("keys", ArrayType(LongType()))
    lists = cuts.cut(named.mapInArrow(_read, schema), "lists")
    solid = F.filter("hs", lambda h: h.isNotNull())
    marked = lists.select("key", "hs", "ws", "keys", F.struct(F.xxhash64(solid).alias("a"), F.hash(solid).alias("b"), F.size(solid).alias("n")).alias("same")).where("same.n > 0")
    firsts = marked.groupBy("same").agg(F.min("key").alias("first"))
    # One document of each class looks for partners.
    classes = cuts.cut(marked.dropDuplicates(["key"]).join(firsts.withColumnRenamed("same", "s"), (F.col("same") == F.col("s")) & (F.col("key") == F.col("first"))).select("key", "hs", "ws", "keys"), "classes")
    entries = classes.select("key", F.explode("keys").alias("h"))
    sums = entries.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first")).where("n > 1")
    salted = sums.select("h", "first", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > 1000, SALTS - 1).otherwise(0))).alias("salt"), (F.col("n") > 1000).alias("hot"))
    shared = entries.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    cold = shared.join(salted.where("not hot").select("h", "first"), "h").select("key", "first")
    hot = shared.join(salted.where("hot").select("h", "first", "salt"), ["h", "salt"]).select("key", "first")
    pairs = cold.union(hot).where("key <> first").distinct()
    # A document that many others are held against is dealt to several tasks by the skewed join.
    sides = pairs.join(classes.select(F.col("key").alias("first"), F.col("hs").alias("eh")), "first").join(classes.drop("keys"), "key").select("key", "hs", "ws", "eh")

    def align(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            keys, rows = [], []
            for key, hs, ws, eh in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                solid = [(h, w, i) for i, (h, w) in enumerate(zip(hs, ws, strict=True)) if h is not None]
                found = common_blocks([x[0] for x in solid], [x[1] for x in solid], [h for h in eh if h is not None])
                if found:
                    keys.append(key)
                    rows.append([solid[i][2] for i in found])
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(rows, pa.list_(pa.int32()))], names=["key", "lines"])

    part = sides.mapInArrow(align, "key struct<id:bigint,th:bigint>, lines array<int>").groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))
    # Later documents of a class lose everything.
    copies = marked.select("key", "same").join(firsts, "same").where("key <> first").select("key").distinct()
    fate = part.withColumn("all", F.lit(False)).unionByName(copies.select("key", F.lit(None).cast("array<int>").alias("lines"), F.lit(True).alias("all")))
    total = F.aggregate("ws", F.lit(0), lambda a, x: a + x)
    every = F.when(total >= BLOCK_WORDS, F.sequence(F.lit(0), F.size("hs") - 1)).otherwise(F.array().cast("array<int>"))
    removed = F.when(F.col("all"), every).otherwise(F.coalesce("lines", F.array().cast("array<int>")))
    return lists.join(fate, "key", "left").select("doc_id", "key", F.size("hs").cast("long").alias("n_lines"), removed.alias("removed"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", drop_empty: bool = True) -> DataFrame:
    """docs with the repeated lines taken out of the texts; columns as they were, whatever their names.

    Documents that lose all their lines go if `drop_empty`; others that had no words stay, null
    texts too. Rows that repeat an id and a text lose the same lines, and each stays or goes alike.
    """
    found = repeated_lines(docs, text, doc_id).where(F.size("removed") > 0).select("key.id", "key.th", F.col("removed").alias("gone"), "n_lines").dropDuplicates(["id", "th"])
    # The row as a struct keeps its columns' names apart from ours.
    mine = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[doc_id].cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(docs[text]).alias("th"))
    both = mine.join(found, ["id", "th"], "left")
    if drop_empty:
        both = both.where(F.col("gone").isNull() | (F.size("gone") < F.col("n_lines")))
    old = F.col("row").getField(text)
    left = F.array_join(F.filter(F.split(old, "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return both.select(*[(F.when(F.col("gone").isNull(), old).otherwise(left) if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
