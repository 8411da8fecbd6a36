"""Language identification with rank-order n-gram profiles.

A profile is the list of a language's most frequent n-grams, most frequent first. A text gets the
language whose profile is nearest to its own by the out-of-place distance: the sum, over the
text's n-grams, of the difference in rank, or the profile length where the profile lacks one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import batches

#: n-grams in a profile, and their greatest length (3 fit a 64-bit key).
LENGTH, ORDERS = 300, (1, 2, 3)
#: Distinct n-grams that a task holds before it hands on its counts.
HELD = 500_000
UNKNOWN = "und"


def _points(text: str) -> np.ndarray:
    """Code points of the lower-cased words, all that isn't a letter as one space, with spaces around."""
    import regex

    return np.frombuffer((" " + " ".join(regex.findall(r"\p{L}+", text.lower())) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)


def _grams(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed n-grams without the lone space, ascending, and their counts."""
    if len(p) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.sort(np.concatenate([p, p[:-1] << 21 | p[1:], p[:-2] << 42 | p[1:-1] << 21 | p[2:]]))
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    keys, n = codes[at], np.diff(np.append(at, len(codes)))
    return keys[keys != 32], n[keys != 32]


def _ranked(keys: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """The most frequent first; ties in the order of the keys."""
    return keys[np.lexsort((keys, -n))[:length]]


def train_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", length: int = LENGTH) -> DataFrame:
    """(lang, rank, gram): profiles counted over the whole texts of all rows whose lang is not null.

    Null and empty texts add nothing. Ties in frequency rank by the packed n-gram.
    """
    rows = docs.where(docs[lang].isNotNull() & docs[text].isNotNull()).select(docs[lang].alias("lang"), docs[text].alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, (k, n) in held.items():
                for i in range(0, len(k), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(k[i : i + 100_000])), pa.array(k[i : i + 100_000]), pa.array(n[i : i + 100_000])], names=["lang", "gram", "n"])
            held.clear()

        for b in batches(it, 500_000):
            texts: dict[str, list[str]] = {}
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.setdefault(name, []).append(t)
            for name, ts in texts.items():
                k, n = _grams(_points("\n".join(ts)))
                if name in held:
                    k, inv = np.unique(np.concatenate([held[name][0], k]), return_inverse=True)
                    n = np.bincount(inv, np.concatenate([held[name][1], n]), len(k)).astype(np.int64)
                held[name] = k, n
            if sum(len(k) for k, _ in held.values()) > HELD:
                yield from out()
        yield from out()

    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The best `length` of each of some salts hold the best of the language: no task sorts all its n-grams.
    from pyspark.sql import Window as W

    order = [F.desc("n"), F.asc("gram")]
    some = counts.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(16)))
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= length)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= length).select("lang", F.col("rank").cast("int").alias("rank"), "gram")


def identify(docs: DataFrame, profiles: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), length: int = LENGTH) -> DataFrame:
    """`keep` columns, lang_pred and score of every row.

    Only the text is read. lang_pred is `und` with score 0 where the text is null or has no letter,
    or there is no profile. Ties go to the language that sorts first. score: how much nearer the
    best language is than the next (or than the greatest distance), from 0 to 1. The profiles are
    collected: `length` n-grams for each language. Kept columns of the names of results are replaced;
    other columns are not read, whatever their names. Rows that repeat are rows of their own.
    """
    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))
    got = profiles.collect()
    names = sorted({r.lang for r in got})
    grams = np.array(sorted({r.gram for r in got}), np.int64)
    ranks = np.full((len(names), len(grams) + 1), -1, np.int32)
    for r in got:
        ranks[names.index(r.lang), np.searchsorted(grams, r.gram)] = r.rank - 1
    cols = docs.select(F.struct(*[docs[c] for c in keep]).alias("keep"), docs[text].alias("text"))
    schema = cols.drop("text").schema.add("lang_pred", "string").add("score", "double")

    def one(t: str | None) -> tuple[str, float]:
        mine = _ranked(*_grams(_points(t)), length) if t and names else ()
        if not len(mine):
            return UNKNOWN, 0.0
        at = np.searchsorted(grams, mine)
        at[(at == len(grams)) | (grams[np.minimum(at, len(grams) - 1)] != mine)] = len(grams)
        theirs = ranks[:, at]
        far = np.where(theirs < 0, length, np.abs(theirs - np.arange(len(mine)))).sum(axis=1)
        best = int(far.argmin())
        other = np.delete(far, best).min() if len(far) > 1 else length * len(mine)
        return names[best], float(other - far[best]) / float(other) if other else 0.0

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            found = [one(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["keep", "lang_pred", "score"])

    return cols.mapInArrow(run, schema).select("keep.*", "lang_pred", "score")
