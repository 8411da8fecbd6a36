"""Small things that the operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space, tab, and the bytes 0x0A to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, mod folds; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart where doc_id repeats or is null; rows with the same id and text share it."""
    return F.struct(F.coalesce(doc_id, F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("h"), F.coalesce(F.length(text), F.lit(-1)).alias("n"))


def batches(it: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices with at most `most` bytes, or one row, so that kernels stay within bounded memory."""
    for b in it:
        if b.num_rows:
            size = max(1, b.nbytes // b.num_rows)
            step = max(1, most // size)
            for i in range(0, b.num_rows, step):
                yield b.slice(i, step)


def most_frequent(df: DataFrame, n: str, most: int) -> DataFrame:
    """Rows of df of the greatest counts `n`, `most` at most: all whose count is in the highest eighths of powers of two that fit together.

    Only the sizes of these classes, some hundred, are collected.
    """
    kind = F.floor(F.log2(n) * 8)
    sizes = sorted(df.groupBy(kind.alias("k")).agg(F.count(F.lit(1)).alias("m")).collect(), reverse=True)
    least, room = None, most
    for k, m in sizes:
        if m > room:
            break
        least, room = k, room - m
    return df.where(F.lit(False)) if least is None else df.where(kind >= least)


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


def shuffles_removed(spark: SparkSession):  # noqa: ANN201
    """Within it, what a query has shuffled is deleted at its end: for queries that are run inside it, once."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def arrow_rows(spark: SparkSession, rows: int = 1000):  # noqa: ANN201
    """Within it, Spark sends Python so many rows at a time at most: for tables of long rows that are written inside it."""
    return _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
