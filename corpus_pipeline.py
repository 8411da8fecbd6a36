"""A corpus pipeline of five text operators: each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.llm import decontaminate, language_id, line_dedup, mixing, near_dedup
from mosaiq.llm.common import documents, fold
from mosaiq.scratch import Scratch

#: Five-word shingles at a similarity of 0.8; 32 bands of 4 miss a pair at 0.8 in 5e-8 of the cases.
NEAR = near_dedup.Params(k=5, percent=80, bands=32, rows=4)


def _packed(docs: DataFrame) -> DataFrame:
    """(row, id, th): the row as a struct, so that no name of its columns meets one of ours; its id (null as the least integer) and the hash of its text."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs.doc_id.cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(docs.text).alias("th"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts, texts without a letter) go; profiles come from three quarters of the documents.

    Rows that repeat are judged alike; columns stay as they were, whatever their names.
    """
    profiles = language_id.train_profiles(docs.where(fold(docs.doc_id, 4) != 2))
    found = language_id.identify(_packed(docs).select("row", F.col("row.text").alias("text")), profiles, keep=("row",))
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common blocks go from the later documents, and with them documents of which nothing is left.

    Null texts stay. Rows that repeat an id and a text are one document and stay or go alike.
    """
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id (then hash of the text) stays of each group, and one row of those that repeat id and text.

    Different texts under one id are documents of their own. Texts without words, and null texts,
    link with nothing and stay.
    """
    rows = _packed(docs)
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = near_dedup.near_duplicates(docs, p=NEAR).where("kept").select(F.col("doc_id").alias("id")).distinct()
        return rows.join(kept, "id", "left_semi").select("row.*")
    # Numbers in the order of (id, hash) stand for the documents.
    cuts = Scratch(spark, "near_rows")
    cols = F.struct(*[F.col("row").getField(c) for c in docs.columns])
    single = cuts.cut(rows.groupBy("id", "th").agg(F.min_by("row", F.xxhash64(cols)).alias("row")).withColumn("one", F.lit(1)), "single")
    numbered = cuts.cut(mixing.prefix_sums(single, ["id", "th"], {"number": "one"}, cuts, "numbers"), "numbered")
    kept = near_dedup.near_duplicates(numbered.select("number", F.col("row.text").alias("text")), doc_id="number", p=NEAR).where("kept").select(F.col("doc_id").alias("number"))
    return numbered.join(kept, "number", "left_semi").select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go. Null and empty texts hold none; each row is judged by its own text."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy that the mix takes of a document, with its number and its source's target.

    Null and empty texts keep one copy. Columns of the names of the added ones are replaced. Rows
    that repeat id and text are numbered, and each gets its own copies.
    """
    added = ("size", "source_size", "target", "copies", "copy")
    mixed = mixing.mix(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.col("text_hash").alias("th"), "size", "source_size", "target", "copies")
    rows, on = _packed(docs.drop(*added)), ["id", "th"]
    if not rows.groupBy(*on).count().where("count > 1").isEmpty():
        rows = rows.withColumn("again", F.row_number().over(W.partitionBy(*on).orderBy(F.xxhash64("row"))))
        mixed = mixed.withColumn("again", F.row_number().over(W.partitionBy(*on).orderBy("copies", "size")))
        on = [*on, "again"]
    out = rows.join(mixed.where("copies > 0"), on)
    return out.select("row.*", *added[:-1], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]
#: SQL can't express the trained and iterative stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written and read again."""
    cuts, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = cuts.cut(stage(spark, docs, sf_dir), name)
    return docs
