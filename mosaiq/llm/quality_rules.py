"""Quality rules: lines that many documents of one host share are taken out, and depleted documents rejected.

All of it is DataFrame expressions: word windows are hashed and sorted inside the arrays of a row,
and only line hashes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import WORD, row_key
from mosaiq.scratch import Scratch

#: A line in more documents of a host than this is boilerplate; a document keeps at least this percentage of its words.
MAX_DOCS_PER_HOST, MIN_LEFT_PERCENT = 10, 50
#: Copies that the list of boilerplate lines is dealt in, so that one line's documents meet in many tasks.
SALTS = 16


def _repeat_words() -> Column:
    """Words that lie in 3-word windows found twice or more, from `_w`: sorts (hash, position) and compares neighbours."""
    n = F.size("_w")
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    return F.when(n < 4, F.array().cast("array<bigint>")).otherwise(hashes)


def _covered(found: Column) -> Column:
    """Positions under 3-long windows that start at the ascending positions found."""
    nexts = F.transform(found, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(found, i + 1) - x, F.lit(3))))
    return F.aggregate(nexts, F.lit(0), lambda a, x: a + x)


def document_facts(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: its id, key, host, the base counts and `lines` (hash and words of each line with a word)."""
    t = F.coalesce(docs[text], F.lit(""))
    df = docs.select(docs[doc_id].alias("doc_id"), row_key(docs[doc_id], docs[text]).alias("key"), F.coalesce(F.xxhash64(docs[host]), F.lit(0)).alias("host"), t.alias("_t"))
    df = df.withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    df = df.withColumn("_h", _repeat_words())
    df = df.withColumn("_lines", F.filter(F.transform(F.split("_t", "\n", -1), lambda x: F.struct(F.xxhash64(F.lower(F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))).alias("h"), F.xxhash64(x).alias("exact"), F.regexp_count(x, F.lit(WORD)).alias("words"))), lambda s: s["words"] > 0))
    sorted_h = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), sorted_h))
    again = F.filter("_s", lambda s, k: (s["h"] == F.get("_s", k - 1)["h"]) | (s["h"] == F.get("_s", k + 1)["h"]))
    df = df.withColumn("_again", F.sort_array(F.transform(again, lambda s: s["i"])))
    words = F.size("_w").cast("long")
    return df.select(
        "doc_id", "key", "host",
        words.alias("n_words"),
        (F.length("_t") - F.length(F.regexp_replace("_t", WORD, ""))).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct(F.transform("_lines", lambda s: s["exact"])))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_s").isNull(), 0).otherwise(_covered(F.col("_again"))).cast("long").alias("n_repeat_words"),
        F.transform("_lines", lambda s: F.struct(s["h"].alias("h"), s["words"].cast("int").alias("words"))).alias("lines"),
    )


def quality(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id", max_docs: int = MAX_DOCS_PER_HOST, min_left: int = MIN_LEFT_PERCENT) -> DataFrame:
    """doc_id, the base counts, base_failed, n_line_words_cut and kept, for every row.

    A line is normalised (lower case, single spaces) and hashed; where more than `max_docs`
    distinct documents of a host have it, it is taken out of all of them. kept: base_failed is
    false and at least `min_left` percent of the words are left. Null texts have no words and fail;
    null hosts are one host; rows that repeat id and text are one document and get the same verdict;
    empty tables give empty results.
    """
    cuts = Scratch(docs.sparkSession, "quality")
    facts = cuts.cut(document_facts(docs, text, host, doc_id), "facts")
    # Distinct lines of a document; map-side counts come before each shuffle.
    lines = facts.select("host", "key", F.explode("lines").alias("l")).select("host", "key", "l.h", "l.words")
    per_doc = lines.groupBy("host", "h", "key").agg(F.sum("words").alias("words"))
    common = per_doc.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_docs).drop("n")
    common = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = facts.select("host", "key", F.explode("lines").alias("l")).select("host", "key", "l.h", "l.words").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    gone = held.join(common, ["host", "h", "salt"], "left_semi").groupBy("host", "key").agg(F.sum("words").alias("_gone"))
    # Rows that repeat id, text and host each hold the lines once.
    copies = facts.groupBy("host", "key").agg(F.count(F.lit(1)).alias("_copies"))
    gone = gone.join(copies, ["host", "key"]).select("host", "key", (F.col("_gone") / F.col("_copies")).cast("long").alias("_gone"))
    cut = F.coalesce("_gone", F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = 100 * (F.col("n_words") - cut) >= min_left * F.col("n_words")
    return facts.drop("lines").join(gone, ["host", "key"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), cut.alias("n_line_words_cut"), (~failed & left).alias("kept"),
    )
