"""The operators as queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import decontaminate, language_id, line_dedup, lm_scoring, mixing, near_dedup, pii, quality_rules, suffix_dedup, token_counts
from mosaiq.llm.common import documents, fold


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = fold(docs.doc_id, 4) == 2
    profiles = language_id.train_profiles(docs.where(~out))
    return language_id.identify(docs.withColumn("held_out", out), profiles, keep=("doc_id", "held_out"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir)
    docs = docs.withColumn("held_out", fold(docs.doc_id, 5) == 1)
    return lm_scoring.score(docs, ~docs.held_out, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep=("held_out",))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir))
    counts = [pii.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"), F.size("secrets").cast("long").alias("n_secret"), (F.size("spans") + F.size("secrets")).cast("long").alias("n_found"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(documents(spark, sf_dir))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.repeated_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(documents(spark, sf_dir), texts=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_token_counts": op2_token_counts,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_quality_rules": op6_quality_rules,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op7_minhash_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
        one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id
                GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
        reach AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, b.v FROM reach r JOIN both_ways b ON r.seen = b.u)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
        FROM s JOIN (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
    """,
    "op6_quality_rules": f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
        w AS (SELECT *, {_WORDS.format("t")} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
        g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
        again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
        rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + d AS p FROM again, (VALUES (0), (1), (2)) AS v(d)) GROUP BY doc_id),
        lines AS (SELECT doc_id, host, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS l, len({_WORDS.format("l")}) AS words FROM (SELECT doc_id, host, unnest(ls) AS l FROM w)),
        common AS (SELECT host, l FROM lines GROUP BY host, l HAVING count(DISTINCT doc_id) > 10),
        cut AS (SELECT doc_id, sum(words) AS n FROM lines SEMI JOIN common USING (host, l) GROUP BY doc_id),
        f AS (SELECT w.doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(t) - len(translate(t, '#*$%&|<>', '')) AS n_symbols,
                len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(cut.n, 0) AS c
              FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN cut USING (doc_id))
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
            CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
            n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(c AS BIGINT) AS n_line_words_cut,
            NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - c) >= 50 * n_words AS kept
        FROM f
    """,
}
