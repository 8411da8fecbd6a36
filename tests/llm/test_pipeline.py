"""The stages of the pipeline over rows with nulls, empty texts, repeated ids, ties and columns of clashing names."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon".split()
EXTRA = ["size", "score", "_id", "_text", "_kept", "row", "id", "th", "key", "keep", "copy", "target"]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + (str(rng.integers(0, 50)) if rng.random() < 0.6 else "") for i in rng.integers(0, len(WORDS), n))


ITEM = prose(900, 30)
ROWS = [
    (1, prose(1, 80), "a", "s1"),
    (2, prose(1, 80), "a", "s1"),
    (3, prose(1, 79) + " other", "a", "s2"),
    (4, prose(4, 60), "b", "s2"),
    (4, prose(5, 60), "b", "s2"),
    (4, prose(5, 60), "b", "s2"),
    (6, None, "a", None),
    (7, "", "a", "s1"),
    (8, "12 34 !", "b", "s3"),
    (9, prose(9, 20) + " " + ITEM + " " + prose(10, 20), "b", "s3"),
    (None, prose(11, 40), None, "s3"),
    (12, prose(12, 30) + "\n" + prose(13, 20), "a", "s1"),
    (13, prose(14, 30) + "\n" + prose(13, 20) + "\n" + prose(15, 9), "a", "s1"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), *[f"{c}{i}" for c in EXTRA]) for i, r in enumerate(ROWS)], SCHEMA)


@pytest.fixture(scope="module")
def top(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def whole(rows):
    """The place of each row in ROWS, by its extra columns, which must have stayed together."""
    out = []
    for r in rows:
        places = {re.sub(r"^\D+", "", r[c]) for c in EXTRA}
        assert len(places) == 1 and all(r[c] == c + places.copy().pop() for c in EXTRA)
        out.append(int(places.pop()))
    return sorted(out)


def test_language(spark, docs, top):
    out = corpus_pipeline.identify_language(spark, docs, top)
    assert out.columns == docs.columns and whole(out.collect()) == [i for i, r in enumerate(ROWS) if re.search("[a-z]", r[1] or "")]


def test_lines(spark, docs, top):
    out = corpus_pipeline.drop_repeated_lines(spark, docs, top)
    got = {i: r for r in out.collect() for i in whole([r])}
    assert out.columns == docs.columns and set(got) == set(range(len(ROWS))) - {1}
    assert got[12].text == prose(14, 30) + "\n" + prose(15, 9) and got[12].n_chars == len(got[12].text)
    assert all(got[i].text == ROWS[i][1] for i in set(got) - {12})


def test_near(spark, docs, top):
    out = corpus_pipeline.drop_near_duplicates(spark, docs, top)
    rows = out.collect()
    got = whole(rows)
    assert out.columns == docs.columns and set(range(len(ROWS))) - set(got) <= {1, 2, 4, 5} and not {1, 2} & set(got) and len({4, 5} & set(got)) == 1
    assert whole(corpus_pipeline.drop_near_duplicates(spark, docs.repartition(5), top).collect()) == got
    one = docs.where("doc_id <> 4")
    assert whole(corpus_pipeline.drop_near_duplicates(spark, one, top).collect()) == [i for i, r in enumerate(ROWS) if r[0] not in (2, 3, 4, None)]


def test_leaks(spark, docs, top):
    out = corpus_pipeline.drop_leaks(spark, docs, top)
    assert out.columns == docs.columns and whole(out.collect()) == [i for i in range(len(ROWS)) if i != 9]


def test_mix(spark, docs, top):
    out = corpus_pipeline.mix_sources(spark, docs, top)
    rows = out.collect()
    kept = [c for c in docs.columns if c not in ("size", "target", "copy")]
    assert out.columns == [*kept, "size", "source_size", "target", "copies", "copy"]
    by = Counter(r["_id"] for r in rows)
    assert all(by[r["_id"]] == r["copies"] and 1 <= r["copy"] <= r["copies"] <= 3 and r["size"] == len((r["text"] or "").split()) for r in rows)
    want = corpus_pipeline.mixing.mix(docs).agg(F.sum("copies")).first()[0]
    assert len(rows) == want and len({(r["_id"], r["copy"]) for r in rows}) == want


def test_empty(spark, docs, top):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), top).count() == 0


def test_run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = {r["_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ids <= {f"_id{i}" for i in (0, 3, 4, 5, 10, 11, 12)} and len(ids) >= 3
