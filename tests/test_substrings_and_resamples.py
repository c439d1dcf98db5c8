"""Substring joins against all pairs, exact resamples by their moments."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.operators import retrieval
from quarrystone.operators.records import match_uploads
from quarrystone.operators.retrieval import holding, substring_join
from quarrystone.operators.statistics import resampled


@pytest.mark.parametrize("anchor", [1, 3, 8])
def test_substrings_of_all_lengths(spark, anchor):
    rng = random.Random(14)
    some = lambda n: "".join(rng.choices("abé😀 \n.", k=n))
    texts = [(k, some(rng.randrange(40))) for k in range(80)] + [(90, None), (91, ""), (92, "a" * 30_000 + "b")]
    keys = [(k, some(rng.randrange(7))) for k in range(60)] + [(70, "a" * 12), (71, None), (72, ""), (73, "a" * 50 + "b")]
    got = substring_join(spark.createDataFrame(texts, "i long, t string"), spark.createDataFrame(keys, "k long, key string"), "t", "key", anchor=anchor)
    assert sorted((r.i, r.k) for r in got.collect()) == sorted((i, k) for i, t in texts for k, x in keys if t and x and x in t)


@pytest.mark.parametrize("few", [0, retrieval.BROADCAST_ROWS])
def test_substrings_across_parts_and_groups(spark, monkeypatch, few):
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", few)
    monkeypatch.setattr(retrieval, "PART_TERMS", 16)  # of bytes looked through at once
    rng = random.Random(22)
    some = lambda n: "".join(rng.choices("ab\0é", k=n))
    texts = [(k % 50, rng.choice("xy"), some(rng.randrange(120))) for k in range(90)] + [(90, None, "ab"), (91, "x", None), (92, "x", "")]
    keys = [(rng.choice("xy"), k, some(rng.randrange(2, 14))) for k in range(60)] + [("x", 70, texts[3][2]), (None, 71, "ab"), ("y", 72, "ab"), ("y", 72, "ab"), ("x", 73, "")]
    got = substring_join(spark.createDataFrame(texts, "i long, g string, t string"), spark.createDataFrame(keys, "g string, k long, key string"), "t", "key", on=["g"])
    assert sorted(got.columns) == ["g", "i", "k", "key", "t"]
    assert sorted((r.i, r.k) for r in got.collect()) == sorted((i, k) for i, a, t in texts for b, k, x in keys if a and a == b and t and x and x in t)


def test_few_substrings_shuffle_nothing(spark, sf):
    """each window of a text was a row, and what had met was shuffled."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    keys = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("item_id", "substr(text, 1, 20) AS key")
    plan = substring_join(docs, keys, "text", "key")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan
    assert "hashpartitioning" not in plan


def test_windows_of_no_key_stay(spark):
    rng = random.Random(3)
    texts = spark.createDataFrame([(k, "".join(rng.choices("abcdefghij", k=20_000)) + "needle") for k in range(5)], "i long, t string")
    asked = spark.createDataFrame([("needle", 6)], "key string, _n int").withColumn("_w", retrieval._first_window(F.col("key"), 8))
    assert retrieval._windows_met(texts, "t", asked, "key", ["i"]).count() == 5


def test_short_passages(spark):
    texts = spark.createDataFrame([(1, "one two three four five six"), (2, "two  three"), (3, None)], "idx long, text string")
    asked = spark.createDataFrame([(1, "two three four five six"), (2, "o t"), (3, "two  t"), (4, ""), (5, "two three")], "q long, question string")
    assert {tuple(r) for r in holding(texts, asked).collect()} == {(1, 1), (2, 1), (3, 2), (4, 1), (4, 2), (5, 1)}


def test_uploads(spark):
    missing = [("a", 1, "PMID12"), ("a", 2, "12"), ("a", 3, ""), ("b", 1, "zz"), ("c", 2, "x"), ("c", 1, "X1")]
    uploads = [("a", 1, "dir/my pmid12.pdf", None), ("a", 2, "34.12", None), ("a", 3, "412.tar.gz", None), ("a", 4, "none.pdf", "12"), ("a", 5, "pmid12", "12"), ("b", 6, "other.pdf", "?"), ("c", 7, ".x1", None), ("c", 8, None, None), ("d", 9, "q", "q")]
    m = spark.createDataFrame([(*r, f"{r[0]}{r[1]}") for r in missing], "task string, ordinal int, paper_uid string, path string")
    got = match_uploads(spark.createDataFrame(uploads, "task string, upload long, file_name string, target_uid string"), m)
    assert {r.upload: r.path for r in got.collect()} == {1: "a1", 2: None, 3: "a2", 4: "a2", 5: "a1", 6: "b1", 7: "c1", 8: None, 9: None}


@pytest.mark.parametrize("leaf_cells", [1, 7, 1000])
def test_resamples_are_multinomial(spark, leaf_cells):
    rows = [(g, c) for g, sizes in (("x", [50, 30, 15, 5, 1]), ("y", [9])) for c, n in enumerate(sizes) for _ in range(n)] + [(None, 3)]
    df = spark.createDataFrame(rows, "g string, c long")
    drawn = resampled(df, ["c"], ["g"], 2000, leaf_cells=leaf_cells)
    once = sorted(map(tuple, drawn.collect()))
    assert once == sorted(map(tuple, resampled(df.repartition(5), ["c"], ["g"], 2000, leaf_cells=leaf_cells).collect()))
    assert {(r.g, r.n) for r in drawn.groupBy("g", "replicate").agg(F.sum("copies").alias("n")).collect()} == {("x", 101), ("y", 9)}
    counts = np.zeros((2001, 5))
    for g, replicate, c, copies in once:
        if g == "x":
            counts[replicate, c] = copies
    p = np.array([50, 30, 15, 5, 1]) / 101
    assert np.abs(counts[1:].mean(axis=0) - 101 * p).max() < 0.5
    want = 101 * (np.diag(p) - np.outer(p, p))
    assert np.abs(np.cov(counts[1:].T) - want).max() < 3


def test_resamples_without_groups_and_of_nothing(spark):
    df = spark.createDataFrame([(k % 3, k % 2) for k in range(60)], "a long, b long")
    assert {r.n for r in resampled(df, ["a", "b"], replicates=20).groupBy("replicate").agg(F.sum("copies").alias("n")).collect()} == {60}
    assert resampled(df.where("a > 9"), ["a"], replicates=5).count() == 0
