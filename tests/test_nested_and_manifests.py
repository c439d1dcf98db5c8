"""Nested values, manifests and rejects on hand-worked rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quarrystone.functions import nested as N
from quarrystone.operators.records import input_postfixes, manifest_counts, refresh_manifest, screening_summary, split_rejects


def test_nested_values(spark):
    values = [{"a": [1] * 5, "b": {"c": [1] * 5, "d": [[2] * 9, [3], "long text  here"], "e": None}}, [1, [2] * 5, None, "xé"], [0] * 7, "long text  here", 3, None]
    rows = [(k, json.dumps(v)) for k, v in enumerate(values)] + [(10, None), (11, "{no json"), (12, "[" * 100_000)]
    df = spark.createDataFrame(rows, "k int, t string")
    load = lambda c: {r.k: r.v and json.loads(r.v) for r in df.select("k", c.alias("v")).collect()}
    assert load(N.drop_long_lists_nested(F.col("t"), 5)) == {0: {"b": {"d": [[3], "long text  here"], "e": None}}, 1: [1, "xé"], 2: None, 3: "long text  here", 4: 3, 5: None, 10: None, 11: None, 12: None}
    assert load(N.truncate_nested(F.col("t"), 11))[0]["b"]["d"][2] == "long text...[truncated]" and load(N.truncate_nested(F.col("t"), 0))[3] == "long text  here"
    texts = {r.k: r.v for r in df.select("k", N.nested_text(F.col("t")).alias("v")).collect()}
    assert texts[1] == "1 2 2 2 2 2  xé" and texts[0].endswith("3 long text  here") and texts[5] == "" and texts[10] is None and texts[12] is None


def test_manifests(spark):
    missing = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b"), ("t", 3, "b"), ("t", 4, "c"), ("t", 5, "e"), ("u", 1, "b")], "task string, ordinal int, path string")
    existing = spark.createDataFrame([("t", 9, "c"), ("t", 8, "gone")], "task string, ordinal int, path string")
    files = spark.createDataFrame([("b",), ("c",), ("b",)], "path string")
    got = refresh_manifest(missing, existing, files)
    assert {tuple(r) for r in got.collect()} == {("t", 9, "c", "existing"), ("t", 8, "gone", "existing"), ("t", 2, "b", "existing"), ("u", 1, "b", "existing"), ("t", 1, "a", "missing"), ("t", 5, "e", "missing")}
    assert {tuple(r) for r in manifest_counts(got).collect()} == {("t", 3, 2, 5), ("u", 1, 0, 1)}


def test_rejects(spark):
    good, bad = split_rejects(spark.createDataFrame([(1, 5), (2, None), (3, 50)], "k int, v int"), {"some": F.col("v") > 0, "few": F.col("v") < 9})
    assert [r.k for r in good.collect()] == [1] and {(r.k, *r.violations) for r in bad.collect()} == {(2, "some", "few"), (3, "few")}


def test_postfixes_in_order_of_priority(spark):
    comparisons = [("t", 1, "_a", "_b"), ("t", 2, None, "_b"), ("t", 3, "_z", None), ("u", 1, "_z", None), ("v", 1, None, None), ("w", 1, None, "_q"), ("t", 9, "_a", None)]
    c = spark.createDataFrame(comparisons, "task string, comparator int, explicit string, mapped string")
    files = spark.createDataFrame([("t", "_b"), ("t", "_a"), ("u", None), ("u", "_c"), ("v", "_k"), ("v", "_j")], "task string, postfix string")
    done = spark.createDataFrame([("t", 9)], "task string, comparator int")
    got = {(r.task, r.comparator): r.postfix for r in input_postfixes(c, files, done, ["explicit", "mapped"]).collect()}
    assert got == {("t", 1): "_a", ("t", 2): "_b", ("t", 3): None, ("u", 1): "", ("v", 1): "_j", ("w", 1): None}


def test_summaries(spark):
    rows = [("a", n, v) for n, v in enumerate(["Included", " Included ", "Excluded", None, "Included", "Included"])] + [(None, 9, "Excluded")]
    df = spark.createDataFrame(rows, "g string, n int, v string")
    got = {r.g: (r.total_screened, r.total_included, r.total_excluded, [x.n for x in r.sample_included]) for r in screening_summary(df, "g", "n", "v", {"n": F.col("n")}).collect()}
    assert got == {"a": (6, 4, 1, [0, 1, 4]), None: (1, 0, 1, [])}
