from __future__ import annotations

import math
import random

import numpy as np
import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F

from quarrystone.llm.queries import ORACLE_SQL, QUERIES
from quarrystone.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, score double, list int"


def brute(rows, asks, k=5, scale=256):
    """Every query row's best, rows that are equal in id and integers taken once."""
    whole = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            row = (i, tuple(math.floor(scale * float(np.float32(x))) for x in v))
            whole += [row] * (row not in whole)
    out = []
    for q in whole:
        if asks(q[0]):
            scored = sorted((-sum(x * y for x, y in zip(q[1], c[1], strict=False)), c[0]) for c in whole if c != q)
            out += [(q[0], n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def got(df, asks, **options):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, asks, **options).collect())


@pytest.mark.parametrize("options", [{}, {"lists": 1}, {"lists": 4, "depth": 6}, {"lists": 3, "block_rows": 40, "chunk_rows": 7, "depth": 1}, {"k": 300}])
def test_scores_are_those_of_all_pairs(spark, options):
    rng = np.random.default_rng(12)
    rows = [(k, rng.standard_normal(10).tolist()) for k in range(250)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(df, F.col("vec_id") % 10 == 0, **options) == brute(rows, lambda i: i % 10 == 0, options.get("k", 5))


def test_copies_ties_and_zero_vectors(spark):
    rng = random.Random(3)
    rows = [(k, [1.0, 0.0, 2.0]) for k in range(0, 400, 2)] + [(k, [float(rng.randrange(-1, 2)) for _ in range(3)]) for k in range(1, 400, 2)]
    rows += [(1000, [0.0, 0.0, 0.0]), (1001, [0.0, 0.0, 0.0]), (4, [1.0, 0.0, 2.0]), (4, [-1.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for options in ({}, {"block_rows": 5, "chunk_rows": 2}):
        assert got(df, F.col("vec_id") % 4 == 0, **options) == brute(rows, lambda i: i % 4 == 0)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.5], [0.0, 0.0], None, [], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0], [2.0, 1.0, 7.0], [-0.001, 0.001]]
    rows = [(k, v) for k, v in enumerate(vectors)] + [(None, [1.0, 1.0]), (0, [1.0, 0.5]), (0, [3.0, 0.0])]
    df = spark.createDataFrame([(*r, 0.5, 3) for r in rows], SCHEMA)
    assert got(df, F.col("vec_id") % 2 == 0) == brute(rows, lambda i: i % 2 == 0)
    assert got(df, F.lit(None).cast("boolean")) == [] and got(df.where("vec_id > 99"), F.lit(True)) == []
    assert got(df.where("vec_id = 7"), F.lit(True)) == []


def test_components_beyond_a_double_are_multiplied_exactly(spark):
    rows = [(0, [2.0**45, 3.0]), (1, [5.0, 2.0**40 + 2.0**18]), (2, [-(2.0**12), 7.0]), (3, [1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = got(df.where("vec_id < 3"), F.col("vec_id") < 3, scale=1)
    assert found == sorted((q, n, i, s) for q, best in ((0, [(1, 5 * 2**45 + 3 * (2**40 + 2**18)), (2, 21 - 2**57)]), (1, [(0, 5 * 2**45 + 3 * (2**40 + 2**18)), (2, -5 * 2**12 + 7 * (2**40 + 2**18))]), (2, [(1, -5 * 2**12 + 7 * (2**40 + 2**18)), (0, 21 - 2**57)])) for n, (i, s) in enumerate(best, 1))
    assert len(got(df, F.lit(True))) == 12


def test_op12_equals_its_sql(spark, sf):
    assert_same(QUERIES["op12_topk"](spark, sf).toPandas(), connect(sf).execute(ORACLE_SQL["op12_topk"]).df())
