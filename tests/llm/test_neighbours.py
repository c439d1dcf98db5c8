from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.llm.neighbours import fit, search


def brute(rows, queries, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q, v in zip(ids, x, strict=True):
        if q in queries:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
            out[q] = [(int(ids[j]), d[j]) for j in order]
    return out


def recall(df, k=10, **options):
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, {i for i, _ in rows if i % 10 == 0}, k)
    got = {}
    for r in search(df, F.col("vec_id") % 10 == 0, k, **options).orderBy("query_id", "rank").collect():
        held = got.setdefault(r.query_id, [])
        assert r["rank"] == len(held) + 1
        held.append((r.vec_id, r.score))
    assert set(got) == set(want)
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (x[1], x[0])) and len(found) == len(want[q])
        exact = dict(brute([x for x in rows], {q}, len(rows))[q])
        assert all(s == pytest.approx(exact[i], abs=1e-12) for i, s in found)
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_recall(spark, sf):
    assert recall(spark.read.parquet(f"{sf}/embeddings.parquet")) >= 0.9


def test_recall_of_a_deeper_tree_in_small_blocks(spark, sf):
    assert recall(spark.read.parquet(f"{sf}/embeddings.parquet"), leaf_rows=8, cell_rows=40, branch=4, block_rows=20, sample_rows=200) >= 0.9


def test_a_very_common_vector_keeps_its_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(400)] + [(1000 + k, rng.standard_normal(3).tolist()) for k in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search(df, F.col("vec_id") == 0, block_rows=50).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(k, 0.0) for k in range(1, 11)]


def test_awkward_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, None, 1), (3, [], 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [None, 1.0], 1), (8, [1.0], 1), (None, [1.0, 1.0], 1), (9, [1.0, 0.0], 1), (9, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf int")
    got = search(df, F.col("vec_id") < 9).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {0, 1} and {r.vec_id for r in got} == {0, 1, 9}
    assert search(df.where("vec_id < 0"), F.lit(True)).count() == 0
    assert search(df, F.lit(False)).count() == 0


def test_leaves_grow_with_the_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, x.tolist()) for k, x in enumerate(rng.standard_normal((4000, 4)))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    few, many = (fit(df.where(F.col("id") < n), n, sample_rows=500, cell_rows=100, leaf_rows=20) for n in (1000, 4000))
    assert many.leaves > 2.5 * few.leaves
    x = np.array([v for _, v in rows])
    assert np.bincount(many.assign(x), minlength=many.leaves).sum() == len(x)
    assert sorted(many.visits(x[0])) == list(range(many.leaves))


def test_repeated_query_rows_and_two_vectors_under_one_id(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.standard_normal(3).tolist()) for k in range(60)]
    rows += [rows[10], rows[10], rows[20], (30, [9.0, 9.0, 9.0]), (30, [9.0, 9.0, 9.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = search(df, F.col("vec_id") % 10 == 0, recall=1.0).collect()
    distinct = list({(i, tuple(v)) for i, v in rows})
    want = []
    for i, v in distinct:
        if i % 10 == 0:
            far = sorted((np.sqrt(((np.array(v) - np.array(w)) ** 2).sum()), j) for j, w in distinct if (j, w) != (i, v))
            want += [(i, n, j, round(d, 9)) for n, (d, j) in enumerate(far[:10], 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == sorted(want)
    assert len({r.query_row for r in got if r.query_id == 30}) == 3
