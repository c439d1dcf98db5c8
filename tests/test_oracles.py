"""Every query of the core library against its DuckDB oracle, and those without one on their invariants."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F

from quarrystone.operators import segments, workflow
from quarrystone.operators.evidence import topological_levels
from quarrystone.operators.retrieval import fuzzy_join
from quarrystone.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf, con, name):
    assert_same(QUERIES[name](spark, sf).toPandas(), con.execute(ORACLE_SQL[name]).df())


def test_recursive_chunks_cover_the_text(spark, sf):
    got = QUERIES["t19_recursive_chunks"](spark, sf).toPandas().sort_values(["doc_id", "chunk"])
    assert got.piece.str.len().max() <= 2000
    texts = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id").text
    overlaps = []
    for doc_id, chunks in got.groupby("doc_id"):
        end = 0
        for n, (start, piece) in enumerate(zip(chunks.start, chunks.piece)):
            assert texts[doc_id][start : start + len(piece)] == piece and end - 400 <= start <= end and start + len(piece) > end
            overlaps += [end - start] * (n > 0)
            end = start + len(piece)
        assert end == len(texts[doc_id])
    assert sum(o > 200 for o in overlaps) > len(overlaps) / 2
    assert {k for k, v in texts.items() if v} == set(got.doc_id)


def all_pairs(left, right, least):
    """Cosine of the TF-IDF vectors fitted on each two texts, one by one."""
    terms = lambda t: Counter(re.findall(r"\b\w\w+\b", t.lower()))
    a, b, out = [(k, terms(t)) for k, t in left], [(k, terms(t)) for k, t in right], {}
    weight = lambda own, other: {t: n * (1 if t in other else 1 + math.log(1.5)) for t, n in own.items()}
    for ka, x in a:
        for kb, y in b:
            if x.keys() & y.keys():
                u, v = weight(x, y), weight(y, x)
                s = sum(u[t] * v.get(t, 0) for t in u) / math.sqrt(sum(w * w for w in u.values()) * sum(w * w for w in v.values()))
                if round(s, 6) > least:
                    out[ka, kb] = round(s, 6)
    return out


@pytest.mark.parametrize("least", [0.3, 0.6, 0.9])
def test_fuzzy_join_of_texts_with_repeated_terms(spark, least):
    rng = random.Random(16)
    words = ["renal", "diet", "low", "protein", "dialysis", "of", "adult"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(7)))) for k in range(90)]
    df = spark.createDataFrame(rows, "k int, t string")
    a, b = df.selectExpr("k AS ka", "t AS ta"), df.selectExpr("k AS kb", "t AS tb")
    got = {(r.ka, r.kb): r.similarity for r in fuzzy_join(a, b, "ta", "tb", least).collect()}
    assert got == pytest.approx(all_pairs(rows, rows, least), abs=1e-6)


@pytest.mark.parametrize("depth", [40, 12])
def test_topological_levels_of_any_depth(spark, depth):
    edges = [(k, k + 1) for k in range(depth)] + [(k, depth) for k in range(0, depth, 3)] + [(1000, 2), (1000, 1001)]
    got = {r.node: r.level for r in topological_levels(spark.createDataFrame(edges, "parent long, child long")).collect()}
    assert got == {k: k for k in range(depth + 1)} | {1000: 0, 1001: 1}
    with pytest.raises(ValueError):
        topological_levels(spark.createDataFrame([(1, 2), (2, 1)], "parent long, child long"))


def test_each_distinct_prompt_is_asked_once(spark, tmp_path):
    from quarrystone.plans.workflow import AbstractClient, RevisingClient

    class Counting:
        """Answers by another client and keeps a line for every call."""

        def __init__(self, client, path):
            self.client, self.path = client, path

        def __call__(self, prompt):
            with open(self.path, "a") as f:
                f.write(repr(prompt) + "\n")
            return self.client(prompt)

    rows = spark.createDataFrame([(k, f"abstract|{k}", f"full|{k}") for k in range(20)], "k long, a string, f string")
    first, rounds = str(tmp_path / "first"), str(tmp_path / "rounds")
    assert workflow.extract_first(rows, ["a", "f"], lambda: Counting(AbstractClient(), first)).count() == 20
    out = workflow.search_rounds(rows, "a", lambda: Counting(RevisingClient(), rounds), lambda df: df.withColumn("feedback", F.lit("x")))
    assert out.count() == 20
    for path, least in ((first, 30), (rounds, 40)):
        calls = open(path).read().splitlines()
        assert len(calls) == len({*calls}) >= least


def test_sections_without_a_heading_stay(spark):
    df = spark.createDataFrame([(None,), ("REFERENCES",), ("Reference",), ("References",), ("REFERENCE",), ("Methods",)], "s string")
    assert {r.s for r in segments.skip_sections(df, "s").collect()} == {None, "Methods"}


def test_bootstrap_intervals_hold_the_estimate(spark, sf):
    for interval, estimate in (("u7_bootstrap_recall", "a11_recall_precision"), ("u7_bootstrap_kappa", "a13_kappa")):
        low, high = QUERIES[interval](spark, sf).first()
        assert low <= QUERIES[estimate](spark, sf).first()[0] <= high


def test_choice_is_stable(spark, sf):
    a, b = (sorted(map(tuple, QUERIES["u9_choice"](spark, sf).repartition(n).collect())) for n in (1, 5))
    assert a == b and {x[1] for x in a} == {"P", "I", "C"}
