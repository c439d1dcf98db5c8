"""Vectors by paper, batched model calls, iterated questions, and paged services."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarrystone.operators import model
from quarrystone.operators import workflow as W
from quarrystone.operators.model import model_batches, model_map
from quarrystone.sources import vectors as V
from quarrystone.sources.paged import paged, plan

VECTORS = "paper string, idx long, v array<float>"


def test_the_store_is_searched_in_place(spark):
    rows = [("a" if k % 3 else "b", k, [float(k % 7), 1.0, float(k % 5)]) for k in range(200)] + [("c", 500, [0.0, 0.0, 0.0]), ("c", 501, None), ("c", 502, [1.0])]
    store = V.save_by_paper(spark.createDataFrame(rows, VECTORS), 4, part_rows=40)
    assert store.where("paper = 'a'").select("part").distinct().count() == 4
    asked = [("a", 1, [1.0, 2.0, 3.0]), ("b", 1, [1.0, 0.0, 0.0]), ("a", 2, [0.0, 1.0, 0.0]), ("c", 1, [1.0, 1.0, 1.0]), ("none", 1, [1.0, 1.0, 1.0])]
    found = V.search_by_paper(store, spark.createDataFrame(asked, "paper string, q int, v array<float>"), 6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = []
    for paper, q, x in asked:
        scored = []
        for p, i, v in rows:
            if p == paper:
                size = (sum(a * a for a in v) * sum(a * a for a in x)) ** 0.5 if v and len(v) == 3 else 0
                scored.append((-round(sum(a * b for a, b in zip(v, x)) / size, 6) if size else 0.0, i))
        want += [(paper, q, i, -s, n) for n, (s, i) in enumerate(sorted(scored)[:6], 1)]
    assert sorted(map(tuple, found.collect())) == [pytest.approx(w) for w in sorted(want)]
    at, above = next(n for n, x in enumerate(lines) if "FileScan" in x and ",v#" in x and "Bucketed: true" in x), []
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789"))
    for line in reversed(lines[:at]):
        indent = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if indent < depth:
            depth = indent
            above.append(line)
            if "Join" in line:
                break
    assert "Join" in above[-1] and not any("Exchange" in x for x in above)


def test_upserts_replace_by_paper_and_idx(spark):
    store = V.save_by_paper(spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [2.0]), ("b", 1, [3.0])], VECTORS), 2)
    new = spark.createDataFrame([("a", 2, [9.0]), ("c", 1, [4.0]), ("c", 1, [4.0])], VECTORS)
    assert sorted((r.paper, r.idx, r.v[0]) for r in V.upsert_by_paper(store, new, 3).collect()) == [("a", 1, 1.0), ("a", 2, 9.0), ("b", 1, 3.0), ("c", 1, 4.0)]


def counting(path, bad):
    class Panic(BaseException):
        pass

    class Client:
        def __call__(self, prompts):
            with open(path, "a") as f:
                f.write(f"{len(prompts)}\n")
            if bad & set(prompts):
                raise Panic("no")
            return [p.upper() for p in prompts]

    return Client


def test_a_bad_row_costs_only_itself(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"p{k:02}") for k in range(40)] + [(99, "p00")], "k long, p string")
    calls = tmp_path / "calls"
    got = {r.k: (r.response, r.error) for r in model_batches(rows, "p", counting(calls, {"p07"}), concurrency=1, size=16, in_flight=3).collect()}
    assert got == {k: (f"P{k:02}", None) for k in range(40) if k != 7} | {7: (None, "no"), 99: ("P00", None)}
    sizes = list(map(int, calls.read_text().split()))
    assert max(sizes) == 16 and len(sizes) <= 3 + 2 * 5


def test_replies_that_are_missing_and_panics(spark):
    class Short:
        def __call__(self, prompts):
            return prompts[:1]

    class Panic(BaseException):
        pass

    class Native:
        def __call__(self, prompt):
            raise Panic("native")

    rows = spark.createDataFrame([(k, f"p{k}") for k in range(5)], "k long, p string")
    assert {(r.response, r.error) for r in model_batches(rows, "p", Short, size=4).collect()} == {(f"p{k}", None) for k in range(5)}
    assert {r.error for r in model_map(rows, "p", Native, retries=1).collect()} == {"native"}


def test_only_open_rows_go_on(spark, tmp_path):
    asked_path, written_path = tmp_path / "asked", tmp_path / "written"

    class Asks:
        def __call__(self, prompt):
            with open(asked_path, "a") as f:
                f.write(prompt.replace("\n", "/") + "\n")
            context, question = prompt.split("\n")
            return f"{context} found" if context.endswith(question[-1]) else W.FAILURE

    class Writes:
        def __call__(self, prompt):
            with open(written_path, "a") as f:
                f.write(prompt + "\n")
            n, q = prompt.split("|")
            return f"{n}0\n{n}{q[-1]}\n{n}x" if q != "q5" else "none"

    papers = spark.createDataFrame([(k, f"q{k}") for k in range(6)], "k long, q string")
    retrieve = lambda df: df.withColumn("context", F.when(F.col("k") % 2 == 1, F.when(F.col("query") == F.col("question"), "a").otherwise(F.col("query"))).otherwise(F.concat(F.lit("c"), "k")))
    got = {r.k: (r.answers, r["round"]) for r in W.retrieve_and_ask(papers, "k", "q", Asks, retrieve, Writes).collect()}
    assert got == {0: (["c0 found"], 1), 2: (["c2 found"], 1), 4: (["c4 found"], 1), 1: (["11 found"], 2), 3: (["13 found"], 2), 5: ([], None)}
    assert sorted(written_path.read_text().split()) == ["1|q1", "1|q3", "1|q5", "2|q5"]
    assert len(asked_path.read_text().splitlines()) == len(set(asked_path.read_text().splitlines()))


def test_pages_are_read_once_and_retried_alone(spark, tmp_path):
    assert plan(0) == [] and plan(1000, 400, 150) == [(0, 150), (150, 150), (300, 100), (400, 150), (550, 150), (700, 100), (800, 150), (950, 50)]
    log = str(tmp_path)

    def fetch(start, size):
        seen = f"{log}/{start}"
        with open(seen, "a") as f:
            f.write("x")
        if start == 150 and len(open(seen).read()) < 3:
            raise OSError("busy")
        return pa.table({"n": pa.array(range(start, start + size), pa.int64())})

    df = paged(spark, fetch, 1000, StructType([StructField("n", LongType())]), 400, 150, pause=0.01)
    assert df.rdd.getNumPartitions() == 8 and sorted(r.n for r in df.collect()) == list(range(1000))
    assert {p.name: len(p.read_text()) for p in tmp_path.iterdir()} == {str(s): 3 if s == 150 else 1 for s, _ in plan(1000, 400, 150)}
    with pytest.raises(Exception, match="has 1 of"):
        paged(spark, lambda s, n: pa.table({"n": [1]}), 10, StructType([StructField("n", LongType())]), retries=1).count()


@pytest.mark.parametrize(("reply", "method", "n"), [
    ('{"hybrid": [1, 2], "results": [3]}', "hybrid", 2), ('{"results": [3], "dense_results": [1, 2]}', "Dense ", 2), ('{"hybrid": [1]}', "dense", None), ('{"hybrid": {"a": 1}, "results": [3]}', "hybrid", None),
    ('{"hybrid": null, "results": [3]}', "hybrid", None), ('{"hybrid": null, "question": "q"}', "hybrid", 1), ('{"answer": null}', "", 1), ("[1, 2, 3]", "dense", 3), ("[]", "dense", 0), ('"text"', "dense", None), ("no json", "dense", None), ('{"results": []}', "  ", 0), (None, None, None),
])
def test_shapes_of_replies(spark, reply, method, n):
    got = spark.createDataFrame([(reply,)], "t string").select(W.retrieval_items(F.col("t"), method).alias("x")).select(F.when(F.col("x").isNotNull(), F.size("x"))).first()[0]
    assert got == n


OLD = {"P": "adults", "I": "drug", "C": ["none", "other"], "O": {"none": ["death"], "other": ["pain", "cost"]}}


@pytest.mark.parametrize(("component", "place", "change", "error"), [
    ("P", None, {"P": "children"}, None), ("P", None, {"P": " Adults "}, "P is not changed"), ("P", None, {"P": "x", "I": "y"}, "only P may change"), ("P", None, {"P": "x", "O": {"none": ["death"]}}, "O may not change"), ("I", None, {"I": "x"}, None),
    ("C", 1, {"C": ["none", "new"], "O": {"none": ["death"], "new": ["pain", "cost"]}}, None), ("C", 0, {"C": ["none", "new"], "O": {"none": ["death"], "new": ["pain", "cost"]}}, "exactly one comparator has to change"),
    ("C", 1, {"C": ["none", "new"]}, "outcomes have to be those of the comparators"), ("C", 1, {"C": ["none", "new"], "O": {"none": ["death"], "new": ["pain"]}}, "a comparator's outcomes may not change"),
    ("C", 1, {"C": ["none"]}, "the number of comparators may not change"), ("C", 0, {"P": "x"}, "only C may change"), ("Q", None, {}, "no such element"),
])
def test_exactly_one_element_changes(spark, component, place, change, error):
    from quarrystone.functions.projection import normalize_pico

    df = spark.createDataFrame([(json.dumps(OLD), json.dumps(OLD | change), component, place)], "a string, b string, c string, p int")
    got = df.select(W.single_change_error(normalize_pico(F.col("a")), normalize_pico(F.col("b")), F.col("c"), F.col("p")).alias("e")).first().e
    assert got == error


def test_prompts_beyond_a_tasks_bytes_are_asked_in_turns(spark, tmp_path, monkeypatch):
    """The cap on clients stands, and no task is given all prompts of its share of the cap."""
    folder = str(tmp_path)

    class Told:
        def __init__(self):
            self.path = f"{folder}/{uuid.uuid4().hex}"

        def __call__(self, prompt):
            with open(self.path, "a") as f:
                f.write(prompt + "\n")
            return prompt[::-1]

    monkeypatch.setattr(model, "TASK_BYTES", 2000, raising=False)
    rows = spark.range(400).selectExpr("id", "concat('p', id, repeat('x', 40)) AS p")
    got = model.model_map(rows, "p", Told, concurrency=2).collect()
    assert len(got) == 400 and all(r.response == r.p[::-1] and r.error is None for r in got)
    sizes = [p.stat().st_size for p in tmp_path.iterdir()]
    assert sum(sizes) == sum(len(r.p) + 1 for r in got) and max(sizes) < 4000
