"""Post-orders and stage cascades against plain loops."""

from __future__ import annotations

import random

import pytest

from quarrystone.operators import evidence
from quarrystone.operators.evidence import cascade, post_order
from quarrystone.scratch import written

NODES = "node long, parent long, place long"


def plain_order(rows):
    kids: dict = {}
    for node, parent, place in rows:
        kids.setdefault(parent, []).append((place, node))
    out, todo = [], [(n, False) for _, n in sorted(kids.get(None, []), reverse=True)]
    while todo:
        node, back = todo.pop()
        if back:
            out.append(node)
        else:
            todo.append((node, True))
            todo += [(n, False) for _, n in sorted(kids.get(node, []), reverse=True)]
    return {n: k for k, n in enumerate(out, 1)}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "roots"])
def test_post_order(spark, kind):
    rng = random.Random(6)
    if kind == "random":
        rows = [(k, rng.choice([None, *range(max(0, k - 9), k)]), rng.randrange(5)) for k in range(150)]
    elif kind == "chain":
        rows = [(k, k - 1 if k else None, 0) for k in range(200)]
    else:
        rows = [(k, None if kind == "roots" or not k else 0, -k) for k in range(60)]
    assert {r.node: r.position for r in post_order(spark.createDataFrame(rows, NODES)).collect()} == plain_order(rows)


@pytest.mark.parametrize("rows", [[(1, 2, 0), (2, 1, 0)], [(1, None, 0), (2, 9, 0)], [(1, None, 0), (2, 1, 0), (2, None, 1)]])
def test_what_is_no_forest(spark, rows):
    with pytest.raises(ValueError):
        post_order(spark.createDataFrame(rows, NODES))


def test_an_empty_forest(spark):
    assert post_order(spark.createDataFrame([], NODES)).count() == 0


def test_cascades(spark):
    rng = random.Random(7)
    stages = [["p"], ["q", "r"], ["s"], ["t"]]
    at = {k: n for n, keys in enumerate(stages) for k in keys}
    rows = [(rng.randrange(4), n, rng.choice("pqrstx"), rng.choice(["1", "2", None])) for n in range(600)]
    want, now = [], {}
    for e, n, k, v in rows:
        state = now.setdefault(e, dict.fromkeys(at))
        real = k in at and state[k] != v
        if real:
            state[k] = v
            state.update({x: None for x in at if at[x] > at[k]})
        done = next((m for m, keys in enumerate(stages) if any(state[x] is None for x in keys)), len(stages))
        want.append((e, n, k, v, real, *state.values(), done))
    got = cascade(spark.createDataFrame(rows, "entity long, seq long, key string, value string"), stages).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_done_steps_of_the_tour_are_not_joined(spark, monkeypatch):
    """With a null pointer they would all be dealt to one task."""
    plans = []

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return written(df, name)

    monkeypatch.setattr(evidence, "written", seen)
    rows = [(k, None if k % 9 == 0 else k - 1, k) for k in range(60)]
    assert {r.node: r.position for r in post_order(spark.createDataFrame(rows, NODES)).collect()} == plain_order(rows)
    joins = [p for name, p in plans if name == "tour"][1:]
    assert joins and all("Join Inner" in p and "LeftOuter" not in p for p in joins)
