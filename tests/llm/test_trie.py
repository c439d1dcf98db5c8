from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from compare import assert_same, connect

from quarrystone.llm.queries import ORACLE_SQL, QUERIES
from quarrystone.llm.trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, path long"


def brute(rows, every=1, most=1):
    """The trie in dictionaries, nodes by their turns."""
    whole = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            whole[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in whole.items()}
    built, members = {}, defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % most
        built[c] = tuple(turns.get(c - c % every, [])[:h] + turns[c][h:])
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    kids = defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    def totals(n):
        leaves, saved = not kids[n], (len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0
        for kid in kids[n]:
            a, b = totals(kid)
            leaves, saved = leaves + a, saved + b
        return int(leaves), saved
    out = []
    for n, m in members.items():
        ids = ",".join(map(str, sorted(c for c in m if built[c] == n)))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), *totals(n), hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, **options):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in names) for r in prefix_trie(df, **options).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"every": 5, "most": 9}, {"every": 3, "most": 4, "run": 2}])
def test_tries_of_random_conversations(spark, options):
    rng = random.Random(13)
    rows = [(c, t, rng.choice("ua"), rng.choice(["", "é", "xyz"])) for c in range(80) if c % 11 for t in range(rng.randrange(7))]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    assert got(df, **options) == brute(rows, options.get("every", 1), options.get("most", 1))


def test_a_caterpillar_a_chain_and_a_hot_conversation(spark):
    rows = [(c, t, "u", "stop" if t == c else "on") for c in range(30) for t in range(c + 1)]
    rows += [(c, t, "u", "hot") for c in range(100, 160) for t in range(3)]
    rows += [(999, t, "a", f"turn {t}") for t in range(300)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    assert got(df, run=16) == brute(rows)


def test_awkward_conversations(spark):
    rows = [(1, None, "u", "a"), (1, 0, None, None), (1, 0, "", ""), (1, 0, "", "z"), (2, 0, "u", "a"), (2, 0, "u", "a"), (None, 0, "u", "lost"), (-7, 1, "u", "x" * 100_000), (-7, None, "u", "a"), (-5, 3, "u", "q"), (11, 0, "u", "a")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    assert got(df) == brute(rows)
    assert got(df.where("conv_id > 99")) == [] and got(df.where("conv_id IS NULL")) == []
    turnless = [(c, 0, "u", "a") for c in range(6, 40) if c % 5]  # no base, and often less turns than are taken away
    found = got(spark.createDataFrame([(*r, 1, 2) for r in turnless], SCHEMA), every=5, most=9)
    assert [x[:5] for x in found if x[1] == 0] == [(6, 0, None, 28, 1)] and sum(x[3] for x in found if x[1] == 1) < 28


def test_op13_equals_its_sql(spark, sf):
    assert_same(QUERIES["op13_trie"](spark, sf).toPandas(), connect(sf).execute(ORACLE_SQL["op13_trie"]).df())
