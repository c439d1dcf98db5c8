from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F

from quarrystone.llm.queries import ORACLE_SQL, QUERIES
from quarrystone.llm.spelling import Automaton, near_words, one_letter_lost, variants, vocabulary


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


@pytest.mark.parametrize(("hot_words", "part_chars"), [(20_000, 1 << 20), (3, 200), (1, 10**6)])
def test_near_words_are_those_of_all_pairs(spark, hot_words, part_chars):
    rng = random.Random(11)
    words = sorted({"".join(rng.choices("abé😀", k=rng.randrange(1, 9))) for _ in range(400)})
    df = spark.createDataFrame([(w, k + 2) for k, w in enumerate(words)], "word string, n long")
    n = dict(zip(words, range(2, 10**6), strict=False))
    got = sorted(map(tuple, near_words(df, hot_words, part_chars).collect()))
    assert got == sorted((a, n[a], b, n[b]) for a in words for b in words if one_edit(a, b))


def test_an_automaton_is_minimal_and_numbers_its_words():
    words = sorted({a + b + c for a in ("ab", "cb", "zz") for b in "xyz" for c in ("ing", "ion", "est")})
    letters = np.array([[ord(x) for x in w] for w in words])
    found = Automaton(letters)
    assert [len(f) - 1 for f in found.first] == [1, 2, 1, 1, 2, 3]  # all stems and endings share states
    paths = np.stack([np.arange(len(words)), np.zeros(len(words), int), np.zeros(len(words), int)])
    for depth in range(letters.shape[1]):
        paths = found.step(depth, paths, letters[paths[0], depth])
    assert paths[2].tolist() == list(range(len(words)))


def plain(words: dict[str, int], times: int = 10) -> dict[str, tuple]:
    out = {}
    for w, n in words.items():
        near = [(-m, x) for x, m in words.items() if one_edit(w, x)]
        best = min(near, default=None)
        out[w] = (n, len(near), best[1] if best and -best[0] >= times * n else None, -best[0] if best and -best[0] >= times * n else None)
    def root(w):
        return root(out[w][2]) if out[w][2] else w
    return {w: (*v, root(w)) for w, v in out.items()}


def test_forms_follow_to_the_last(spark):
    rng = random.Random(12)
    words = {"".join(rng.choices("abc", k=rng.randrange(3, 7))): 10 ** rng.randrange(7) for _ in range(300)}
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants(spark.createDataFrame(list(words.items()), "word string, n int")).collect()}
    assert got == plain(words)
    assert any(v[2] and v[4] != v[2] for v in got.values())


def test_awkward_documents(spark, awkward, empty):
    import re

    rows = awkward.select("doc_id", "text").union(spark.createDataFrame([(70, "Straßenbahn Straßenbahn straSSenbahn ÀÉÎ×÷ÿÿ " + "x" * 20_000)], "doc_id long, text string"))
    want = Counter()
    for r in rows.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 4 and n >= 1}
    words = vocabulary(rows, least_chars=4, least_count=1, change=one_letter_lost(3))
    assert {r.word: r.n for r in words.collect()} == want
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants(words, hot_words=50).collect()}
    short = {w: n for w, n in want.items() if len(w) < 1000}
    assert {w: v for w, v in got.items() if len(w) < 1000} == plain(short) and len(got) == len(want)
    assert variants(vocabulary(empty)).count() == 0
    assert vocabulary(awkward.where(F.col("text").isNull())).count() == 0


def test_op11_equals_its_sql(spark, sf):
    assert_same(QUERIES["op11_spelling"](spark, sf).toPandas(), connect(sf).execute(ORACLE_SQL["op11_spelling"]).df())
