"""Search strategies against regular expressions on hand-made texts."""

from __future__ import annotations

import random
import re

import pytest

from quarrystone.operators import strategies as S


@pytest.mark.parametrize(("line", "tree"), [
    ("1 or 2 and 3", ("and", ("or", ("line", 1), ("line", 2)), ("line", 3))),
    ("or/1-3,5", ("or", ("or", ("or", ("line", 1), ("line", 2)), ("line", 3)), ("line", 5))),
    ("#8 AND (#1 OR Trial[ti])", ("and", ("line", 8), ("or", ("line", 1), ("phrase", ("trial",), ("ti",))))),
    ("(lewy$ bod$ or lo 59).ti,ab,kw.", ("or", ("phrase", ("lewy$", "bod$"), ("ti", "ab", "kw")), ("phrase", ("lo", "59"), ("ti", "ab", "kw")))),
    ("(brain adj1 (disease$ or syndrome$))", ("adj", 1, ("phrase", ("brain",), None), ("or", ("phrase", ("disease$",), None), ("phrase", ("syndrome$",), None)))),
    ("“Clinical trials as topic”[mh:noexp]", ("phrase", ("clinical", "trials", "as", "topic"), ("mh",))),
    ("*Supranuclear Palsy, Progressive/", ("phrase", ("supranuclear", "palsy", "progressive"), ("sh",))),
    ("Randomi?ed.ab.", ("phrase", ("randomi?ed",), ("ab",))),
    ("102767-28-2", ("phrase", ("102767-28", "2"), None)),
])
def test_lines_are_read(line, tree):
    assert S.read_line(line) == tree


@pytest.mark.parametrize("line", ["(a or b", "a or", "and b", "a) b", "---"])
def test_lines_that_make_no_sense(line):
    with pytest.raises(ValueError):
        S.read_line(line)


def plain(texts, line):
    """The ids by a regular expression on each text's words; line: a tree."""
    def word(w):
        return "".join({"$": "[^ ]*", "*": "[^ ]*", "?": "[a-z0-9]?"}.get(c, re.escape(c)) for c in w)
    def pattern(n):
        return "(?:" + "|".join(map(pattern, n[1:])) + ")" if n[0] == "or" else " ".join(map(word, n[1]))
    def ids(n):
        if n[0] in ("and", "or", "not"):
            a, b = ids(n[1]), ids(n[2])
            return a & b if n[0] == "and" else a | b if n[0] == "or" else a - b
        if n[0] == "adj":
            a, b, gap = pattern(n[2]), pattern(n[3]), f"(?:[^ ]+ ){{0,{n[1] - 1}}}"
            return {i for i, t in texts.items() if re.search(f" {a} {gap}{b} | {b} {gap}{a} ", t)}
        return {i for i, t in texts.items() if re.search(f" {pattern(n)} ", t)}
    return ids(line)


def test_random_texts_and_lines(spark):
    rng = random.Random(17)
    words = ["brain", "brains", "disease", "diseases", "drug-free", "a1", "the", "randomized", "randomised"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(9)))) for k in range(150)] + [(900, None), (901, ""), (902, "the " * 5000 + "brain a1")]
    df = spark.createDataFrame(rows, "k long, t string")
    texts = {k: f" {t} " if t else "" for k, t in rows}
    lines = ["brain", "brain$", "randomi?ed", "brain adj1 disease*", "(brain or the) adj3 (drug-free or disease$)", '"the brain"', "the brain* not a1", "brain adj2 brain", "the the", "diseas? and (a1 or the) not drug-free", "zzz", "zzz or br*"]
    index = S.positional_index(df, "k", {"t": "t"}, 3)
    got = S.evaluate(index, [("s", n, x) for n, x in enumerate(lines)], ["t"])
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    found = {}
    loose = S.evaluate(S.positional_index(df.repartition(3), "k", {"t": "t"}), [("s", n, x) for n, x in enumerate(lines)], ["t"])
    assert sorted(map(tuple, loose.collect())) == sorted(map(tuple, got.collect()))
    for r in got.collect():
        found.setdefault(r.number, set()).add(r.idx)
    for n, line in enumerate(lines):
        assert found.get(n, set()) == plain(texts, S.read_line(line)), line


def test_fields_passes_and_unknown_references(spark, monkeypatch):
    df = spark.createDataFrame([(1, "alpha beta", "alpha"), (2, "beta", "gamma"), (3, None, "beta alpha")], "k long, t string, a string")
    index = S.positional_index(df, "k", {"title": "t", "body": "a"}, 2, "kept_positions")
    lines = [(s, n, x) for s in ("u", "v", "w") for n, x in ((1, "alpha.ti."), (2, "(beta or gamma)[tiab]"), (3, "2 not 1"), (4, '"alpha beta"'))]
    tags = {"ti": ["title"], "tiab": ["title", "body"]}
    want = {(s, *x) for s in "uvw" for x in ((1, 1), (2, 1), (2, 2), (2, 3), (3, 2), (3, 3), (4, 1))}
    assert {tuple(r) for r in S.evaluate(index, lines, ["title", "body"], tags).collect()} == want
    monkeypatch.setattr(S, "PASS", 5)
    monkeypatch.setattr(S, "MOST_RANGES", 1)
    assert {tuple(r) for r in S.evaluate(spark.table("kept_positions"), spark.createDataFrame(lines, "s string, n int, l string"), ["title", "body"], tags).collect()} == want
    for bad in ("9 or 1", "alpha.xx.", "(alpha and beta) adj gamma"):
        with pytest.raises(ValueError):
            S.evaluate(index, [("s", 1, "alpha"), ("s", 2, bad)], ["title", "body"], tags)
    spark.sql("DROP TABLE kept_positions")
