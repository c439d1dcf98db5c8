from __future__ import annotations

import hashlib
import re
import string
import time
from collections import Counter

from pyspark.sql import functions as F

from quarrystone.llm.line_dedup import dedup_lines
from quarrystone.llm.quality import RULES, Rule, judge

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def keys(text):
    return [x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in (text or "").split("\n")]


def brute_lines(rows, least):
    found = Counter(k for t in rows for k in {*keys(t)} if k)
    out = []
    for t in rows:
        lines = (t or "").split("\n")
        left = [x for x, k in zip(lines, keys(t), strict=True) if found[k] < least]
        out.append((len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def test_lines_against_brute_force(docs, texts):
    ids = list(texts)
    for least in (2, 10):
        want = {i: w for i, w in zip(ids, brute_lines([texts[i] for i in ids], least), strict=True)}
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(docs, min_docs=least).collect()}
        assert got == want


def test_lines_do_not_depend_on_batches(docs):
    def digest(**options):
        return {(r.doc_id, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in dedup_lines(docs, min_docs=3, **options).collect()}

    assert digest(batches=1) == digest(batches=7, fanout=3)


def test_lines_of_awkward_rows(awkward, empty):
    rows = [r.text for r in awkward.collect()]
    got = sorted((r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(awkward, min_docs=2, batches=2).collect())
    assert got == sorted(brute_lines(rows, 2))
    assert dedup_lines(empty).count() == 0


def test_long_documents_of_common_lines(spark):
    text = "\n".join(f"line {k}" for k in range(20_000))
    df = spark.createDataFrame([(k, text + f"\nown {k}\nline 7\n") for k in range(10)], "doc_id long, text string")
    began = time.time()
    got = dedup_lines(df).collect()
    assert {(r.n_lines, r.n_dropped, r.kept_text) for r in got} == {(20_003, 20_001, f"own {k}\n") for k in range(10)}
    assert time.time() - began < 60


def test_a_long_document_of_repeated_words(spark):
    words = [f"w{k % 40_000}" for k in range(150_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:40_002]))], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.n_words, r.n_repeat_words) for r in judge(df).select("doc_id", "n_words", "n_repeat_words").collect()}
    assert got == {1: (150_000, 150_000), 2: (40_002, 0)} and time.time() - began < 60


def test_rows_that_share_an_id_or_have_none(spark):
    rows = [(None, f"common\nrow {k}") for k in range(12)] + [(1, f"common\nother {k}\nCommon ") for k in range(3)] + [(2, "common")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(df).collect())
    assert got == sorted(brute_lines([t for _, t in rows], 10))


def test_lines_carry_other_columns(awkward):
    got = dedup_lines(awkward, carry=awkward.columns).select("carried.*")
    assert got.columns == awkward.columns and got.count() == awkward.count()


def brute_measures(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {p for i, w in enumerate(windows) if w in twice for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len({*lines}), len(covered)


def measures(df):
    return sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in judge(df).collect())


def test_measures_against_brute_force(docs, texts, awkward, empty):
    assert measures(docs) == sorted(map(brute_measures, texts.values()))
    assert measures(awkward) == sorted(brute_measures(r.text) for r in awkward.collect())
    assert judge(empty).count() == 0


def test_rules_are_a_projection_without_python(docs):
    plan = judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_rules_table_decides(spark):
    text = " ".join(f"the w{k}" for k in range(60))
    df = spark.createDataFrame([(1, text), (2, text.upper()), (3, "short")], "doc_id int, text string")
    assert {r.doc_id: r.kept for r in judge(df).collect()} == {1: True, 2: False, 3: False}
    strict = (*RULES, Rule("short_words", "mean_word_chars", None, 1.0))
    assert not judge(df, strict).where("kept").count()


def test_quality_labels(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    good = judge(docs).join(labels, "doc_id").where(~F.col("base_failed"))
    assert good.where("kept").count() >= 0.98 * good.count()
