"""The section parser on a hand-made guideline, and questions in dirty cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions.text import split_questions
from quarrystone.operators.segments import guideline_records, guideline_sections

BLOCKS = [
    (0, "Statement (too early)"), (0, "1. Nobody asked."), (0, "Questions:"), (1, "1. Which scan\nfirst? 2. No question."), (1, "References are part of a list"), (1, "3. Is it &lt; 5 ?"), (2, "STATEMENTS (Imaging)"), (2, "1. Use a CT ."), (2, "2. Use a first-\nline MRI."),
    (2, "Discussion of this"), (3, "lost"), (3, "Statement (Imaging)"), (3, "1. Use a CT. 2. Use more."), (4, "Statement (Follow-up)"), (4, None), (5, "Discussion"), (6, "questions"), (7, "1. Can it wait?"), (8, "Statement (waiting)"), (8, "It can."), (9, "Ready to submit your research"), (9, "Statement (imaging)"), (9, "1. After the end."),
]


def blocks(spark):
    rows = [(d, p, n, t) for d in ("a", "b") for n, (p, t) in enumerate(BLOCKS)] + [("c", 15, 1, "References"), ("c", 16, 2, "Questions"), ("d", 3, 1, "References"), ("d", 15, 2, "Statements (x)"), ("d", 15, 3, "References")]
    return spark.createDataFrame(rows, "doc string, page int, n int, t string").repartition(5)


def test_sections(spark):
    got = guideline_sections(blocks(spark), "doc", "page", "n", "t").orderBy("doc", "part").collect()
    assert [tuple(r)[1:5] for r in got if r.doc == "a"] == [(1, -1, "statement", "Statement (too early)"), (2, 0, "questions", None), (3, 0, "statement", "STATEMENTS (Imaging)"), (4, 0, "statement", "Statement (Imaging)"), (5, 0, "statement", "Statement (Follow-up)"), (6, 1, "questions", None), (7, 1, "statement", "Statement (waiting)")]
    bodies = {(r.doc, r.part): r.body for r in got}
    assert bodies["a", 2] == "1. Which scan\nfirst? 2. No question. References are part of a list 3. Is it &lt; 5 ?" and bodies["b", 3] == "1. Use a CT . 2. Use a first-\nline MRI." and bodies["a", 5] == ""
    assert [tuple(r) for r in got if r.doc in "cd"] == [("d", 1, -1, "statement", "Statements (x)", "")]


def test_records(spark):
    asked = spark.createDataFrame([(0, "imaging", 1), (0, "imaging", 2), (0, "follow-up", 2), (1, "waiting", 1), (-1, "too early", 1)], "section long, key string, ordinal int")
    got = guideline_records(guideline_sections(blocks(spark), "doc", "page", "n", "t"), "doc", asked).where("doc = 'a'").orderBy("section", "ordinal").collect()
    answers = ["1. Use a CT.", "2. Use a first-line MRI.", "2. Use more."]
    assert [tuple(r)[1:] for r in got] == [(0, 1, "Which scan first?", answers), (0, 2, "Is it < 5 ?", answers), (1, 1, "Can it wait?", ["It can."])]


def test_questions_in_dirty_cells(spark):
    rows = [("Topic Which first-\n line drug ( a )  &amp; b ? Is\r\nit xCan y ? When",), (None,), ("Whichever?",)]
    got = spark.createDataFrame(rows, "t string").select(split_questions(F.col("t")).alias("q")).collect()
    assert [r.q for r in got] == [["Which first-line drug (a) & b ?", "Can y ?"], [], ["Whichever?"]]
