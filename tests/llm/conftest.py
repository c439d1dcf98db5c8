"""Tables with everything awkward in them, and brute-force helpers."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, lines int, target double, fp long, kept boolean"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns whose names the operators use inside."""
    long_text = " ".join(f"word{k % 977}" for k in range(30_000))
    texts = [None, "", " \n\t\n ", "one", "The cat sat on the mat.\nThe cat sat on the mat.\nEnd", "Der Hund und die Katze\nEnd", long_text, "### $$$ 123", "a b c\x1cd\u00a0e", "é" * 300]
    rows = [(k, t, ["en", "de", None][k % 3], ["a", "b", None][k % 3], 1, 2, "x", 3, 0.5, 7, True) for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "no id", "en", "a", None, None, None, None, None, None, None), (50, "one", None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}
