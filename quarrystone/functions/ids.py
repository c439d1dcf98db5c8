"""Content-addressed keys: pure functions of the columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_sha(text: Column, chars: int = 8) -> Column:
    return F.substring(F.sha2(text, 256), 1, chars)


def paper_uid(pmid: Column, doi: Column, title: Column, abstract: Column) -> Column:
    """Of the first that is there: pmid, doi, title with abstract. Null if all are null."""
    text = F.when(title.isNotNull() | abstract.isNotNull(), F.concat(F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))))
    return short_sha(F.coalesce(pmid, doi, text))


def outcome_uid(comparison: Column, outcome: Column, design: Column) -> Column:
    return short_sha(F.concat(comparison, outcome, design))


def pico_idx(question: Column, dataset: Column, given: Column | None = None) -> Column:
    """The given index, or where that is null, empty or ``auto`` one from question and dataset."""
    own = short_sha(F.concat(question, dataset))
    return own if given is None else F.when(given.isNull() | given.isin("", "auto"), own).otherwise(given)


def comparator_postfix(comparator: Column) -> Column:
    return F.concat(F.lit("_c"), F.substring(F.md5(comparator), 1, 6))


def file_fingerprint(content: Column) -> Column:
    """sha256 of a file's bytes, as binaryFile reads them."""
    return F.sha2(content, 256)
