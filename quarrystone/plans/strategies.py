"""Search strategies over documents: boolean lines, phrases, truncated and neighbouring words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import strategies as S
from quarrystone.sources.files import renumbered

from .base import Queries, declare, table

queries: Queries = {}
query = declare(queries)

_FIELDS = {"body": "text", "language": "lang", "origin": "source"}
_TAGS = {"ab": ["body"], "tiab": ["body"], "ti": ["body"], "la": ["language"], "so": ["origin"]}
_TOKENS = "' ' || array_to_string(regexp_extract_all(lower({}), '[a-z0-9]+(?:[-''][a-z0-9]+)?'), ' ') || ' '"
_TOK = f"tok AS (SELECT doc_id AS idx, coalesce({_TOKENS.format('text')}, '') AS body, coalesce({_TOKENS.format('lang')}, '') AS language, coalesce({_TOKENS.format('source')}, '') AS origin FROM documents)"


def _index(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return S.positional_index(docs, "doc_id", _FIELDS)


def _sql(lines: dict[tuple[str, int], str]) -> str:
    """Sets of ids as CTEs: a text in brackets is a condition on the tokens of one document."""
    parts = [_TOK]
    for (strategy, number), what in lines.items():
        parts.append(f"{strategy}_{number} AS ({what if what.startswith('FROM') or ' FROM ' in what else f'SELECT idx FROM tok WHERE {what}'})")
    rows = " UNION ALL ".join(f"SELECT '{s}' AS strategy, {n} AS number, idx FROM {s}_{n}" for s, n in lines)
    return f"WITH {', '.join(parts)} {rows}"


def _anywhere(pattern: str) -> str:
    return " OR ".join(f"regexp_matches({f}, ' {pattern} ')" for f in _FIELDS)


BOOLEAN = [
    ("a", 1, "(the or und) .ab."), ("a", 2, "that"), ("a", 3, "with"), ("a", 4, "#2 OR #3"), ("a", 5, "en.la."), ("a", 6, "de[la] or fr[la]"), ("a", 7, "#1 AND #5"), ("a", 8, "or/2-3"), ("a", 9, "and/1,4-5"),
    ("a", 10, "7 not 4"), ("a", 11, "#6 AND (#1 OR from) NOT #8"),
    ("b", 1, "src7.so."), ("b", 2, "src1"), ("b", 3, "1 or 2"), ("b", 4, "from or by and with"), ("b", 5, "3 and 4"),
]


@query("t17_boolean_strategies", _sql({
    ("a", 1): "regexp_matches(body, ' (the|und) ')", ("a", 2): _anywhere("that"), ("a", 3): _anywhere("with"), ("a", 4): "SELECT idx FROM a_2 UNION SELECT idx FROM a_3",
    ("a", 5): "contains(language, ' en ')", ("a", 6): "regexp_matches(language, ' (de|fr) ')", ("a", 7): "SELECT idx FROM a_1 INTERSECT SELECT idx FROM a_5", ("a", 8): "SELECT idx FROM a_2 UNION SELECT idx FROM a_3",
    ("a", 9): "SELECT idx FROM a_1 INTERSECT SELECT idx FROM a_4 INTERSECT SELECT idx FROM a_5", ("a", 10): "SELECT idx FROM a_7 EXCEPT SELECT idx FROM a_4",
    ("a", 11): f"(SELECT idx FROM a_6 INTERSECT (SELECT idx FROM a_1 UNION SELECT idx FROM tok WHERE {_anywhere('from')})) EXCEPT SELECT idx FROM a_8",
    ("b", 1): "contains(origin, ' src7 ')", ("b", 2): _anywhere("src1"), ("b", 3): "SELECT idx FROM b_1 UNION SELECT idx FROM b_2",
    ("b", 4): f"(SELECT idx FROM tok WHERE {_anywhere('(from|by)')}) INTERSECT SELECT idx FROM tok WHERE {_anywhere('with')}", ("b", 5): "SELECT idx FROM b_3 INTERSECT SELECT idx FROM b_4",
}))
def boolean(spark: SparkSession, sf: str) -> DataFrame:
    """Two strategies whose lines refer to earlier ones; the documents of every line."""
    return S.evaluate(_index(spark, sf), BOOLEAN, list(_FIELDS), _TAGS)


def _adj(a: str, b: str, n: int) -> str:
    between = f"([^ ]+ ){{0,{n - 1}}}"
    return f"regexp_matches(body, ' {a} {between}{b} ') OR regexp_matches(body, ' {b} {between}{a} ')"


CLOSE = [
    ("p", 1, '"of the"[tiab]'), ("p", 2, "that it.ab."), ("p", 3, "tion$.ab."), ("p", 4, "thing* or erbl?e*"), ("p", 5, '(the adj3 "and").ab.'), ("p", 6, "((of the or in) adj2 (ther* or it)).ab."),
    ("p", 7, '“is the” OR "was the"'), ("p", 8, "th?n[ti]"), ("p", 9, "or/1-2"), ("p", 10, "9 and 5 not 7"), ("p", 11, "exp On the/"), ("p", 12, '(on adj "and").ab.'),
]


@query("t17_phrases_and_truncation", _sql({
    ("p", 1): "contains(body, ' of the ')", ("p", 2): "contains(body, ' that it ')", ("p", 3): "regexp_matches(body, ' tion[^ ]* ')", ("p", 4): _anywhere("(thing|erble|erbl)[^ ]*"), ("p", 5): _adj("the", "and", 3),
    ("p", 6): _adj("(of the|in)", "(ther[^ ]*|it)", 2), ("p", 7): _anywhere("(is|was) the"), ("p", 8): "regexp_matches(body, ' th[a-z0-9]?n ')", ("p", 9): "SELECT idx FROM p_1 UNION SELECT idx FROM p_2",
    ("p", 10): "(SELECT idx FROM p_9 INTERSECT SELECT idx FROM p_5) EXCEPT SELECT idx FROM p_7", ("p", 11): "contains(body, ' on the ')", ("p", 12): _adj("on", "and", 1),
}))
def close(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases, stems, optional letters and words at most so far apart, either way."""
    return S.evaluate(_index(spark, sf), CLOSE, list(_FIELDS), {**_TAGS, "sh": ["body"]})


@query("t16_renumbered_strategy", _sql({
    ("r", 11): _anywhere("that"), ("r", 12): _anywhere("with"), ("r", 13): "SELECT idx FROM r_11 UNION SELECT idx FROM r_12", ("r", 14): _anywhere("from"),
    ("r", 15): "SELECT idx FROM r_13 EXCEPT SELECT idx FROM r_14", ("r", 16): "contains(language, ' en ')", ("r", 17): "SELECT idx FROM r_15 INTERSECT SELECT idx FROM r_16",
}))
def moved(spark: SparkSession, sf: str) -> DataFrame:
    """A strategy whose numbers are moved by 10 and to which a language filter is added, evaluated."""
    rows = [("r", 1, "that"), ("r", 2, "with"), ("r", 3, "1 or 2"), ("r", 4, "from"), ("r", 5, "3 not 4")]
    lines = renumbered(spark.createDataFrame(rows, "file string, number int, line string"), 10, "en.la.")
    return S.evaluate(_index(spark, sf), lines.select(F.col("file").alias("strategy"), "number", "line"), list(_FIELDS), _TAGS)
