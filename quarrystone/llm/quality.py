"""Quality rules: a threshold table compiled into Spark projections, evaluated without user functions.

A rule is a row (name, measure, least, most). Measures are Spark expressions over
the text; ``compile_rules`` turns a table of rules into one boolean column each,
and a document is kept if it passes the base rules and every row of the table.
All of it is a chain of projections over the scan: no shuffle and no Python.

Repeated windows: the hashes of all windows of a document form a long array. If
it is free of duplicates, as array_distinct tells in one pass, nothing repeats.
Otherwise (hash, place) are sorted, neighbours of equal hash are repeats, and the
words at and after their places are counted once each by a hash set: n log n in a
document's words. Hashes are 64 bits and compared within one document only.

Defined cases: null and empty texts have no words and fail the base rules; a
ratio over nothing is 0; every row gives a row; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, as_column

SYMBOLS = "[#*$%&|<>]"


class Rule(NamedTuple):
    """Keeps documents with least <= measure <= most; None is no bound."""

    name: str
    measure: str
    least: float | None
    most: float | None


# Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to in is it that was for on are with as be by this from or an "
    "le la les de des du et en un une que qui dans pour par sur est pas "
    "der die das und den von zu mit ist im dem nicht ein eine sich auf "
    "el los las y por con para su se al del como"
).split()

#: Production thresholds. Measures are ratios unless named otherwise.
RULES = (
    Rule("mean_word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbol_ratio", None, 0.05),
    Rule("stop_words", "stop_word_ratio", 0.06, None),
    Rule("capitals", "capital_ratio", None, 0.50),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.50),
    Rule("repeated_words", "repeat_word_ratio", None, 0.50),
    Rule("bullets", "bullet_line_ratio", None, 0.90),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.50),
)


def _any_word(words: Sequence[str]) -> str:
    """A pattern for words that, without trailing punctuation and whatever the case of A-Z, are one of these; grouped by first letter, which decides most of them."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    groups = "|".join(f"{first}(?:{'|'.join(sorted({*rest}, key=len, reverse=True))})" for first, rest in sorted(by.items()))
    space = r"\x20\x09-\x0D"
    return rf"(?i)(?<![^{space}])(?:{groups})(?=[^A-Za-z0-9_{space}]*(?:[{space}]|\z))"


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id and all measures) for each row; ratios are doubles."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    stripped = F.btrim(F.col("text"), F.lit(SPACES))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    base = base.withColumn("words", F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, r"[\x20\x09-\x0D]+")))
    base = base.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    windows = F.transform("words", lambda w, i: F.xxhash64(w, F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2)))
    base = base.withColumn("windows", F.slice(windows, F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))))
    base = base.withColumn("unrepeated", F.size(F.array_distinct("windows")) == F.size("windows"))
    placed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    base = base.withColumn("sorted", as_column(F.when(~F.col("unrepeated"), F.sort_array(placed))))
    base = base.withColumn("twice", F.expr("filter(sorted, (x, k) -> x.h = get(sorted, k - 1).h or x.h = get(sorted, k + 1).h)"))
    covered = F.flatten(F.transform("twice", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    repeat = F.when(F.col("unrepeated"), F.lit(0)).otherwise(F.size(F.array_distinct(covered))).cast("long")
    n_words, n_lines = F.size("words").cast("long"), F.size("lines").cast("long")
    letters = F.length(F.regexp_replace("text", "[^A-Za-z]+", ""))

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    counted = base.select(
        "id",
        n_words.alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        as_column(repeat).alias("n_repeat_words"),
        n_lines.alias("n_lines"),
        F.regexp_count("text", F.lit(_any_word(STOP_WORDS))).cast("int").alias("n_stop_words"),
        F.regexp_count("text", F.lit("[A-Z]")).alias("n_capitals"),
        letters.alias("n_letters"),
        F.size(F.filter("lines", lambda x: F.ltrim(x).rlike(r"^[-*•]"))).alias("n_bullets"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$"))).alias("n_ellipses"),
    )
    return counted.withColumns(
        {
            "mean_word_chars": ratio(F.col("word_chars"), F.col("n_words")),
            "symbol_ratio": ratio(F.col("n_symbols"), F.col("word_chars")),
            "stop_word_ratio": ratio(F.col("n_stop_words"), F.col("n_words")),
            "capital_ratio": ratio(F.col("n_capitals"), F.col("n_letters")),
            "dup_line_ratio": ratio(F.col("n_dup_lines"), F.col("n_lines")),
            "repeat_word_ratio": ratio(F.col("n_repeat_words"), F.col("n_words")),
            "bullet_line_ratio": ratio(F.col("n_bullets"), F.col("n_lines")),
            "ellipsis_line_ratio": ratio(F.col("n_ellipses"), F.col("n_lines")),
        }
    )


def compile_rules(rules: Sequence[Rule]) -> dict[str, Column]:
    """pass_<name> columns, one a rule."""
    out = {}
    for r in rules:
        ok = F.lit(True)
        if r.least is not None:
            ok = ok & (F.col(r.measure) >= r.least)
        if r.most is not None:
            ok = ok & (F.col(r.measure) <= r.most)
        out[f"pass_{r.name}"] = ok
    return out


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, least_words: int = 50, most_repeated_percent: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All measures, base_failed, pass_<rule> for each rule and kept."""
    measured = measure(docs, id_col, text_col)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated_percent * F.col("n_words"))
    passed = compile_rules(rules)
    every = F.lit(True)
    for name in passed:
        every = every & F.col(name)
    return measured.withColumn("base_failed", failed).withColumns(passed).withColumn("kept", ~F.col("base_failed") & every).withColumnRenamed("id", id_col)
