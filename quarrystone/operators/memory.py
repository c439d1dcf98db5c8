"""Conversation memory: decay scores, recent windows, token budgets and merged contexts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def decay_scores(turns: DataFrame, by: Sequence[str], order: str, is_system: Column, keep_rate: float = 0.9) -> DataFrame:
    """Adds score: keep_rate to the power of the number of later or own non-system turns; system turns score 1."""
    later = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    steps = F.sum(F.when(is_system, 0).otherwise(1)).over(later)
    return turns.withColumn("score", F.when(is_system, 1.0).otherwise(F.pow(F.lit(keep_rate), steps)))


def last_n(turns: DataFrame, by: Sequence[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def token_budget(units: DataFrame, by: Sequence[str], uid: str, order: str, score: str, tokens: str, limit: int) -> DataFrame:
    """The first of each uid, lowest scores dropped until the rest fits; over_budget marks groups that would have to lose a row of score 1."""
    first = Window.partitionBy(*by, uid).orderBy(order)
    once = units.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
    group = Window.partitionBy(*by)
    upto = Window.partitionBy(*by).orderBy(score, order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(tokens).over(group)
    # A row goes if what is left before it goes is still too much.
    marked = once.withColumn("_drop", total - (F.sum(tokens).over(upto) - F.col(tokens)) > limit)
    marked = marked.withColumn("over_budget", F.max(F.col("_drop") & (F.col(score) == 1)).over(group))
    return marked.where(~F.col("_drop")).drop("_drop")


def merge_context(history: DataFrame, hits: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The first turn of the history, the hits, then the other turns, with a position."""
    w = Window.partitionBy(*by).orderBy(order)
    h = history.withColumn("_n", F.row_number().over(w)).withColumn("_part", F.when(F.col("_n") == 1, 0).otherwise(2)).drop("_n")
    both = h.unionByName(hits.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    place = Window.partitionBy(*by).orderBy("_part", order)
    return both.withColumn("position", F.row_number().over(place)).drop("_part")
