"""Seeded sampling: the order of a hash of (key, seed), so reruns and any partitioning agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def draw(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


def split(rows: DataFrame, key: str, n: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A sample of n keys and the rest."""
    keys = rows.select(key).orderBy(draw(key, seed), key).limit(n)
    return rows.join(keys, key, "left_semi"), rows.join(keys, key, "left_anti")


def with_all_positives(rows: DataFrame, key: str, positive: Column, n: int, seed: int = 42) -> DataFrame:
    """All positive rows and as many others as make n; none are added if positives are more. The others are a top-k by hash, never a sort of a class in one task."""
    known = F.coalesce(positive, F.lit(False))
    chosen = rows.where(known)
    others = rows.where(~known).orderBy(draw(key, seed), key).limit(max(n - chosen.count(), 0))
    return chosen.unionByName(others)


def stratified(rows: DataFrame, key: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each stratum."""
    w = Window.partitionBy(stratum).orderBy(draw(key, seed), key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def choice(key: str, options: list[str], seed: int = 42) -> Column:
    """One of the options for each key."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(draw(key, seed), F.lit(len(options))) + 1).cast("int"))
