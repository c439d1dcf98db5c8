"""A vector store as a table: ids, vectors and payload columns. Every change is a plan that gives the new table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.scratch import bucketed


def add(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Upsert: rows replace those of equal key."""
    return store.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def update_payload(store: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """store with the given payload columns replaced where new has the key."""
    renamed = new.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = store.join(renamed, key, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else c for c in store.columns])


def delete(store: DataFrame, key: str, ids: DataFrame | None = None, payload: dict[str, object] | None = None) -> DataFrame:
    """store without the rows of the ids and without those whose payload equals all given values; both apply if both are given."""
    if ids is not None:
        store = store.join(ids.select(key), key, "left_anti")
    if payload:
        same = F.lit(True)
        for name, value in payload.items():
            same = same & F.col(name).eqNullSafe(F.lit(value))
        store = store.where(~same)
    return store


def clear(store: DataFrame) -> DataFrame:
    return store.where(F.lit(False))


def status(store: DataFrame, vector: str) -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size(vector)).alias("dimension"))


def prepared(rows: DataFrame, vector: str, dimension: int) -> DataFrame:
    """Vectors as floats of length 1; a wrong dimension raises when run."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    fine = F.assert_true(F.size(vector) == dimension, F.lit(f"a vector does not have {dimension} values"))
    unit = F.when(size > 0, F.transform(vector, lambda x: (x / size).cast("float"))).otherwise(F.col(vector).cast("array<float>"))
    return rows.where(fine.isNull()).withColumn(vector, unit)


# --- vectors by paper: a stored table, and searches inside papers -------------------------------------------------

#: A paper with more vectors than this is kept in several parts, each in a bucket of its own.
PART_ROWS = 50_000


def save_by_paper(rows: DataFrame, buckets: int, paper: str = "paper", idx: str = "idx", part_rows: int = PART_ROWS, table: str | None = None) -> DataFrame:
    """The stored table of vectors keyed by (paper, idx): rows with ``part``, bucketed by (paper, part) and sorted, so searches read it in place."""
    sizes = rows.groupBy(paper).agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("_parts"))
    dealt = rows.join(sizes, paper).withColumn("part", F.pmod(F.xxhash64(idx), F.col("_parts")).cast("int")).drop("_parts")
    return bucketed(dealt, "vectors", buckets, [paper, "part"], [paper, "part", idx], table)


def upsert_by_paper(store: DataFrame, rows: DataFrame, buckets: int, paper: str = "paper", idx: str = "idx", part_rows: int = PART_ROWS, table: str | None = None) -> DataFrame:
    """A new stored table in which rows replace those of equal (paper, idx); of equal new ones, any one. Columns are those of the store."""
    new = rows.dropDuplicates([paper, idx]).select(*[c for c in store.columns if c != "part"])
    kept = store.drop("part").join(new.select(paper, idx), [paper, idx], "left_anti")
    return save_by_paper(kept.unionByName(new), buckets, paper, idx, part_rows, table)


def search_by_paper(store: DataFrame, queries: DataFrame, k: int = 5, paper: str = "paper", idx: str = "idx", vector: str = "v", q: str = "q") -> DataFrame:
    """(paper, q, idx, score, rank): the k most similar vectors, by cosine, of the query's own paper; ties to the lower idx.

    queries: (paper, q, v). They go to the buckets of the store, which itself is not shuffled, one copy to each part of their paper;
    the best of a part leave it. A null vector, a zero one and one of another length than the query's has a similarity of 0.
    """
    parts = store.groupBy(paper).agg((F.max("part") + 1).alias("_parts"))
    asked = queries.select(paper, q, F.col(vector).alias("_asked")).join(parts, paper).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    norms = F.sqrt(dot(vector, vector)) * F.sqrt(dot("_asked", "_asked"))
    score = F.when((norms > 0) & (F.size(vector) == F.size("_asked")), dot(vector, "_asked") / norms)
    met = asked.join(store.select(paper, "part", idx, vector), [paper, "part"]).select(paper, q, idx, F.round(F.coalesce(score, F.lit(0.0)), 6).alias("score"))
    order = Window.partitionBy(paper, q).orderBy(F.desc("score"), idx)
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
