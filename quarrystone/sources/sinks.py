"""Writers. A change to a table is a plan for the new table, written to a new place or to whole partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import retrieval
from quarrystone.functions.text import tokenize
from quarrystone.operators.evidence import latest
from quarrystone.scratch import written


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines."""
    df.write.mode(mode).json(path)


def append_results(df: DataFrame, path: str) -> None:
    """Duplicates are kept, as appends do."""
    df.write.mode("append").json(path)


def array_export(df: DataFrame, path: str) -> None:
    """One JSON array in one file: for small results that people read."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    rows.agg(F.concat(F.lit("[\n"), F.array_join(F.sort_array(F.collect_list("value")), ",\n"), F.lit("\n]\n")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str] = ("pico_idx", "comparator_postfix")) -> None:
    """Replaces the partitions that df holds and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def snapshot(df: DataFrame, path: str, stamp: str) -> None:
    """Adds a stamped version of a table."""
    df.withColumn("stamp", F.lit(stamp)).write.mode("append").parquet(path)


def newest_snapshot(spark: SparkSession, path: str, keys: Sequence[str], valid: Column | None = None) -> DataFrame:
    """Of each key the newest valid version."""
    return latest(spark.read.parquet(path), keys, "stamp", valid)


def create_collection(df: DataFrame, path: str, recreate: bool = False) -> None:
    """Writes a collection, or leaves one that is there alone unless it is to be made again."""
    df.write.mode("overwrite" if recreate else "ignore").parquet(path)


def save_bm25(docs: DataFrame, path: str, idx: str, text: str, mode: str = "errorifexists") -> None:
    """An index of four tables: postings by term with the lengths of their documents, all lengths, term weights, totals.

    Texts are tokenised once, and postings are shuffled as arrays, one for each term and part of a batch of documents. They are range-partitioned and sorted by term, so that a filter on terms reads few row groups.
    """
    blocks = retrieval.posting_blocks(docs, idx, tokenize(F.coalesce(F.col(text), F.lit(""))))
    ranged = blocks.where("term IS NOT NULL").repartitionByRange("term").sortWithinPartitions("term", F.get("idx", F.lit(0)))
    ranged.select("term", F.inline(F.arrays_zip("idx", "dl", "tf"))).select("idx", "dl", "term", "tf").write.mode(mode).parquet(f"{path}/postings")
    lengths = blocks.where("term IS NULL").select(F.inline(F.arrays_zip("idx", "dl")))
    lengths.write.mode(mode).parquet(f"{path}/lengths")
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("all_dl"))
    totals.write.mode(mode).parquet(f"{path}/totals")
    held = blocks.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("idx")).alias("df"))
    retrieval.weights_of(written(held, "held"), totals.select("n")).write.mode(mode).parquet(f"{path}/weights")


def bm25_terms(spark: SparkSession, path: str, terms: Sequence[str]) -> DataFrame:
    """(term, idf, idx, tf, dl) of a few terms from a saved index; the filter reaches the scan."""
    post = spark.read.parquet(f"{path}/postings").where(F.col("term").isin(list(terms)))
    weights = spark.read.parquet(f"{path}/weights").where(F.col("term").isin(list(terms))).select("term", "idf")
    return post.join(weights, "term").select("term", "idf", "idx", "tf", "dl")


def search_bm25(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, q: str = "q", question: str = "question", pushed: int = 1000) -> DataFrame:
    """(q, idx, score, rank) from a saved index, as retrieval.bm25_search gives them from the texts.

    At most ``pushed`` distinct query terms become a filter of the scans; more are joined. The rows are the same.
    """
    asked = written(retrieval.postings(queries, q, question).withColumnsRenamed({"idx": "q", "tf": "qtf"}), "asked")
    post, weights = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "weights"))
    totals, lengths = (spark.read.parquet(f"{path}/{name}") for name in ("totals", "lengths"))
    some = [r.term for r in asked.select("term").distinct().limit(pushed + 1).collect()]
    if len(some) <= pushed:
        post, weights = (t.where(F.col("term").isin(some)) for t in (post, weights))
    weighed = asked.join(weights, "term").crossJoin(totals).select("q", "term", (F.col("qtf") * F.col("idf")).alias("w"), (F.col("all_dl") / F.col("n")).alias("avgdl"))  # totals is one row
    scores = retrieval.best_of_postings(post, asked, weighed, k)
    if scores is None:
        scores = retrieval.weigh(post.join(weighed, "term"))
    lowest = written(lengths.orderBy("idx").limit(k).select("idx"), "lowest")
    fill = queries.select(F.col(q).alias("q")).distinct().crossJoin(lowest)  # k rows a query
    matched = post.join(F.broadcast(lowest), "idx", "left_semi").join(asked.select("q", "term"), "term").select("q", "idx").distinct()
    fill = fill.join(matched, ["q", "idx"], "left_anti").select("q", "idx", F.lit(0.0).alias("score"))
    return retrieval.top_k(scores.unionByName(fill), k)


class KeyValueLog:
    """A list of JSON records that is only added to, read whole or cleared."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def save(self, records: DataFrame) -> None:
        records.write.mode("append").json(self.path)

    def load(self) -> DataFrame:
        return self.spark.read.schema(self.schema).json(self.path)

    def clear(self) -> None:
        self.spark.createDataFrame([], self.schema).write.mode("overwrite").json(self.path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays and maps become JSON text, as CSV has no types for them."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.csv(path, header=True, escape='"')
