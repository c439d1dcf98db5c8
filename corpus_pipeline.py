"""The corpus pipeline: language ID, line dedup, near dedup, mixing and packing, each stage on all that the one before it kept.

Defined cases: null, empty and blank texts hold no letter and go in the first stage, unless there is no label to learn
from; then they are near copies of each other. Rows without an id, or that share one, are documents of their own, told
apart by their text; of rows equal in id and text one stays. Extra columns come through unchanged, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import language_id, line_dedup, mixing, near_copies, packing
from quarrystone.llm.common import Scratch, beside

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents whose language is less certain than this go.
LEAST_LANGUAGE_SCORE = 0.5


#: The columns that stages read.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def plain(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs with every column that no stage reads renamed, and the columns that name all as before: no stage's own columns clash with a document's."""
    names = [c if c in READ else f"extra_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(a).alias(b) for a, b in zip(names, docs.columns, strict=True)]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose prediction scores below LEAST_LANGUAGE_SCORE. Without any label there is nothing to judge by and all stay."""
    rows, as_before = plain(docs)
    model = language_id.train(rows.where(~language_id.held_out(F.col("doc_id"))))
    if not model.labels:
        return docs
    judged = language_id.predict(rows, model)
    return judged.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)).select(*as_before)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more go; text and n_chars change, documents stay."""
    out = line_dedup.dedup_lines(docs, carry=docs.columns)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[new.get(c, F.col("carried").getField(c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity of 0.8 or more) one row stays.

    Candidates come from the grid of SimHash fingerprints, and from minima of shingles where that does not reach.
    The row that stays is the one with the least id, null last, and of several texts under that id the one with the least hash.
    Components are of texts, not ids: rows that share an id, or have none, stay if they are no near copies. Of rows
    with the same id and text any one stays.
    """
    rows, as_before = plain(docs)
    scratch = Scratch(spark, "near-dedup")
    own = near_copies.near_copies(rows.select("doc_id", "text"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    least = own.groupBy("root").agg(F.min(key).alias("least"))
    judged = scratch.keep(own.join(least.hint("merge"), "root").select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"), "copies", (key == F.col("least")).alias("kept")), "judged")
    rows = rows.withColumn("_own", near_copies.text_hash(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_node"))
    left = rows.join(beside(judged.where("NOT kept").select("_id", "_node")), same, "left_anti")
    repeated = judged.where("kept AND copies > 1").select("_id", "_node")
    if not repeated.isEmpty():
        repeated = beside(repeated)
        left = left.join(repeated, same, "left_anti").union(left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_own"]))
    return left.select(*as_before)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes: none, one or two rows."""
    rows, as_before = plain(docs)
    taken = mixing.mix(rows).where("copies > 0").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("source").alias("_source"))
    taken = Scratch(spark, "mix").keep(taken.agg(F.sum("copies").cast("int").alias("_copies"), F.max("repeat").alias("_repeat")), "taken")
    rows = rows.withColumn("_own", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")) & F.col("source").eqNullSafe(F.col("_source"))
    met = rows.join(taken.where("_repeat = 0").hint("merge"), same)
    repeated = taken.where("_repeat > 0")  # equal rows: one of them stands for all, with the copies that all take
    if not repeated.isEmpty():
        met = met.union(rows.join(repeated.hint("merge"), same).dropDuplicates(["doc_id", "_own", "source"]))
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*as_before)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has neither the classifier, XXH64 nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two of them the rows are written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name, "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
