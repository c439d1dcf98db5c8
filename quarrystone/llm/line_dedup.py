"""Line dedup over levelled sorted runs of line hashes.

A run is a Parquet table (h1, h2, n_docs) of line-key hashes, sorted within
its files. Each batch of documents merge-anti-joins the runs of settled keys
(those already found in enough documents, which need no more counting) and
adds the counts of its other keys as a run of level 0. Whenever a level holds
``fanout`` runs they are merged into one run of the next level, and keys whose
merged count reaches the threshold move to the settled runs. At the end all
runs are merged once; the settled keys are then merge-joined with the lines.

Keys are 128 bits of XXH64 (two chains), so that a wrong drop stays improbable
even at 10^12 distinct lines. Text crosses the network once, keyed by doc_id;
everything else moved is hashes. A line that occurs in a third of all
documents is counted by partial aggregation and met by joins that adaptive
execution can split.

Every line goes with its place, and a document's lines are sorted by key once, so
that equal ones are neighbours and the first counts the document. What is dropped
comes back as a set of places, taken from all places by hash: the work on a
document grows with its lines, however many of them are dropped.

Defined cases: null text is one empty line; a document is a row, so repeated
rows count once each; keys shorter than ``min_chars`` are never dropped; rows
without an id, or that share one, are told apart by their text, so they gather
nowhere; an empty table gives an empty result; other columns are returned only
as asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, as_column, lower_ascii


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


class LineRuns:
    """The levelled store. add() takes one batch of (h1, h2) rows, one row per document and key."""

    def __init__(self, scratch: Scratch, min_docs: int, fanout: int = 2) -> None:
        self.scratch, self.min_docs, self.fanout = scratch, min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []
        self.written = 0

    def _write(self, df: DataFrame) -> DataFrame:
        self.written += 1
        return self.scratch.keep(df.sortWithinPartitions("h1", "h2"), f"run-{self.written}")

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))

    def _unsettled(self, df: DataFrame) -> DataFrame:
        for run in self.settled:
            df = df.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return df

    def add(self, batch: DataFrame) -> None:
        counts = batch.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))
        self.levels[0].append(self._write(self._unsettled(counts)))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        merged = self._write(self._unsettled(self._merged(self.levels[level])))
        self.levels[level] = []
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.settled.append(merged.where(F.col("n_docs") >= self.min_docs))
        self.levels[level + 1].append(merged.where(F.col("n_docs") < self.min_docs))

    def frequent(self) -> DataFrame:
        """All keys found in at least min_docs documents."""
        runs = [run for level in self.levels for run in level]
        if runs:
            self.settled.append(self._write(self._unsettled(self._merged(runs)).where(F.col("n_docs") >= self.min_docs)))
            self.levels = [[]]
        return reduce(DataFrame.unionByName, [run.select("h1", "h2") for run in self.settled])


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(id, n_lines, n_dropped, kept_text) for each row of docs, with the columns of carry as the struct ``carried``.

    Lines are split at \\n; those whose key is in min_docs documents or more go.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("own"), *([F.struct(*carry).alias("carried")] if carry else []))
    also = ["carried"] if carry else []
    lines = F.split("text", "\n")
    keyed = F.filter(F.transform(lines, lambda x, i: F.struct(line_key(x).alias("key"), i.alias("place"))), lambda x: F.length(x["key"]) >= min_chars)
    hashed = F.transform(keyed, lambda x: F.struct(F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(1), x["key"]).alias("h2"), x["place"].alias("place")))
    by_key = base.select("id", "own", F.pmod(F.xxhash64("id", "own"), F.lit(batches)).cast("int").alias("batch"), as_column(F.sort_array(hashed)).alias("s"))
    marked = F.expr("transform(s, (x, i) -> named_struct('h1', x.h1, 'h2', x.h2, 'place', x.place, 'first', i = 0 or get(s, i - 1).h1 <> x.h1 or get(s, i - 1).h2 <> x.h2))")
    found = by_key.select("id", "own", "batch", F.inline(marked))
    scratch_path = f"{scratch.path}/lines"
    found.write.partitionBy("batch").option("compression", "uncompressed").parquet(scratch_path)
    found = docs.sparkSession.read.schema(found.schema).parquet(scratch_path)
    runs = LineRuns(scratch, min_docs, fanout)
    for batch in range(batches):
        runs.add(found.where((F.col("batch") == batch) & F.col("first")).select("h1", "h2"))
    dropped = (
        found.join(runs.frequent().hint("merge"), ["h1", "h2"])
        .groupBy("id", "own")
        .agg(F.collect_set("place").alias("drop"))
        .withColumnsRenamed({"id": "drop_id", "own": "drop_own"})
    )
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.get(F.col("lines"), i)))
    return (
        base.join(dropped.hint("merge"), F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("own") == F.col("drop_own")), "left")
        .select("id", *also, "drop", as_column(lines).alias("lines"))
        .select("id", *also, F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
        .select(F.col("id").alias(id_col), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"), *also)
    )
