"""Sharding by sampled splitters, law ``bytes``: shards of nearly equal size.

Rows are ordered by a key whose upper part is the hash of the text and whose
lower part is the hash of the id, so equal texts are neighbours and a huge group
of copies still has many keys.

1. One pass over the text gives (id, size, crc, hash, key); later passes read
   only that table.
2. A sample in which a row's odds are in proportion to its size is drawn by a
   hash of its id; its quantiles are the splitters of some thousands of ranges,
   many more than shards. The driver holds ``per_range`` keys a range, and a range
   has ``rows_per_range`` rows or more, so 10^11 rows are 4e5 ranges and 6e6 keys,
   50 MB as an array.
3. Bytes and rows of every range are counted. Overfull ranges are subdivided by
   a denser sample of their own and counted again, until none is left that a new
   splitter divides.
4. A row's place among all bytes is the total of the ranges before plus a window
   within its range, never a window over a shard. Shards end at equal steps of that
   place. An end that falls into a group of equal texts moves towards the nearer end
   of the group by at most ``slack`` of a shard: that holds for groups of all sizes,
   so small ones stay together and large ones are cut about where their bytes say.

Defined cases: null text has no bytes and checksum 0; an empty table gives an
empty result; repeated rows get places of their own; a null id sorts first, and
rows without one are dealt by where they were read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch

LOW = (1 << 24) - 1


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h"))
    told_apart = F.when(F.col("id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("id"))
    return rows.withColumn("key", F.col("h").bitwiseAND(F.lit(~LOW)).bitwiseOR(told_apart.bitwiseAND(F.lit(LOW))))


def _sample(rows: DataFrame, keys: float, total: int) -> np.ndarray:
    """Keys of about so many rows, drawn with odds in proportion to their size."""
    odds = F.pmod(F.xxhash64("id", "h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return np.sort(rows.where(odds < F.col("size") * F.lit(keys / max(total, 1))).select("key").toArrow().column(0).to_numpy())


def _splitters(sample: np.ndarray, ranges: int) -> np.ndarray:
    cuts = sample[len(sample) * np.arange(1, ranges) // ranges] if len(sample) else sample
    # A cut inside a small group of equal texts goes to the group's start; a group that several cuts hit is larger than a range.
    groups, at, often = np.unique(cuts & ~LOW, return_inverse=True, return_counts=True)
    return np.unique(np.where(often[at] > 1, cuts, groups[at]) if len(cuts) else cuts)


def _ranged(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    cuts = rows.sparkSession.sparkContext.broadcast(splitters)
    schema = T.StructType([*rows.schema.fields, T.StructField("r", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(cuts.value, b.column("key").to_numpy(zero_copy_only=False), side="right")
            yield b.append_column("r", pa.array(at, pa.int32()))

    return rows.mapInArrow(run, schema)


def _ranges(rows: DataFrame, total: int, ranges: int, per_range: int) -> tuple[DataFrame, pa.Table]:
    """rows with their range, and bytes and rows of every range in order."""
    splitters = _splitters(_sample(rows, ranges * per_range, total), ranges)
    while True:
        placed = _ranged(rows, splitters)
        found = placed.groupBy("r").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("first"), F.max("key").alias("last")).toArrow().sort_by("r")
        r, size, many, first, last = (found.column(k).to_numpy() for k in range(5))
        over = (first != last) & (size > 2.5 * total / ranges) & (many > 64 * per_range)
        bytes_over = int(size[over].sum())
        if not bytes_over:
            return placed, found
        parts = -(-2 * bytes_over * ranges // total)
        # The range of a row and whether it is overfull: a table of one row a range, met by hash or broadcast as its size tells.
        extra = _sample(placed.join(rows.sparkSession.createDataFrame(pa.table({"r": pa.array(r[over], pa.int32())})), "r"), parts * per_range, bytes_over)
        more = np.union1d(splitters, _splitters(extra, parts))
        if len(more) == len(splitters):
            return placed, found
        splitters = more


def _ends(places: DataFrame, total: int, shards: int, slack: float) -> list[float]:
    """Where each shard but the last ends, from (h, before, size): at most a row a shard comes to the driver."""
    step = total / shards
    ends = [step * k for k in range(1, shards)]
    at = F.ceil(F.col("before") / F.lit(step)) * F.lit(step)
    cut = places.where((at < F.col("before") + F.col("size")) & (at > 0)).select("h").distinct()
    groups = places.join(F.broadcast(cut), "h").groupBy("h").agg(F.min("before").alias("first"), F.sum("size").alias("size")).collect()
    spans = [(g["first"], g["first"] + g["size"]) for g in groups]
    for k, end in enumerate(ends):
        for first, last in spans:
            if first < end < last:
                edge = first if end - first <= last - end else last
                ends[k] = end + min(max(edge - end, -slack * step), slack * step)
    return ends


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 250_000, per_range: int = 16, slack: float = 0.01) -> DataFrame:
    """(id, size, crc, shard, slot) for each row of docs. slack is below a half."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    rows = scratch.keep(keyed(docs, id_col, text_col), "keys")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n:
        return rows.select(F.col("id").alias(id_col), "size", "crc", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    placed, found = _ranges(rows, total, max(32 * shards, -(-n // rows_per_range)), per_range)
    r, size, many = (found.column(k).to_numpy() for k in range(3))
    starts = pa.table({"r2": pa.array(r, pa.int32()), "bytes_before": np.cumsum(size) - size, "rows_before": np.cumsum(many) - many})
    starts = scratch.keep(spark.createDataFrame(starts), "starts")
    inside = Window.partitionBy("r").orderBy("h", "id")
    here = placed.withColumn("in_range", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("nth", F.row_number().over(inside) - 1)
    met = here.join(starts, F.col("r") == F.col("r2"))
    places = scratch.keep(met.select("id", "size", "crc", "h", (F.col("bytes_before") + F.col("in_range")).alias("before"), (F.col("rows_before") + F.col("nth")).cast("long").alias("place")), "places")
    ends = F.array(*[F.lit(e) for e in _ends(places, total, shards, slack)]).cast("array<double>")
    middle = F.col("before") + F.col("size") / 2
    near = F.least(F.floor(middle * shards / F.lit(total)), F.lit(shards - 1)).cast("int")  # one off at most, as no end moves by half a shard
    near = near - F.when(middle < F.get(ends, near - 1), 1).otherwise(0) + F.when(middle >= F.get(ends, near), 1).otherwise(0)
    placed = places.select("id", "size", "crc", "place", near.alias("shard"))
    first = scratch.keep(placed.groupBy("shard").agg(F.min("place").alias("first")).withColumnRenamed("shard", "of"), "firsts")
    # At most ``shards`` rows: a proven bound.
    return placed.join(F.broadcast(first), F.col("shard") == F.col("of")).select(F.col("id").alias(id_col), "size", "crc", "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", **options: object) -> None:
    """The rows themselves as one Parquet folder a shard, in slot order within each file."""
    plan = shard(docs, shards, id_col, **options).select(F.col(id_col).alias("_shard_id"), "shard", "slot")
    out = docs.join(plan, F.col(id_col).eqNullSafe(F.col("_shard_id"))).drop("_shard_id")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

