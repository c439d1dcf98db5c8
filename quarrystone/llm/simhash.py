"""SimHash near-dedup by segment popcounts.

1. A 64-bit SimHash per document over word shingles (Arrow batches, XXH64).
   Equal fingerprints collapse to one before anything is compared.
2. Segment-popcount embedding: a fingerprint becomes the vector of the bit
   counts of its 32 two-bit segments. The Manhattan distance of two vectors is
   a lower bound of the Hamming distance of their fingerprints.
3. Grid range-join: on an integer grid two vectors within distance 2 share a
   lattice point within distance 1 of each. Every fingerprint is put at its own
   cell and its neighbours; only fingerprints that meet another one at some
   point go on. Random fingerprints meet with odds of about 2e-11 a pair.
4. Exact verification, again without pairs: two fingerprints differ in 2 bits
   or fewer exactly if one flip or none of each leads to a common value. Those
   that share a value are linked to the least of them, so a group of thousands of
   near copies costs rows in proportion to its size and loses no link.
5. Connected components of these links by alternating large and small stars,
   each round written to the shared folder.

Shuffles hold fingerprints only, about 49 rows for each distinct one; text never
moves. Nothing is broadcast or collected.

Defined cases: null, empty or blank text has fingerprint zero; texts with fewer
words than a shingle are one shingle; a null doc_id is a member of its component
but never its id unless all are null; repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

SEGMENTS = 32


def shingle_hashes(text: bytes | None, shingle: int = 3) -> np.ndarray:
    """The 64-bit hashes of a UTF-8 text's word shingles, repeats included; none without a word."""
    words = text.lower().split() if text else []  # bytes: ASCII only, as asked
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The signed 64-bit fingerprint of shingle hashes: a bit is 1 if set in over half of them; zero of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def simhash(text: bytes | None, shingle: int = 3) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text."""
    return fingerprint(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([simhash(t.as_py(), shingle) for t in b.column(1)], pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def popcount_cell(fp: Column) -> Column:
    """The bit counts (0 to 2) of the two-bit segments, two bits for each."""
    cell = F.lit(0).cast("long")
    for k in range(SEGMENTS):
        ones = F.bit_count(F.shiftrightunsigned(fp, 2 * k).bitwiseAND(F.lit(3))).cast("long")
        cell = cell.bitwiseOR(F.shiftleft(ones, 2 * k))
    return cell


def lattice_points(cell: Column) -> Column:
    """A cell and the cells next to it, one count up or down; null where that would leave 0 to 2."""
    near = []
    for k in range(SEGMENTS):
        count = F.shiftrightunsigned(cell, 2 * k).bitwiseAND(F.lit(3))
        # In a two-bit field 0 and 1 differ in the low bit, 1 and 2 in both.
        near += [F.when(count < 2, cell.bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), 2 * k)))]
        near += [F.when(count > 0, cell.bitwiseXOR(F.shiftleft(F.lit(3).cast("long"), 2 * k)))]
    return F.array(cell, *near)


def _shared(points: DataFrame) -> DataFrame:
    """(p, least): the points at which two fingerprints or more meet, with the least of them."""
    return points.groupBy("p").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most").select("p", "least")


def links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) with u > v: star links whose components are those of all pairs of fingerprints within 2 bits."""
    points = distinct.select("fp", F.explode(lattice_points(F.col("cell"))).alias("p")).where("p IS NOT NULL")
    near = scratch.keep(points.join(_shared(points).select("p").hint("merge"), "p", "left_semi").select("fp").distinct(), "candidates")
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)])
    values = near.select("fp", F.explode(flips).alias("p"))
    return values.join(_shared(values).hint("merge"), "p").where("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component_id) for each row: component_id is the smallest id that links of 2 bits or fewer reach."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = scratch.keep(rows.groupBy("fp").agg(F.min("id").alias("least_id")).withColumn("cell", popcount_cell(F.col("fp"))), "distinct")
    roots = components(links(distinct, scratch), scratch)
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    owner = scratch.keep(rooted.join(ids, "root").select(F.col("fp").alias("own"), "component_id"), "owner")
    return rows.join(owner.hint("merge"), rows.fp == owner.own).select(F.col("id").alias(id_col), "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
