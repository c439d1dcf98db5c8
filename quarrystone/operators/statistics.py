"""Retrieval metrics, agreement statistics and bootstrap intervals.

Point estimates are aggregations. The bootstrap draws exactly as many rows as there
are, with replacement, for every replicate. A statistic that does not tell equal rows
apart needs only how often each distinct row (a cell) is drawn: the draws are split over
leaves of cells by a tree of binomials, and over a leaf's cells by a multinomial. Every
draw is seeded by a hash of (seed, experiment, replicate, place in the tree), so reruns
and retried tasks draw the same, and no rows are copied.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarrystone.scratch import written


def ranking_metrics(items: DataFrame, target: str, candidates: str) -> DataFrame:
    """One row (items, hit_1, recall_3, recall_5, mrr) from a target and an ordered array of candidates; no items give zeros."""
    rank = F.coalesce(F.array_position(F.col(candidates), F.col(target)), F.lit(0))

    def share(most: int) -> Column:
        return F.round(F.coalesce(F.avg(F.when(rank.between(1, most), 1.0).otherwise(0.0)), F.lit(0.0)), 6)

    mrr = F.round(F.coalesce(F.avg(F.when(rank > 0, 1 / rank).otherwise(0.0)), F.lit(0.0)), 6)
    return items.agg(F.count(F.lit(1)).alias("items"), share(1).alias("hit_1"), share(3).alias("recall_3"), share(5).alias("recall_5"), mrr.alias("mrr"))


def recall_precision(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row (recall, precision) of 0/1 columns; a zero denominator gives 0."""
    both = F.sum(F.col(truth) * F.col(guess))

    def over(c: str) -> Column:
        return F.round(F.when(F.sum(c) > 0, both / F.sum(c)).otherwise(0.0), 6)

    return rows.agg(over(truth).alias("recall"), over(guess).alias("precision"))


def confusion(rows: DataFrame, a: str, b: str, labels: Sequence[int]) -> DataFrame:
    """(a, b, n) for every pair of labels, 0 where none."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(x, y) for x in labels for y in labels], "a long, b long")
    counts = rows.groupBy(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def kappa(rows: DataFrame, a: str, b: str, by: Sequence[str] = (), weights: str | None = None, copies: str | None = None) -> DataFrame:
    """(by, kappa): Cohen's kappa, unweighted or with quadratic weights; null where chance agreement is total."""
    count = F.sum(copies) if copies else F.count(F.lit(1))
    cells = rows.groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(count.cast("double").alias("_n"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy()
    of_a = Window.partitionBy(*by, "_a")
    of_b = Window.partitionBy(*by, "_b")
    margins_a = cells.select(*by, "_a", F.sum("_n").over(of_a).alias("_ra")).distinct()
    margins_b = cells.select(*by, "_b", F.sum("_n").over(of_b).alias("_rb")).distinct()
    off = (lambda x, y: F.pow(x - y, F.lit(2))) if weights == "quadratic" else (lambda x, y: F.when(x == y, 0.0).otherwise(1.0))
    seen = cells.withColumn("_all", F.sum("_n").over(whole)).groupBy(*by).agg((F.sum(off(F.col("_a"), F.col("_b")) * F.col("_n")) / F.max("_all")).alias("_seen"), F.max("_all").alias("_all"))
    cross = margins_a.join(margins_b, list(by)) if by else margins_a.crossJoin(margins_b)  # labels x labels rows
    chance = cross.groupBy(*by).agg(F.sum(off(F.col("_a"), F.col("_b")) * F.col("_ra") * F.col("_rb")).alias("_chance"))
    both = seen.join(chance, list(by)) if by else seen.crossJoin(chance)
    value = F.when(F.col("_chance") > 0, 1 - F.col("_seen") * F.col("_all") * F.col("_all") / F.col("_chance"))
    return both.select(*by, F.round(value, 6).alias("kappa"))


def krippendorff(units: DataFrame, unit: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, alpha): Krippendorff's alpha with the ordinal metric, from one row a rating; units with one rating do not count.

    The coincidence matrix has labels x labels cells; the ordinal distance of two
    labels is the squared sum of the margins between them, half of each end's.
    """
    keys = list(by)
    counts = units.where(F.col(value).isNotNull()).groupBy(*keys, F.col(unit).alias("_u"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_m", F.sum("_c").over(Window.partitionBy(*keys, "_u"))).where("_m > 1")
    left, right = counts.withColumnsRenamed({"_v": "_x", "_c": "_cx"}), counts.select(*keys, "_u", F.col("_v").alias("_y"), F.col("_c").alias("_cy"))
    pairs = left.join(right, [*keys, "_u"]).select(*keys, "_x", "_y", (F.col("_cx") * (F.col("_cy") - F.when(F.col("_x") == F.col("_y"), 1).otherwise(0)) / (F.col("_m") - 1)).alias("_o"))
    cells = pairs.groupBy(*keys, "_x", "_y").agg(F.sum("_o").alias("_o"))
    margins = cells.groupBy(*keys, "_x").agg(F.sum("_o").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    placed = margins.withColumn("_mid", F.sum("_n").over(upto) - F.col("_n") / 2).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    a = placed.withColumnsRenamed({"_n": "_na", "_mid": "_ma"})
    b = placed.select(*keys, F.col("_x").alias("_y"), F.col("_n").alias("_nb"), F.col("_mid").alias("_mb"))
    grid = (a.join(b, keys) if keys else a.crossJoin(b)).join(cells, [*keys, "_x", "_y"], "left")
    far = F.pow(F.col("_ma") - F.col("_mb"), F.lit(2))
    seen, chance = F.sum(F.coalesce("_o", F.lit(0.0)) * far), F.sum(F.col("_na") * F.col("_nb") * far)
    return grid.groupBy(*keys).agg(F.round(F.when(chance > 0, 1 - (F.max("_all") - 1) * seen / chance).otherwise(1.0), 6).alias("alpha"))


def _binomials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The draws that go to each half of a node: a binomial by the halves' rows, from the node's own hash."""
    for b in batches:
        draws = zip(*(b[c].to_pylist() for c in ("_hash", "_draws", "_left", "_right")), strict=True)
        left = [int(np.random.Generator(np.random.Philox(key=h & _MASK)).binomial(m, x / (x + y))) for h, m, x, y in draws]
        yield b.append_column("_one", pa.array(left, pa.int64()))


def _multinomials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The draws of each of a leaf's cells."""
    for b in batches:
        draws = zip(*(b[c].to_pylist() for c in ("_hash", "_draws", "_weights")), strict=True)
        each = [np.random.Generator(np.random.Philox(key=h & _MASK)).multinomial(m, np.array(w) / sum(w)).tolist() for h, m, w in draws]
        yield b.append_column("_copies", pa.array(each, pa.list_(pa.int64())))


_MASK = (1 << 64) - 1


def resampled(rows: DataFrame, cell: Sequence[str], by: Sequence[str] = (), replicates: int = 1000, seed: int = 7, leaf_cells: int = 256) -> DataFrame:
    """(by, replicate, cell, copies): n draws with replacement out of the n rows of each ``by``, for each replicate, as copies of the distinct cells.

    The copies of a replicate sum to n. Cells are dealt to leaves by a hash; a node of the tree over the leaves knows its rows, and hands its draws
    down to its two halves. So a task holds one leaf's cells at a time, whatever the number of cells. Rows with a null in by take no part.
    """
    groups = rows.dropna(subset=list(by)) if by else rows
    cells = groups.groupBy(*by, *cell).agg(F.count(F.lit(1)).alias("_n"))
    cells = written(cells.withColumn("_h", F.xxhash64(*cell, F.lit(seed))), "cells")
    most = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    depth = max(0, (most - 1) // leaf_cells).bit_length()
    cells = cells.withColumn("_node", F.pmod("_h", F.lit(1 << depth)))
    copies = F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    draws = cells.groupBy(*by).agg(F.sum("_n").alias("_draws")).withColumn("replicate", copies).withColumn("_node", F.lit(0).cast("long"))
    keys = [*by, "replicate"]

    def hashed(level: int) -> Column:
        return F.xxhash64(*keys, "_node", F.lit(level), F.lit(seed))

    for level in range(depth):
        halves = cells.groupBy(*by, F.shiftright("_node", depth - level - 1).alias("_half")).agg(F.sum("_n").alias("_rows"))
        sides = halves.groupBy(*by, F.shiftright("_half", 1).alias("_node")).agg(*[F.sum(F.when(F.col("_half") % 2 == k, F.col("_rows")).otherwise(0)).alias(name) for k, name in ((0, "_left"), (1, "_right"))])
        met = draws.join(sides, [*by, "_node"]).select(*keys, "_node", "_draws", "_left", "_right", hashed(level).alias("_hash"))
        split = met.mapInArrow(_binomials, T.StructType([*met.schema.fields, T.StructField("_one", T.LongType())]))
        down = F.array(F.struct((F.col("_node") * 2).alias("_node"), F.col("_one").alias("_draws")), F.struct((F.col("_node") * 2 + 1).alias("_node"), (F.col("_draws") - F.col("_one")).alias("_draws")))
        draws = written(split.select(*keys, F.inline(down)).where("_draws > 0"), "draws")
    fields = F.transform(F.array_sort(F.collect_list(F.struct("_h", F.struct(*cell).alias("c"), "_n"))), lambda x: F.struct(x["c"].alias("c"), x["_n"].alias("n")))
    leaves = cells.groupBy(*by, "_node").agg(fields.alias("_cells"))
    met = (draws.join(leaves, [*by, "_node"]) if by or depth else draws.drop("_node").crossJoin(leaves)).select(*keys, "_draws", F.transform("_cells", lambda x: x["n"]).alias("_weights"), F.transform("_cells", lambda x: x["c"]).alias("_held"), hashed(depth).alias("_hash"))
    each = met.mapInArrow(_multinomials, T.StructType([*met.schema.fields, T.StructField("_copies", T.ArrayType(T.LongType()))]))
    return each.select(*keys, F.inline(F.arrays_zip("_held", "_copies"))).where("_copies > 0").select(*keys, "_held.*", F.col("_copies").alias("copies"))


def interval(values: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """One row (low, high): exact percentiles with linear interpolation, ignoring nulls.

    Distinct values with their counts are dealt by ranges and written, so that the place of a value is a running count within its range
    after the counts of the ranges before it: only one count a range comes together, and the four values that stand at the places asked for.
    """
    tail = (1 - level) / 2
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    dealt = written(counts.repartitionByRange("_v").withColumn("_range", F.spark_partition_id()), "values")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(F.sum("_c").alias("_rows")).select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(starts, "_range").select("_v", (F.sum("_c").over(within) + F.col("_start")).alias("_upto"))
    last = dealt.agg((F.sum("_c") - 1).alias("_last"))  # one row

    def standing(place: Column) -> Column:
        """The value at a place from 0."""
        return F.min(F.when(F.col("_upto") > place, F.col("_v")))

    def at(share: float) -> Column:
        place = F.col("_last") * F.lit(share)
        low, high = F.floor(place), F.ceil(place)
        return F.struct(standing(low).alias("a"), standing(high).alias("b"), F.max(place - low).alias("part"))

    found = placed.crossJoin(last).agg(at(tail).alias("low"), at(1 - tail).alias("high"))
    return found.select(*[F.round(F.when(F.col(f"{c}.part") == 0, F.col(f"{c}.a")).otherwise((1 - F.col(f"{c}.part")) * F.col(f"{c}.a") + F.col(f"{c}.part") * F.col(f"{c}.b")), 6).alias(c) for c in ("low", "high")])


def pooled_interval(rows: DataFrame, experiment: str, cell: Sequence[str], value: Column, replicates: int = 1000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """One row (low, high) over the replicates of all experiments together. value is an aggregate of the cell columns that weighs rows by ``copies``; each experiment draws its own replicates."""
    drawn = resampled(rows, cell, [experiment], replicates, seed)
    return interval(drawn.groupBy(experiment, "replicate").agg(value.alias("value")), "value", level)


def label_vectors(counts: DataFrame, true_positive: str = "tp", predicted: str = "p", found: str = "pp", total: str = "n", keep: Sequence[str] = ()) -> DataFrame:
    """Rows (keep, truth, guess) with the given totals: tp, positives, predicted positives, all. Impossible totals raise when run."""
    tp, p, pp, n = (F.col(c) for c in (true_positive, predicted, found, total))
    fine = F.assert_true((n - p - pp + tp >= 0) & (tp <= p) & (tp <= pp), F.lit("the totals leave a negative cell"))
    cells = F.array(*[F.struct(F.lit(t).alias("truth"), F.lit(g).alias("guess"), c.cast("int").alias("c")) for t, g, c in ((1, 1, tp), (1, 0, p - tp), (0, 1, pp - tp), (0, 0, n - p - pp + tp))])
    return counts.where(fine.isNull()).select(*keep, F.inline(cells)).where("c > 0").select(*keep, "truth", "guess", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("i")).drop("i")
