"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document i of a source gets a rate r_i, the expected number of its copies.
Of all rates that give the source its target T of tokens, entropy balancing takes
those nearest to one copy each, in the divergence sum of d_i KL(r_i, 1) with
d_i = w_i ** (1 - tilt) for w_i tokens. The dual has one variable a source and its
optimum tilts the rates exponentially,

    r_i = min(cap, exp(lambda * x_i)),    x_i = (w_i / mean size) ** tilt,

where sum of w_i r_i = T. With tilt 0 all documents of a source move alike; with
tilt 1 documents count alike whatever their length and long ones take most of the
change. The default, 0.5, lies between.

1. One pass over the text counts tokens; (source, size, documents) is a sufficient
   statistic of the dual, so Newton's iterations aggregate that small table.
   They run for all sources at once, kept inside a bracket (a step that leaves
   it is a bisection), until every source's residual is below ``tolerance``.
2. Rounding into copies: floor(r_i) plus one more for documents whose order key
   u_i / frac(r_i) is below the source's threshold, u_i a hash of the id. The
   threshold is found by refining histograms of the key, ``bins`` a source and round,
   and the one document whose size fits the remaining gap best changes by a copy.
   Only histograms are aggregated; no source is gathered in one task.

Source tables are joined by the planner's own choice of strategy: it broadcasts
them only below its size threshold and can split a hot source otherwise.

Defined cases: null source is a source of its own, after all others; null, empty
or blank text has size 0 and is taken 0; an empty table gives an empty result;
rows that repeat id and text are taken alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, beside, word_count


def water_fill(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Adds target to (source, source_size): shares of share * all sizes by repeating weights, none above cap * its size, the excess reshared by weight.

    The result is min(cap * size, level * weight) with one level for all; sources
    are capped in order of cap * size / weight. The windows hold sources, not rows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    out = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    out = (
        out.withColumn("total", F.sum("source_size").over(everything) * float(share))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("most_before", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    # The level if exactly the sources before this one were capped; the true level is that of the first source that stays below its cap at it.
    level = (F.col("total") - F.col("most_before")) / (F.col("all_weight") - F.col("weight_before"))
    out = out.withColumn("level", level).withColumn("true_level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return out.select("source", "source_size", F.least("most", F.coalesce(F.col("true_level") * F.col("weight"), F.col("most"))).alias("target"))


def _solve(sizes: DataFrame, targets: DataFrame, scratch: Scratch, tilt: float, cap: float, tolerance: float, most_rounds: int = 60) -> DataFrame:
    """(source, target, source_size, mean, lam): Newton's method on the dual, safeguarded by a bracket."""
    stats = sizes.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    state = targets.join(stats, targets.source.eqNullSafe(stats.source), "left").select(
        targets.source,
        "source_size",
        "target",
        F.coalesce("mean", F.lit(1.0)).alias("mean"),
        F.lit(-60.0).alias("low"),
        F.coalesce(F.lit(1.0) / F.pow(F.col("least") / F.col("mean"), F.lit(tilt)), F.lit(1.0)).alias("high"),
    )
    state = state.withColumn("low", F.col("low") * F.col("high")).withColumn("high", F.log(F.lit(float(cap))) * F.col("high")).withColumn("off", F.lit(1.0))
    # A source whose target is its cap needs no search: at the upper end every document is at the cap.
    state = state.withColumn("lam", F.when(F.col("target") >= F.col("source_size") * (cap * (1 - 1e-12)), F.col("high")).otherwise(0.0))
    state = scratch.keep(state, "state-0")
    x = F.pow(F.col("size") / F.col("mean"), F.lit(tilt))
    rate = F.exp(F.col("lam") * x)
    for k in range(1, most_rounds):
        tilted = sizes.where("size > 0").withColumnRenamed("source", "of").join(state.select("source", "lam", "mean"), F.col("of").eqNullSafe(F.col("source")))
        mass = F.col("n") * F.col("size")
        sums = tilted.groupBy("of").agg(F.sum(mass * F.least(rate, F.lit(float(cap)))).alias("got"), F.sum(F.when(rate < cap, mass * x * rate).otherwise(0.0)).alias("slope"))
        gap = F.coalesce("got", F.lit(0.0)) - F.col("target")
        now = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("gap", gap)
        now = now.withColumn("low", F.when(F.col("gap") <= 0, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("gap") >= 0, F.col("lam")).otherwise(F.col("high")))
        step = F.when(F.col("slope") > 0, F.col("lam") - F.col("gap") / F.col("slope"))
        inside = step.isNotNull() & (step > F.col("low")) & (step < F.col("high"))
        off = F.abs("gap") / F.greatest("target", F.lit(1.0))
        done = (off <= tolerance) | (F.col("high") - F.col("low") < 1e-12)
        state = now.select("source", "source_size", "target", "mean", "low", "high", F.when(done, F.col("lam")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2).alias("lam"), F.when(done, 0.0).otherwise(off).alias("off"))
        state = scratch.keep(state, f"state-{k}")
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            return state
    raise RuntimeError(f"the rates did not settle in {most_rounds} rounds")


def _numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (a written table with its writer's partition as ``piece``) with ``copy``: 0, or from 1 on the number of a row among those of equal id and text. No group is gathered: a piece numbers its own and starts after the pieces before."""
    pieces = rows.groupBy("id", "text_hash", "piece").agg(F.count(F.lit(1)).alias("here"))
    whole = pieces.groupBy("id", "text_hash").agg(F.sum("here").alias("n")).where("n > 1").select(F.col("id").alias("same_id"), F.col("text_hash").alias("same_hash"))
    again = scratch.keep(whole, "repeated")
    equal = F.col("id").eqNullSafe(F.col("same_id")) & (F.col("text_hash") == F.col("same_hash"))
    of_piece = Window.partitionBy("id", "text_hash", "piece")
    starts = pieces.join(beside(again), equal, "left_semi").withColumn("before", F.coalesce(F.sum("here").over(Window.partitionBy("id", "text_hash").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.select(F.col("id").alias("same_id"), F.col("text_hash").alias("same_hash"), F.col("piece").alias("same_piece"), "before")
    repeated = rows.join(beside(again), equal, "left_semi").withColumn("copy", F.row_number().over(of_piece.orderBy("size")))
    repeated = repeated.join(starts, equal & (F.col("piece") == F.col("same_piece"))).select(*rows.columns, (F.col("copy") + F.col("before")).alias("copy"))
    once = rows.join(beside(again), equal, "left_anti").withColumn("copy", F.lit(0).cast("long"))
    return once.unionByName(repeated).drop("piece")


def _thresholds(rated: DataFrame, state: DataFrame, scratch: Scratch, bins: int, rounds: int) -> DataFrame:
    """(source, theta): documents with an order key below theta get one copy more, so that each source comes nearest its target."""
    fixed = rated.groupBy("source").agg(F.sum(F.col("size") * F.col("floor")).alias("fixed")).withColumnRenamed("source", "of")
    at = state.join(fixed, F.col("source").eqNullSafe(F.col("of")), "left").select("source", (F.col("target") - F.coalesce("fixed", F.lit(0))).alias("need"), F.lit(0.0).alias("low"), F.lit(64.0).alias("width"))
    for k in range(rounds):
        at = scratch.keep(at, f"threshold-{k}")
        near = rated.where("frac > 0").withColumnRenamed("source", "of").join(at, F.col("of").eqNullSafe(F.col("source")))
        near = near.where((F.col("order_key") >= F.col("low")) & (F.col("order_key") < F.col("low") + F.col("width")))
        hist = near.groupBy("source", F.floor((F.col("order_key") - F.col("low")) / F.col("width") * bins).alias("bin")).agg(F.sum("size").alias("tokens"))
        upto = Window.partitionBy("source").orderBy("bin")  # at most ``bins`` rows a source
        hist = hist.withColumn("sum", F.sum("tokens").over(upto)).withColumnRenamed("source", "of")
        crossed = at.join(hist, F.col("source").eqNullSafe(F.col("of")) & (F.col("sum") <= F.col("need")), "left")
        crossed = crossed.groupBy("source", "need", "low", "width").agg(F.coalesce(F.max("bin") + 1, F.lit(0)).alias("bin"), F.coalesce(F.max("sum"), F.lit(0)).alias("sum"))
        # The bins up to here fit whole; the next bin with documents crosses the need and is refined.
        following = hist.withColumnRenamed("bin", "next").select("of", "next", F.col("sum").alias("next_sum"))
        crossed = crossed.join(following, F.col("source").eqNullSafe(F.col("of")) & (F.col("next") >= F.col("bin")), "left").groupBy("source", "need", "low", "width", "bin", "sum").agg(F.min("next").alias("next"), F.min("next_sum").alias("next_sum"))
        narrow = F.coalesce("next", "bin")
        last = k == rounds - 1
        # In the last round the crossing bin goes in if that comes nearer.
        end = F.when(F.col("next_sum").isNotNull() & (F.col("next_sum") - F.col("need") < F.col("need") - F.col("sum")), F.col("next") + 1).otherwise(F.col("bin"))
        at = crossed.select("source", (F.col("need") - F.col("sum")).alias("need"), (F.col("low") + F.col("width") * (end if last else narrow) / bins).alias("low"), (F.col("width") / bins).alias("width"))
    return at.select("source", F.col("low").alias("theta"))


def _one_more_step(out: DataFrame, scratch: Scratch, cap: int) -> DataFrame:
    """In each source, one document gains or loses a copy if that brings the source nearer its target: the one whose size fits the gap best."""
    gaps = scratch.keep(out.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("gap")), "gaps").withColumnRenamed("source", "of")
    near = out.where("frac > 0").join(gaps, F.col("source").eqNullSafe(F.col("of")))
    way = F.when((F.col("gap") > 0) & (F.col("copies") < F.least(F.col("floor") + 1, F.lit(cap))), 1).when((F.col("gap") < 0) & (F.col("copies") > F.col("floor")), -1)
    near = near.withColumn("way", way).where(F.col("way").isNotNull()).withColumn("left", F.abs(F.col("gap") - F.col("way") * F.col("size")))
    best = near.where(F.col("left") < F.abs("gap")).groupBy("of").agg(F.min(F.struct("left", "u", "id", "text_hash", "copy", "way")).alias("best"))
    best = scratch.keep(best.select("of", "best"), "steps")
    same = F.col("source").eqNullSafe(F.col("of")) & F.col("id").eqNullSafe(F.col("best.id")) & (F.col("text_hash") == F.col("best.text_hash")) & (F.col("copy") == F.col("best.copy"))
    stepped = out.join(best, same, "left").withColumn("way", F.col("best.way"))
    return stepped.withColumn("copies", F.col("copies") + F.when(F.col("frac") > 0, F.coalesce("way", F.lit(0))).otherwise(0))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: int = 2, tilt: float = 0.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tolerance: float = 1e-7, bins: int = 1024, rounds: int = 3) -> DataFrame:
    """(id, source, size, source_size, target, rate, copies, taken, text_hash, repeat) for each row of docs; text_hash is xxhash64 of the text, repeat numbers rows of equal id and text from 1 and is 0 for others."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash"))
    rows = scratch.keep(rows.withColumn("piece", F.spark_partition_id()), "sizes")
    sizes = scratch.keep(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    state = _solve(sizes, scratch.keep(water_fill(sources, weights, share, cap), "targets"), scratch, tilt, cap, tolerance)
    x = F.pow(F.col("size") / F.col("mean"), F.lit(tilt))
    rate = F.when(F.col("size") > 0, F.least(F.exp(F.col("lam") * x), F.lit(float(cap)))).otherwise(0.0)
    drawn = F.when(F.col("copy") == 0, F.xxhash64("id", "text_hash", F.lit("mix"))).otherwise(F.xxhash64("id", "text_hash", F.lit("mix"), "copy"))
    odds: Column = (F.pmod(drawn, F.lit(1 << 48)) + 1) / F.lit(float(1 << 48))
    rated = _numbered(rows, scratch).withColumnRenamed("source", "of").join(state.select("source", "source_size", "target", "mean", "lam"), F.col("of").eqNullSafe(F.col("source"))).select("id", "text_hash", "copy", "source", "size", "source_size", "target", rate.alias("rate"), odds.alias("u"))
    rated = rated.withColumn("floor", F.floor(F.col("rate") + 1e-9)).withColumn("frac", F.greatest(F.col("rate") - F.col("floor"), F.lit(0.0)))
    rated = scratch.keep(rated.withColumn("order_key", F.when(F.col("frac") > 0, F.least(F.col("u") / F.col("frac"), F.lit(63.0)))), "rates")
    theta = scratch.keep(_thresholds(rated, state, scratch, bins, rounds), "thetas").withColumnRenamed("source", "of")
    copies = F.col("floor") + F.when((F.col("frac") > 0) & (F.col("order_key") < F.col("theta")), 1).otherwise(0)
    out = rated.join(theta, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", copies.cast("int")).drop("of")
    out = _one_more_step(scratch.keep(out, "copies"), scratch, cap)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"), "text_hash", F.col("copy").alias("repeat"))
