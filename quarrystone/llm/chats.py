"""Collapsing logged conversations that are prefixes of longer ones, and rendering what is left.

Cumulative logging writes a conversation again after every turn, so most logged
conversations are prefixes of a later one. Each turn gets a rolling prefix hash: the
XOR, over the turns up to it, of 128 bits of XXH64 of (place, role, text). A
conversation's own hash is that of its last turn. Those whose (turns, hash) is a proper
prefix of another are removed by an anti-join; of equal conversations the one
with the least id stays. What remains is rendered.

All in DataFrame operations. Hashes are deduplicated by partial aggregation before
they meet, so a first turn or a conversation that a third of the log repeats is one
row a task. A conversation's turns are brought together by its id: that is
the unit of the output.

Defined cases: turns are ordered by turn, then role and text (nulls first); a
null role or text differs from an empty one when hashing and renders as empty; a
null conv_id is a conversation of its own; rows with equal conv_id and turn are all
turns; a conversation that is a prefix only of itself stays; an empty table gives an
empty result. A backslash is doubled, and one is put into each ``<|`` of a text and
before each ``|`` of a role, so nothing in a conversation reads as a marker and two
different conversations never render alike (but for null and empty).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "<|", "|>"


def render_turn(role: Column, text: Column) -> Column:
    """One turn as <|role|>, a line break, the text, <|end|> and a line break."""


    def doubled(c: Column) -> Column:
        return F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))

    plain = F.replace(doubled(text), F.lit(OPEN), F.lit("<\\|"))
    return F.concat(F.lit(OPEN), F.replace(doubled(role), F.lit("|"), F.lit("\\|")), F.lit(CLOSE + "\n"), plain, F.lit("\n" + OPEN + "end" + CLOSE + "\n"))


def prefix_hashes(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, turns, role, text, p1, p2): the rolling hash up to every turn."""
    rows = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("place", F.row_number().over(order))
    seen = [F.col("place"), F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    placed = placed.withColumn("h1", F.xxhash64(*seen)).withColumn("h2", F.xxhash64(F.lit(1), *seen))
    return placed.select("conv", "place", F.count(F.lit(1)).over(Window.partitionBy("conv")).alias("turns"), "role", "text", F.bit_xor("h1").over(upto).alias("p1"), F.bit_xor("h2").over(upto).alias("p2"))


def maximal(turns: DataFrame, id_col: str = "conv_id", **columns: str) -> DataFrame:
    """(id, n_turns) of the conversations that no other one continues or repeats with a lesser id."""
    hashed = prefix_hashes(turns, id_col, **columns).select("conv", "place", "turns", "p1", "p2")
    own = hashed.where("place = turns").groupBy("turns", "p1", "p2").agg(F.min("conv").alias("conv"), F.count_if(F.col("conv").isNull()).alias("nulls"))
    prefixes = hashed.where("place < turns").select(F.col("place").alias("turns"), "p1", "p2").distinct()
    return own.join(prefixes.hint("merge"), ["turns", "p1", "p2"], "left_anti").select(F.col("conv").alias(id_col), F.col("turns").cast("long").alias("n_turns"))


def render(turns: DataFrame, kept: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, n_turns, rendered) of the kept conversations."""
    rows = turns.select(F.col(id_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).alias("t"))
    ids = kept.select(F.col(id_col).alias("kept_id"), "n_turns")
    whole = rows.join(ids, F.col("conv").eqNullSafe(F.col("kept_id"))).groupBy("conv", "n_turns").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return whole.select(F.col("conv").alias(id_col), "n_turns", F.array_join(F.transform("ts", lambda t: render_turn(t["role"], t["text"])), "").alias("rendered"))


def collapse(turns: DataFrame, id_col: str = "conv_id", **columns: str) -> DataFrame:
    """(id, n_turns, rendered): maximal conversations, rendered."""
    return render(turns, maximal(turns, id_col, **columns), id_col, **columns)
