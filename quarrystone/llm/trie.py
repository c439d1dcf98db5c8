"""The trie of conversation prefixes, with subtree totals by leaf-peeling message passing.

A node is a distinct sequence of turns that begins some conversation; it is known by
its depth and the XOR, over its turns, of 128 bits of XXH64 of (place, role, text).

1. Turns are dealt by ranges of (conversation, turn), numbered in their range and
   shifted by the rows of the ranges before, so no conversation has to fit a task.
   Only hashes and sizes travel, no texts (and the role, for the order of equal turns).
2. Prefix hashes are running XORs within ``run`` turns, shifted by the runs before.
3. A node's members are counted by partial aggregation. Each node belongs to the path
   of its longest member (ties: the smallest conversation), so the nodes of one
   conversation's path are consecutive, and a path hangs on a node of another one.
4. Leaves are peeled off: a path holds the number of paths that still have to report.
   Where none is left, it sends its totals to the path that it hangs on, and is done;
   its parent's counter falls. That goes on until the root's path has finished. A path
   of single children is one step, so rounds follow branchings below branchings (at
   most about the root of twice the number of nodes; ten or so in practice), not depth.
5. A node's totals are the sums, from its path's end up to it, of its own figures and
   of what has reported there, again in runs.
6. The ids that end in a node are hashed in order as a stream: sorted ranges write them
   as pieces of text of bounded size, and the pieces are fed to SHA-256 one by one.

Defined cases: turns are ordered by turn (null first), then role, then the MD5 of the
text; null role or text is empty; rows with a null conversation take no part; equal
rows are turns of their own; ``c % every`` keeps the sign of c, as in SQL; an empty table
gives an empty result, without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

_NODE = ["depth", "p1", "p2"]


def _running(rows: DataFrame, key: str, place: str, sums: dict[str, Column], run: int, fold: str = "sum", backward: bool = False) -> DataFrame:
    """rows with running folds of sums over each key by place (a number), from its start, or backward from its end, up to and with the row.

    A key's rows are taken in runs of so many places, each in a task of its own; what is before a run comes from one row a run.
    """
    add = {"sum": F.sum, "bit_xor": F.bit_xor}[fold]
    rows = rows.withColumn("_run", F.floor(F.col(place) / run))
    order = F.desc if backward else F.asc
    inner = Window.partitionBy(key, "_run").orderBy(order(place)).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(key).orderBy(order("_run")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, "_run").agg(*[add(v).alias(f"_{k}") for k, v in sums.items()])
    before = totals.select(key, "_run", *[add(f"_{k}").over(outer).alias(f"_{k}") for k in sums])
    inside = rows.withColumns({k: add(v).over(inner) for k, v in sums.items()}).join(before, [key, "_run"])
    both = {k: F.col(k).bitwiseXOR(F.coalesce(f"_{k}", F.lit(0))) if fold == "bit_xor" else F.col(k) + F.coalesce(f"_{k}", F.lit(0)) for k in sums}
    return inside.withColumns(both).drop("_run", *[f"_{k}" for k in sums])


def numbered_turns(turns: DataFrame, scratch: Scratch, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, place, t1, t2, bytes): every turn's place from 1 in its conversation, its hashes and the UTF-8 bytes of its text."""
    rows = turns.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), *[F.coalesce(F.col(c), F.lit("")).alias(k) for k, c in (("role", role_col), ("text", text_col))]).where("conv IS NOT NULL")
    seen = rows.select("conv", "turn", "role", F.md5("text").alias("md5"), F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "role", "text").alias("t2"), F.octet_length("text").cast("long").alias("bytes"), F.rand(13).alias("deal"))
    order = ["conv", "turn", "role", "md5", "deal"]
    dealt = scratch.keep(seen.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "dealt")
    starts = dealt.groupBy("conv", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("conv", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("conv", "range").orderBy(*order[1:])) + F.col("start")
    return dealt.join(starts, ["conv", "range"]).select("conv", place.alias("place"), "t1", "t2", "bytes")


def rebuilt(turns: DataFrame, scratch: Scratch, every: int, most: int) -> DataFrame:
    """(conv, place, t1, t2, bytes, turns) and a row of place 0 for every conversation: c starts with the first h turns of c - c % every, h = crc32(c) % most, and goes on with its own turns after its first h."""
    convs = turns.groupBy("conv").agg(F.max("place").alias("own"))
    convs = convs.withColumn("base", F.col("conv") - F.col("conv") % every).withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int"))
    bases = convs.select(F.col("conv").alias("base"), F.col("own").alias("held"))
    convs = convs.join(bases, "base", "left").withColumn("held", F.least("h", F.coalesce("held", F.lit(0))))
    convs = scratch.keep(convs.withColumn("turns", F.col("held") + F.greatest(F.lit(0), F.col("own") - F.col("h"))), "convs")
    first = turns.where(F.col("place") < most).withColumnRenamed("conv", "base").join(convs, "base").where("place <= h")
    own = turns.join(convs, "conv").where("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("held"))
    columns = ["conv", "place", "t1", "t2", "bytes", "turns"]
    root = convs.select("conv", F.lit(0).alias("place"), *[F.lit(0).cast("long").alias(c) for c in ("t1", "t2", "bytes")], "turns")
    return first.select(*columns).unionByName(own.select(*columns)).unionByName(root)


def prefixes(turns: DataFrame, scratch: Scratch, run: int) -> DataFrame:
    """(conv, node's key, up1, up2, bytes, turns): every conversation's prefixes, with the hashes of the one before. turns: (conv, place, t1, t2, bytes, turns), a written table."""
    hashed = {f"h{k}": F.when(F.col("place") == 0, F.lit(0)).otherwise(F.xxhash64(F.lit(k), "place", "t1", "t2")) for k in (1, 2)}
    upto = _running(turns.withColumns(hashed), "conv", "place", {"p1": F.col("h1"), "p2": F.col("h2")}, run, "bit_xor")
    return scratch.keep(upto.select("conv", F.col("place").alias("depth"), "p1", "p2", F.col("p1").bitwiseXOR(F.col("h1")).alias("up1"), F.col("p2").bitwiseXOR(F.col("h2")).alias("up2"), "bytes", "turns"), "prefixes")


def nodes(upto: DataFrame, scratch: Scratch) -> DataFrame:
    """(node's key, up1, up2, bytes, conv_id, n_convs, path, length): the distinct prefixes, with the id and length of their longest member."""
    longest = F.min(F.struct((-F.col("turns")).alias("less"), F.col("conv")))
    found = upto.groupBy(*_NODE).agg(F.min("up1").alias("up1"), F.min("up2").alias("up2"), F.min("bytes").alias("bytes"), F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), longest.alias("longest"))
    return scratch.keep(found.select(*_NODE, "up1", "up2", "bytes", "conv_id", "n_convs", F.col("longest.conv").alias("path"), (-F.col("longest.less")).alias("length")), "nodes")


def peel(paths: DataFrame, scratch: Scratch) -> DataFrame:
    """(path, at, n_leaves, saved_tokens): what each path has reported to the path ``up`` it hangs on, at its node of depth ``at``.

    paths: (path, up, at, n_leaves, saved_tokens), the figures those of the path's own nodes; up is null for the root's. Every round is a written table, so a lost executor costs its tasks only.
    """
    waiting = paths.groupBy(F.col("up").alias("path")).agg(F.count(F.lit(1)).alias("open"))
    live = scratch.keep(paths.join(waiting, "path", "left").withColumn("open", F.coalesce("open", F.lit(0))), "live-0")
    reports, left, k = [], live.count(), 0
    while left:
        k += 1
        done = live.where("open = 0")
        sent = scratch.keep(done.where("up IS NOT NULL").select(F.col("up").alias("path"), "at", "n_leaves", "saved_tokens"), f"sent-{k}")
        reports.append(sent)
        mail = sent.groupBy("path").agg(F.count(F.lit(1)).alias("came"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        live = live.where("open > 0").join(mail, "path", "left")
        live = live.withColumns({"open": F.col("open") - F.coalesce("came", F.lit(0)), "n_leaves": F.col("n_leaves") + F.coalesce("leaves", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("saved", F.lit(0))})
        live = scratch.keep(live.drop("came", "leaves", "saved"), f"live-{k}")
        before, left = left, live.count()
        if left == before:
            raise RuntimeError("no path has finished: the links of the trie form a ring")
    return reduce(DataFrame.unionByName, reports) if reports else paths.where("false").select("path", "at", "n_leaves", "saved_tokens")


def _pieces(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Sorted (key, id) rows as (key, first id, ids joined by commas) of bounded size."""
    key, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"depth": [key[0]], "p1": [key[1]], "p2": [key[2]], "first": [ids[0]], "ids": [",".join(map(str, ids))]}, pa.schema([("depth", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))

    out = []
    for batch in batches:
        for *now, i in zip(*(batch[c].to_pylist() for c in (*_NODE, "conv")), strict=True):
            if ids and (now != key or len(ids) == most):
                out.append(piece())
                ids = []
            key = now
            ids.append(i)
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            out = []
    if ids:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces as (key, SHA-256 of all the key's ids joined by commas); one hash state is held at a time."""
    key, state, out = None, None, []
    for batch in batches:
        for *now, ids in zip(*(batch[c].to_pylist() for c in (*_NODE, "ids")), strict=True):
            if now == key:
                state.update(b"," + ids.encode())
                continue
            out += [(*key, state.hexdigest())] if key else []
            key, state = now, hashlib.sha256(ids.encode())
        if out:
            yield _digest_batch(out)
            out = []
    if key:
        yield _digest_batch([(*key, state.hexdigest())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], [*_NODE, "ends_sha256"])


def ends(upto: DataFrame) -> DataFrame:
    """(node's key, ends_sha256) of the nodes in which conversations end."""
    own = upto.where("depth = turns").select(*_NODE, "conv")
    order = [*_NODE, "conv"]
    pieces = own.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "depth long, p1 long, p2 long, first long, ids string")
    return pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(_digests, "depth long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", every: int = 1, most: int = 1, run: int = 1024) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    every=1 takes conversations as they are; else they are rebuilt, see ``rebuilt``. saved_tokens counts bytes that would not have to be read again if the prefixes that members share were kept.
    """
    scratch = Scratch(turns.sparkSession, "trie")
    seen = scratch.keep(numbered_turns(turns, scratch, id_col, turn_col, role_col, text_col), "turns")
    upto = prefixes(scratch.keep(rebuilt(seen, scratch, every, most), "rebuilt"), scratch, run)
    found = nodes(upto, scratch)
    up = found.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("up1"), F.col("p2").alias("up2"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("up"))
    found = found.join(up.hint("merge"), ["depth", "up1", "up2"], "left")
    leaf, saved = (F.col("depth") == F.col("length")).cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
    found = scratch.keep(found.withColumns({"leaf": leaf, "saved": saved}), "linked")

    top = F.col("up").isNull() | (F.col("up") != F.col("path"))
    own = found.groupBy("path").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.max(F.when(top, F.col("up"))).alias("up"), (F.min("depth") - 1).alias("at"))
    came = peel(own.select("path", "up", "at", "n_leaves", "saved_tokens"), scratch)
    came = came.groupBy("path", F.col("at").alias("depth")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("tokens"), F.count(F.lit(1)).alias("paths"))
    both = scratch.keep(found.join(came.hint("merge"), ["path", "depth"], "left"), "totals")
    figures = {"n_leaves": F.col("leaf") + F.coalesce("leaves", F.lit(0)), "saved_tokens": F.col("saved") + F.coalesce("tokens", F.lit(0))}
    both = _running(both, "path", "depth", figures, run, backward=True)
    both = both.withColumn("n_children", F.coalesce("paths", F.lit(0)) + 1 - F.col("leaf"))
    both = both.join(ends(upto).hint("merge"), _NODE, "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return both.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
