"""Exact top-k search by integer inner product, with a uniform threshold in three phases.

A score is a sum over ``lists`` slices of the dimensions; each slice is a list of
partial scores of its own. Rows that are equal as integer vectors are one class, so
a vector that a third of the table repeats is scored once.

1. Every block of a list sends each query its k + 1 best partial scores. The ``depth``
   best of a list are scored in full; the (k + 1)-th best of these scores is a safe
   cutoff, as so many rows reach it.
2. The cutoff goes out with the queries. A row that reaches it has a partial score of
   at least cutoff / lists in some list, so the lists send all such entries and
   nothing below.
3. Of the rows that sent entries the other lists give their partial scores, so every
   score is exact; the best k + 1 classes and of their rows the best k + 1 stay. A
   query's own row is left out last.

Queries and rows meet in cells of (list, block of rows, chunk of queries) of bounded
size, as matrix products. Between cells only entries are shuffled. A query of which
every row ties with the k-th (a zero vector) collects all classes, once for all
queries with that vector.

Defined cases: vectors that are null or hold null or non-finite components, and rows
with a null id, take no part; missing components of shorter vectors (also of an
empty one) count as zero; ties go to the smaller id; rows equal in id and integer
vector are one row; different vectors under one id are rows of their own, each of
them a candidate of the other, and ``query_vector`` tells such queries apart; fewer
than k candidates give fewer rows; an empty table gives an empty result. Components
are cut to the range of a long, and a partial score to 2 ** 62 / lists.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

_ROW, _ASK, _PAIR = range(3)
_ENTRY = "q long, v long, list int, score long"


def integers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component; null where the vector takes no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def _matrix(parts: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    lengths = np.array(parts.combine_chunks().value_lengths()) if isinstance(parts, pa.ChunkedArray) else np.array(parts.value_lengths())
    out = np.zeros((len(lengths), width), np.int64)
    flat = (parts.combine_chunks() if isinstance(parts, pa.ChunkedArray) else parts).flatten().to_numpy(zero_copy_only=False)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _product(a: np.ndarray, b: np.ndarray, multiply: Callable, most: int) -> np.ndarray:
    """The exact product: in doubles while every sum fits into one, else in integers of 64 bits or, cut to most, of any size."""
    bound = a.shape[1] * max(map(abs, (int(a.max(initial=0)), int(a.min(initial=0))))) * max(map(abs, (int(b.max(initial=0)), int(b.min(initial=0)))))
    if bound < 1 << 53:
        return multiply(a.astype(float), b.astype(float)).astype(np.int64)
    out = multiply(a, b) if bound < 1 << 63 else multiply(a.astype(object), b.astype(object))
    return np.clip(out, -most, most).astype(np.int64)


def _cell(phase: int, width: int, best: int, lists: int) -> Callable[[pa.Table], pa.Table]:
    """What one cell sends: its best entries (1), all entries of at least cutoff / lists (2), or the pairs asked for (3)."""
    most = (1 << 62) // lists

    def send(table: pa.Table) -> pa.Table:
        kind, v = table["kind"].to_numpy(), table["v"].to_numpy()
        rows, asks = (table.filter(pa.array(kind == k)) for k in (_ROW, _ASK))
        row_v, ask_v, a, b = rows["v"].to_numpy(), asks["v"].to_numpy(), _matrix(asks["part"], width), _matrix(rows["part"], width)
        if phase == 3:
            q, v = table.filter(pa.array(kind == _PAIR))["q"].to_numpy(), v[kind == _PAIR]
            order_q, order_v = np.argsort(ask_v), np.argsort(row_v)
            at_q, at_v = order_q[np.searchsorted(ask_v, q, sorter=order_q)], order_v[np.searchsorted(row_v, v, sorter=order_v)]
            step = max(1, (1 << 22) // width)
            found = [_product(a[at_q[k : k + step]], b[at_v[k : k + step]], lambda x, y: (x * y).sum(axis=1), most) for k in range(0, len(q), step)]
            score = np.concatenate(found) if found else np.zeros(0, np.int64)
        else:
            scores = _product(a, b, lambda x, y: x @ y.T, most)
            if phase == 1:
                k = min(best, len(row_v))
                at = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k else np.zeros((len(ask_v), 0), int)
                at_q, at_v = np.repeat(np.arange(len(ask_v)), k), at.ravel()
            else:
                cut = asks["cut"].fill_null(-(1 << 63)).to_numpy()
                at_q, at_v = np.nonzero(lists * scores >= cut[:, None])
            q, v, score = ask_v[at_q], row_v[at_v], scores[at_q, at_v]
        n = len(q)
        number = table["list"][0].as_py() if len(table) else 0
        return pa.table([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(np.full(n, number, np.int32)), pa.array(score, pa.int64())], ["q", "v", "list", "score"])

    return send


class _Lists:
    """The classes' vectors cut into lists, and the cells in which they meet the queries' vectors."""

    def __init__(self, classes: DataFrame, lists: int, block_rows: int, chunk_rows: int) -> None:
        n, asks, dims = classes.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("vec"))).first()
        self.lists, self.width = lists, max(1, -(-(dims or 1) // lists))
        self.blocks, self.chunks = 1 + n // block_rows, 1 + asks // chunk_rows
        cuts = F.transform(F.sequence(F.lit(0), F.lit(lists - 1)), lambda k: F.struct(k.cast("int").alias("list"), F.slice("vec", k * self.width + 1, self.width).alias("part")))
        self.parts = classes.select("v", "asks", F.inline(cuts))

    def _block(self, v: str) -> Column:
        return F.pmod(F.xxhash64(v), F.lit(self.blocks)).cast("int")

    def _chunk(self, q: str) -> Column:
        return F.pmod(F.xxhash64(q, F.lit(1)), F.lit(self.chunks)).cast("int")

    def send(self, phase: int, best: int = 0, cuts: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
        """(q, v, list, score) of a phase. cuts: (q, cut); pairs: (q, v, list)."""
        nothing = {k: F.lit(None).cast(t).alias(k) for k, t in (("q", "long"), ("part", "array<long>"), ("cut", "long"))}
        asks = self.parts.where("asks")
        asks = asks.join(cuts.select(F.col("q").alias("v"), "cut"), "v", "left") if cuts is not None else asks.withColumn("cut", nothing["cut"])
        rows = self.parts.select("list", self._block("v").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(self.chunks - 1))).alias("chunk"), F.lit(_ROW).alias("kind"), "v", nothing["q"], "part", nothing["cut"])
        asks = asks.select("list", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("block"), self._chunk("v").alias("chunk"), F.lit(_ASK).alias("kind"), "v", nothing["q"], "part", "cut")
        both = rows.unionByName(asks)
        if pairs is not None:
            both = both.unionByName(pairs.select("list", self._block("v").alias("block"), self._chunk("q").alias("chunk"), F.lit(_PAIR).alias("kind"), "v", "q", nothing["part"], nothing["cut"]))
        return both.groupBy("list", "block", "chunk").applyInArrow(_cell(phase, self.width, best, self.lists), _ENTRY)

    def every(self) -> Column:
        return F.sequence(F.lit(0), F.lit(self.lists - 1))


def top_k(rows: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256, lists: int = 2, depth: int = 32, block_rows: int = 2048, chunk_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score, query_vector): the k highest inner products of floor(scale * vector) for every row where ``queries`` holds, ties to the smaller id."""
    scratch = Scratch(rows.sparkSession, "topk")
    keyed = rows.select(F.col(id_col).alias("id"), integers(F.col(vector_col), scale).alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks")).where("id IS NOT NULL AND vec IS NOT NULL")
    keyed = scratch.keep(keyed.groupBy("id", "vec").agg(F.max("asks").alias("asks")), "keyed")
    classes = scratch.keep(keyed.groupBy("vec").agg(F.max("asks").alias("asks")).withColumn("v", F.monotonically_increasing_id()), "classes")
    placed = scratch.keep(keyed.select("id", "vec", "asks").join(classes.select("vec", "v").hint("merge"), "vec").select("v", "id", "asks"), "placed")
    first = placed.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    first = first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    store = _Lists(classes, lists, block_rows, chunk_rows)

    best = Window.partitionBy("q", "list").orderBy(F.desc("score"), "v")
    tried = store.send(1, k + 1).withColumn("n", F.row_number().over(best)).where(F.col("n") <= depth).select("q", "v").distinct()
    tried = scratch.keep(tried, "tried")
    full = store.send(3, pairs=tried.withColumn("list", F.explode(store.every()))).groupBy("q", "v").agg(F.sum("score").alias("score"))
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "v")
    cuts = scratch.keep(full.withColumn("n", F.row_number().over(by_score)).where(F.col("n") == k + 1).select("q", F.col("score").alias("cut")), "cuts")

    sent = scratch.keep(store.send(2, cuts=cuts), "sent")
    seen = sent.groupBy("q", "v").agg(F.collect_set("list").alias("seen"))
    missing = seen.select("q", "v", F.explode(F.array_except(store.every(), "seen")).alias("list"))
    scores = sent.union(store.send(3, pairs=missing)).groupBy("q", "v").agg(F.sum("score").alias("score"))
    reached = scores.join(cuts, "q", "left").where("cut IS NULL OR score >= cut").join(first.hint("merge"), "v")

    leading = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    reached = reached.withColumn("n", F.row_number().over(leading)).where(F.col("n") <= k + 1)
    hits = F.transform("ids", lambda x: F.struct((-F.col("score")).alias("less"), x.alias("id"), F.col("v").alias("v")))
    hits = reached.groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list(hits))), 1, k + 1).alias("hits"))
    asking = placed.where("asks").select(F.col("v").alias("q"), F.col("id").alias("query_id"))
    others = F.slice(F.filter("hits", lambda h: (h["v"] != F.col("q")) | (h["id"] != F.col("query_id"))), 1, k)
    out = asking.join(hits.hint("merge"), "q").select("query_id", F.col("q").alias("query_vector"), F.posexplode(others).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.less")).alias("score"), "query_vector")
