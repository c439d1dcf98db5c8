"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

1. The top of the tree is fitted in the driver on about ``sample_rows`` vectors at most (drawn
   by a hash of the id): nodes are split into ``branch`` clusters until one holds ``cell_rows``
   of the sample. Below it every such cell is split further by a task, on about ``sample_rows``
   of the cell's own vectors, until a leaf holds ``leaf_rows`` of them. So leaves keep their
   size and their number grows with the rows, up to a bound that follows from the parameters
   (about 3 * sample_rows ** 2 / (cell_rows * leaf_rows), some 50 MB of centres in 64 dimensions);
   beyond it leaves grow. The whole tree is broadcast.
2. Every row descends to a leaf and is written. Neighbouring leaves share a bin of about
   ``block_rows`` rows; a leaf with more, as a very common vector makes, is dealt into blocks.
3. A query visits leaves best bin first: a priority queue holds the unopened nodes by
   the distance of their centres; the nearest is opened until it is a leaf.
4. The number of visits is calibrated: for at most ``calibration`` queries the true
   neighbours are found by a scan of all rows, and visits widen until ``recall`` of them
   lie in visited leaves. A query also widens until its leaves hold k + 1 rows.
5. A query goes once to every bin that holds leaves it visits, with their numbers. Queries
   and rows meet by (bin, block) in Arrow groups of bounded size; only the k best of a
   group leave it, with exact double-precision distances.

Defined cases: vectors that are null, empty, zero, hold null or non-finite values, or
differ in length from most take no part; ties go to the smaller id; fewer than k
candidates give fewer rows; an empty table gives an empty result; null ids take no part.
Rows equal in id and vector are one row, as a query and as a candidate. Different vectors
under one id are rows of their own, each a candidate of the other; ``query_row`` tells
such queries apart. Rows are numbered in the order of their ids, so ties by number are
ties by id.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Tree:
    """centres of all nodes, children of each (none for a leaf) and the number of each leaf node, in the order of the tree."""

    def __init__(self, rows: np.ndarray, branch: int, leaf_rows: int, seed: int = 10) -> None:
        rng = np.random.default_rng(seed)
        self.children: list[list[int]] = []
        centres: list[np.ndarray] = []

        def grow(part: np.ndarray) -> int:
            node = len(centres)
            centres.append(part.mean(axis=0))
            self.children.append([])
            if len(part) > leaf_rows:
                found = _clusters(part, branch, rng)
                if len(found) > 1:
                    self.children[node] = [grow(p) for p in found]
            return node

        grow(rows)
        self.centres = np.array(centres, np.float32)
        self._number()

    def _number(self) -> None:
        self.leaf_of: dict[int, int] = {}
        todo = [0]
        while todo:
            node = todo.pop()
            if not self.children[node]:
                self.leaf_of[node] = len(self.leaf_of)
            todo += reversed(self.children[node])
        self.leaves = len(self.leaf_of)

    def graft(self, parts: dict[int, Tree]) -> None:
        """The leaf of each number becomes the root of its part; leaves are numbered anew."""
        centres, held = [self.centres], len(self.centres)
        for node, leaf in list(self.leaf_of.items()):
            if leaf in parts:
                part, shift = parts[leaf], held - 1
                moved = [[kid + shift for kid in kids] for kids in part.children]
                self.children[node] = moved[0]
                self.children += moved[1:]
                centres.append(part.centres[1:])
                held += len(part.centres) - 1
        self.centres = np.concatenate(centres)
        self._number()

    def assign(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int32)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            kids = self.children[node]
            if not kids:
                out[at] = self.leaf_of[node]
            elif len(at):
                best = _distances(rows[at], self.centres[kids].astype(np.float64)).argmin(axis=1)
                todo += [(kid, at[best == k]) for k, kid in enumerate(kids)]
        return out

    def visits(self, row: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while self.children[node]:
                kids = self.children[node]
                far = ((self.centres[kids] - row) ** 2).sum(axis=1).tolist()
                first, *rest = sorted(zip(far, kids, strict=True))
                for other in rest:
                    heapq.heappush(queue, other)
                node = first[1]
            yield self.leaf_of[node]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b**2).sum(axis=1) - 2 * a @ b.T


def _clusters(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> list[np.ndarray]:
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    best = np.zeros(len(rows), int)
    for _ in range(rounds):
        now = _distances(rows, centres).argmin(axis=1)
        if (now == best).all() and _:
            break
        best = now
        centres = np.array([rows[best == j].mean(axis=0) if (best == j).any() else centres[j] for j in range(len(centres))])
    return [rows[best == j] for j in range(len(centres)) if (best == j).any()]


def _nearest(ids: np.ndarray, rows: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest ids with distances, ties by id."""
    d = np.sqrt(((rows - query) ** 2).sum(axis=1))
    ok = ids != own
    d, ids = d[ok], ids[ok]
    if len(d) > k:
        near = d <= np.partition(d, k - 1)[k - 1]
        d, ids = d[near], ids[near]
    order = np.lexsort((ids, d))[:k]
    return ids[order], d[order]


_OUT = "query_id long, vec_id long, score double"


def _found(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    return pa.table(
        {
            "query_id": pa.array(np.concatenate([np.full(len(i), q, np.int64) for q, i, _ in parts]) if parts else [], pa.int64()),
            "vec_id": pa.array(np.concatenate([i for _, i, _ in parts]) if parts else [], pa.int64()),
            "score": pa.array(np.concatenate([d for _, _, d in parts]) if parts else [], pa.float64()),
        }
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scan(rows: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """The true neighbours of a bounded list of queries, by a scan of all (id, v, leaf)."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vectors = b.column("id").to_numpy(), _matrix(b.column("v"))
            for start in range(0, len(ids), 8192):
                part = slice(start, start + 8192)
                yield from _found([(q, *_nearest(ids[part], vectors[part], x, q, k)) for q, x in shared.value]).to_batches()

    return _best(rows.select("id", "v").mapInArrow(run, _OUT), k)


def _drawn(rows: DataFrame, seed: str) -> Column:
    """A number from 0 to 1 by a hash of the id."""
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _assigned(rows: DataFrame, tree: Tree) -> DataFrame:
    """rows with the number of their leaf."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("leaf", pa.array(shared.value.assign(_matrix(b.column("v"))), pa.int32()))

    return rows.mapInArrow(run, rows.select("*", F.lit(0).alias("leaf")).schema)


def _counts(rows: DataFrame, column: str, many: int) -> np.ndarray:
    """Rows by a number below many: at most as many rows in the driver."""
    out = np.zeros(many, np.int64)
    found = rows.groupBy(column).count().toArrow()
    out[found.column(column).to_numpy()] = found.column("count").to_numpy()
    return out


def fit(rows: DataFrame, n: int, sample_rows: int = 8192, branch: int = 8, cell_rows: int = 256, leaf_rows: int = 64) -> Tree:
    """The tree of n rows (id, v), all of one length: its top from a sample of all, below each cell from a sample of the cell."""
    sample = rows.where(_drawn(rows, "tree") <= min(1.0, sample_rows / n)).select("id", "v").toArrow().sort_by("id")
    if not len(sample):
        sample = rows.select("id", "v").orderBy("id").limit(sample_rows).toArrow()
    tree = Tree(_matrix(sample.column("v")), branch, cell_rows)
    cells = _assigned(rows.select("id", "v"), tree)
    counts = _counts(cells, "leaf", tree.leaves)
    share = _table(rows, leaf=np.arange(tree.leaves, dtype=np.int32), share=sample_rows / np.maximum(counts, 1))
    drawn = cells.join(F.broadcast(share), "leaf").where(_drawn(rows, "cell") <= F.col("share")).select("leaf", "id", "v")

    def part(key: tuple, held: pa.Table) -> pa.Table:
        grown = Tree(_matrix(held.sort_by("id").column("v")), branch, leaf_rows)
        return pa.table({"leaf": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([pickle.dumps(grown)], pa.binary())})

    parts = drawn.groupBy("leaf").applyInArrow(part, "leaf int, part binary").toArrow()
    tree.graft({leaf: pickle.loads(grown) for leaf, grown in zip(parts.column("leaf").to_pylist(), parts.column("part").to_pylist(), strict=True)})
    return tree


def _table(like: DataFrame, **columns: np.ndarray) -> DataFrame:
    """A small table of numbers, one row a leaf or bin."""
    return like.sparkSession.createDataFrame(pa.table({c: pa.array(x) for c, x in columns.items()}))


def _bins(counts: np.ndarray, block_rows: int) -> np.ndarray:
    """The bin of every leaf: neighbouring leaves of about block_rows rows together, a leaf with more by itself."""
    out, bin_, held = np.zeros(len(counts), np.int32), 0, 0
    for leaf, n in enumerate(counts.tolist()):
        if held and held + n > block_rows:
            bin_, held = bin_ + 1, 0
        out[leaf], held = bin_, held + n
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.97, sample_rows: int = 8192, branch: int = 8, cell_rows: int = 256, leaf_rows: int = 64, calibration: int = 256, block_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score, query_row): the k nearest found of every query row. is_query is a condition on the id column."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("name"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.groupBy("name", "v").agg(F.max("q").alias("q")).withColumn("_h", F.xxhash64("v"))
    rows = scratch.keep(rows.repartitionByRange("name", "_h").sortWithinPartitions("name", "_h").drop("_h").withColumn("id", F.monotonically_increasing_id()), "rows")
    names = rows.select("id", "name")
    shapes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).orderBy(F.desc("n"), "d").first()
    if shapes is None or not shapes.q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_row long")
    rows = rows.where(F.size("v") == shapes.d).select("id", "v", "q")
    fitted = fit(rows, shapes.n, sample_rows, branch, cell_rows, leaf_rows)
    tree = spark.sparkContext.broadcast(fitted)
    placed = scratch.keep(_assigned(rows, fitted), "placed")
    counts = _counts(placed, "leaf", fitted.leaves)

    some = placed.where("q").where(_drawn(placed, "tree") <= min(1.0, calibration / shapes.q)).select("id", "v", "leaf").limit(2 * calibration).toArrow()
    known = [(i, v) for i, v in zip(some.column("id").to_pylist(), _matrix(some.column("v")), strict=True)]
    visits = fitted.leaves
    if known:
        truth: dict[int, list[int]] = {}
        for x in scan(placed, known, k).join(placed.select(F.col("id").alias("vec_id"), "leaf"), "vec_id").select("query_id", "leaf").collect():
            truth.setdefault(x.query_id, []).append(x.leaf)
        needed = []
        for i, v in known:
            left = truth.get(i, [])
            for n, leaf in enumerate(fitted.visits(v), 1):
                if not left:
                    break
                needed += [n] * left.count(leaf)
                left = [x for x in left if x != leaf]
        needed.sort()
        visits = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else 1
    bins = _bins(counts, block_rows)
    parts = np.maximum(1, -(-counts // block_rows))  # above 1 only where a leaf is a bin by itself
    plan = spark.sparkContext.broadcast((counts, bins, parts))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, bins, parts = plan.value
        for b in batches:
            at, to, blocks, leaves = [], [], [], []
            for n, row in enumerate(_matrix(b.column("v"))):
                held, found = 0, {}
                for seen, leaf in enumerate(tree.value.visits(row)):
                    if seen >= visits and held > k:
                        break
                    held += counts[leaf]
                    if counts[leaf]:
                        found.setdefault(int(bins[leaf]), []).append(leaf)
                for bin_, own in found.items():
                    for block in range(max(parts[leaf] for leaf in own)):
                        at.append(n)
                        to.append(bin_)
                        blocks.append(block)
                        leaves.append(sorted(own))
            taken = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column("id"), taken.column("v"), pa.array(to, pa.int32()), pa.array(blocks, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], names=["id", "v", "bin", "block", "leaves"])

    kind = placed.schema["v"].dataType.simpleString()
    asked = scratch.keep(placed.where("q").select("id", "v").mapInArrow(route, f"id long, v {kind}, bin int, block int, leaves array<int>"), "asked")
    # A bin that more queries visit than a task should hold meets them block by block.
    turns = -(-_counts(asked.where("block = 0"), "bin", int(bins[-1]) + 1) // block_rows)
    asked = asked.join(F.broadcast(_table(placed, bin=np.arange(len(turns), dtype=np.int32), turns=turns)), "bin").withColumn("turn", F.pmod(F.xxhash64("id"), F.col("turns")))
    of_leaf = _table(placed, leaf=np.arange(len(bins), dtype=np.int32), bin=bins, parts=parts, turns=turns[bins])
    held = placed.select("id", "v", "leaf").join(F.broadcast(of_leaf), "leaf").where("turns > 0")
    held = held.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.col("parts")).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return _found([])
        b = b.sort_by("leaf")
        ids, own, leaf = b.column("id").to_numpy(), _matrix(b.column("v")), b.column("leaf").to_numpy()
        found = []
        for q, x, leaves in zip(a.column("id").to_pylist(), _matrix(a.column("v")), a.column("leaves").to_pylist(), strict=True):
            starts, ends = np.searchsorted(leaf, leaves), np.searchsorted(leaf, leaves, "right")
            at = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends, strict=True)])
            found.append((q, *_nearest(ids[at], own[at], x, q, k)))
        return _found(found)

    keys = ["bin", "block", "turn"]
    asked, held = asked.select("id", "v", "leaves", *keys[:2], F.col("turn").cast("int").alias("turn")), held.select("id", "v", "leaf", *keys[:2], F.col("turn").cast("int").alias("turn"))
    best = _best(asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(meet, _OUT), k)
    best = best.join(names.withColumnsRenamed({"id": "query_id", "name": "_query"}), "query_id").join(names.withColumnsRenamed({"id": "vec_id", "name": "_found"}), "vec_id")
    return best.select(F.col("_query").alias("query_id"), "rank", F.col("_found").alias("vec_id"), "score", F.col("query_id").alias("query_row"))
