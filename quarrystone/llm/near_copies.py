"""Near copies by the Jaccard similarity of word shingles.

1. A text's 64-bit shingle hashes give its SimHash; their set is reduced to BANDS * ROWS
   minima under random permutations; each band of minima is hashed to a key, and the low
   byte of every minimum goes into a sketch (Arrow batches). Equal texts collapse to one
   node before anything is compared.
2. Fingerprints meet in the popcount grid of ``simhash``; nodes of one fingerprint, and of
   two within 2 bits, are compared first. The grid finds most close copies, but about
   0.2 % of pairs at a similarity of 0.8, whose fingerprints differ in 9.7 bits on average;
   what follows finds the rest.
3. Nodes that share the key of a band may be near copies. A pair of similarity s shares
   no key with odds of (1 - s ** ROWS) ** BANDS: 3.0e-6 at 0.8. They are compared in three
   turns, each only where the links found so far leave two nodes apart: every node with
   the least node that it meets in any band; with the least of each band; with all others
   of its bands. So a group of thousands of near copies is linked by the first turns, in
   proportion to its size, and the last makes the result complete.
4. Pairs of a band whose sketches agree too little are no near copies (odds of 4e-6 that
   one at the threshold is lost). Whether the others, and all pairs of the grid, are is
   computed on their whole shingle sets: the sets of a pair meet in two joins; in the last
   turn those members of a bucket that are like another one by their sketches come
   together, and every pair is compared in the first band that it shares.
5. After each turn the links' connected components are found anew.

No bucket is gathered whole: in the last turn it is dealt into blocks of bounded size,
and a task holds two of them. A turn writes rows in proportion to the members of buckets,
never a row for each pair. Shuffles hold keys, sketches, and the sets of likely near
copies. Text is joined only with the nodes that meet another one.

Defined cases: texts with fewer words than a shingle are one shingle; texts without a
word (null, empty, blank) are copies of each other; a null id counts as the largest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Scratch, as_column, beside
from .components import components

BANDS, ROWS = 32, 5


def shingles(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """The sorted set of 64-bit hashes of a UTF-8 text's word shingles."""
    return np.unique(simhash.shingle_hashes(text, shingle))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
    return drawn[0], drawn[1] | np.uint64(1)


def minima(of: np.ndarray, permutations: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least hash of a set under every permutation."""
    flip, times = (p[:, None] for p in permutations)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(of), 512):  # so many rows fit a processor's cache
        np.minimum(least, ((of[at : at + 512] ^ flip) * times).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """The signed key of every band of minima."""
    raw = least.tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[8 * ROWS * k : 8 * ROWS * (k + 1)], k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets without repeats; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def text_hash(text: Column) -> Column:
    """The node of a text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _keys(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, node, fp, keys, sketch) for each row: fp is the SimHash, a sketch is the minima's low bytes and then the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutations = _permutations()
        for b in batches:
            fps, least = [], []
            for t in b.column(2):
                hashes = simhash.shingle_hashes(t.as_py(), shingle)
                fps.append(simhash.fingerprint(hashes))
                least.append(minima(np.unique(hashes), permutations))
            keys = pa.array(map(band_keys, least), pa.list_(pa.int64()))
            sketches = [x.astype(np.uint8).tobytes() + k.values.to_numpy().tobytes() for x, k in zip(least, keys, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64()), keys, pa.array(sketches, pa.binary())], names=["id", "node", "fp", "keys", "sketch"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, node long, fp long, keys array<long>, sketch binary")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, text in zip(b.column(0), b.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], pa.int64()), pa.array([shingles(text.as_py(), shingle).view(np.int64)], pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


def least_agreement(least: float) -> int:
    """Of a pair at the threshold, how many of the bytes agree but for five standard deviations."""
    n = BANDS * ROWS
    return int(n * least - 5 * (n * least * (1 - least)) ** 0.5)


def _matrix(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the keys of sketches, one row each."""
    raw = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, BANDS * (ROWS + 8))
    return raw[:, : BANDS * ROWS], np.ascontiguousarray(raw[:, BANDS * ROWS :]).view(np.int64)


def grid_pairs(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v), u > v: of nodes with fingerprints (node, fp), each with the least of its fingerprint, and the least ones of fingerprints that the popcount grid and its check link."""
    first = scratch.keep(keyed.groupBy("fp").agg(F.min("node").alias("first"), F.max("node").alias("last")).withColumn("cell", simhash.popcount_cell(F.col("fp"))), "fingerprints")
    same = keyed.join(first.where("first <> last").select("fp", "first").hint("merge"), "fp").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    a, b = (first.select(F.col("fp").alias(c), F.col("first").alias(f"of_{c}")).hint("merge") for c in "uv")
    linked = simhash.links(first.select("fp", "cell"), scratch).join(a, "u").join(b, "v").select(F.greatest("of_u", "of_v").alias("u"), F.least("of_u", "of_v").alias("v"))
    return same.union(linked).distinct()


def _alike(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sketches agree enough."""
    bound = least_agreement(least)
    met = pairs.join(sketches.select(F.col("node").alias("u"), F.col("sketch").alias("a")), "u").join(sketches.select(F.col("node").alias("v"), F.col("sketch").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = (_matrix(b.column(2).to_pylist())[0] == _matrix(b.column(3).to_pylist())[0]).sum(axis=1) >= bound
            yield b.select(["u", "v"]).filter(pa.array(good))

    return met.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _dealt(members: DataFrame, weight: Column, most: int) -> DataFrame:
    """members (p, band, node, root, sketch, …) with block numbers own, i, j: every two blocks of a bucket, of a weight of about ``most`` each, are a group (p, i, j), whole in a partition."""
    blocks = members.groupBy("p").agg(F.ceil(F.sum(weight) / most).cast("int").alias("blocks"))
    dealt = members.join(blocks, "p").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")
    return dealt.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each group (p, i, j) as they come by."""
    at, rows = None, []
    for b in batches:
        for k, row in enumerate(b.drop_columns(["shingles"]).to_pylist() if "shingles" in b.schema.names else b.to_pylist()):
            if "shingles" in b.schema.names:
                row["set"] = b.column("shingles")[k].values.to_numpy().copy()
            if rows and (row["p"], row["i"], row["j"]) != at:
                yield rows
                rows = []
            at = row["p"], row["i"], row["j"]
            rows.append(row)
    if rows:
        yield rows


def _close(rows: list[dict], bound: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, others): pairs of a group's rows across its blocks and across roots, alike by their sketches, in the first band that they share."""
    own, root = (np.array([r[c] for r in rows], np.int64) for c in ("own", "root"))
    sketch, keys = _matrix([r["sketch"] for r in rows])
    roots, n = np.unique(root, return_counts=True)
    rest = np.flatnonzero(root != roots[n.argmax()])  # no pair lies within the largest component
    todo = np.ones(len(rows), bool)
    for k in rest.tolist():
        todo[k] = False
        apart = todo & (root != root[k])
        if rows[k]["i"] != rows[k]["j"]:
            apart &= own != own[k]
        others = np.flatnonzero(apart)
        others = others[(sketch[others] == sketch[k]).sum(axis=1) >= bound]
        yield k, others[(keys[others] == keys[k]).argmax(axis=1) == rows[k]["band"]]


def _like_another(members: DataFrame, least: float, block: int) -> DataFrame:
    """(p, band, node, root) of the members that are in a pair of _close()."""
    bound = least_agreement(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            found: set[int] = set()
            for k, others in _close(rows, bound):
                if len(others):
                    found.update([k, *others.tolist()])
            if found:
                yield pa.RecordBatch.from_pydict({c: pa.array([rows[k][c] for k in sorted(found)], t) for c, t in (("p", pa.int64()), ("band", pa.int32()), ("node", pa.int64()), ("root", pa.int64()))})

    return _dealt(members, F.lit(1), block).mapInArrow(run, "p long, band int, node long, root long").distinct()


def _across(members: DataFrame, least: float, most: int) -> DataFrame:
    """(u, v), u > v: links of similar members (p, band, node, root, sketch, shingles) of one bucket, as few as join the same nodes. Blocks hold about ``most`` shingles."""
    bound = least_agreement(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            first: dict[int, int] = {r["root"]: r["root"] for r in rows}

            def find(n: int) -> int:
                while first[n] != n:
                    first[n] = n = first[first[n]]
                return n

            links = []
            for k, others in _close(rows, bound):
                for o in others.tolist():
                    a, b = find(rows[k]["root"]), find(rows[o]["root"])
                    if a != b and similarity(rows[k]["set"], rows[o]["set"]) >= least:
                        first[max(a, b)] = min(a, b)
                        links.append((max(rows[k]["node"], rows[o]["node"]), min(rows[k]["node"], rows[o]["node"])))
            if links:
                yield pa.RecordBatch.from_pydict({c: pa.array([x[i] for x in links], pa.int64()) for i, c in enumerate("uv")})

    return _dealt(members, F.size("shingles") + 1, most).mapInArrow(run, "u long, v long").distinct()


def _links(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough; two empty ones are equal."""
    met = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")).hint("merge"), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")).hint("merge"), "v")
    met = met.select("u", "v", F.size("a").alias("m"), F.size("b").alias("n"), as_column(F.size(F.array_intersect("a", "b"))).alias("both"))
    return met.where(F.col("both") >= F.lit(least) * (F.col("m") + F.col("n") - F.col("both"))).select("u", "v")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, block: int = 4096, block_shingles: int = 1 << 21) -> DataFrame:
    """(id, node, copies, root, component_id) for each distinct pair of id and text: copies counts its rows, root tells components apart, component_id is the smallest id in one."""
    scratch = Scratch(docs.sparkSession, "near-copies")
    rows = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("node"), F.col(text_col).cast("binary").alias("text"))
    keyed = scratch.keep(_keys(rows, shingle), "keys")
    points = keyed.select("node", F.posexplode("keys").alias("band", "p"))
    shared = points.groupBy("p").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("p", "least")
    met = scratch.keep(points.join(shared.hint("merge"), "p").groupBy("p", "band", "node").agg(F.min("least").alias("least")), "met")
    grid = scratch.keep(grid_pairs(keyed.select("node", "fp"), scratch), "pairs-grid")
    nodes = scratch.keep(met.select("node").union(grid.select(F.explode(F.array("u", "v")))).distinct(), "nodes")
    near = beside(nodes)
    sketches = scratch.keep(keyed.select("node", "sketch").join(near, "node", "left_semi").dropDuplicates(["node"]), "sketches")
    sets = scratch.keep(_sets(rows.select("node", "text").join(near, "node", "left_semi").dropDuplicates(["node"]), shingle), "sets")
    roots = nodes.select("node", F.col("node").alias("root"))
    tested = links = None
    for turn in range(4):
        placed = met.join(roots.hint("merge"), "node")
        if turn == 0:
            found = _links(grid, sets, least)
        elif turn < 3:
            own = roots.select(F.col("node").alias("least"), F.col("root").alias("least_root"))
            stars = placed.join(own.hint("merge"), "least").where("root <> least_root")
            pairs = stars.groupBy(F.col("node").alias("u")).agg(F.min("least").alias("v")) if turn == 1 else stars.select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()
            pairs = scratch.keep(_alike(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), sketches, least), f"pairs-{turn}")
            tested = pairs if tested is None else tested.union(pairs)
            found = _links(pairs, sets, least)
        else:
            mixed = placed.groupBy("p").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("p")
            members = placed.join(mixed.hint("merge"), "p", "left_semi").select("p", "band", "node", "root").join(sketches, "node")
            close = scratch.keep(_like_another(members, least, block), "close")
            found = _across(close.join(sketches, "node").join(sets, "node"), least, block_shingles)
        found = scratch.keep(found, f"links-{turn}")
        if found.isEmpty():
            continue
        links = found if links is None else links.union(found)
        linked = scratch.keep(components(links, Scratch(docs.sparkSession, f"near-copies-{turn}")), f"linked-{turn}").withColumnsRenamed({"node": "_node", "root": "_root"})
        roots = scratch.keep(nodes.join(linked.hint("merge"), F.col("node") == F.col("_node"), "left").select("node", F.coalesce("_root", "node").alias("root")), f"roots-{turn}")
    roots = roots.withColumnsRenamed({"node": "_node", "root": "_root"})
    ids = keyed.groupBy("id", "node").agg(F.count(F.lit(1)).alias("copies"))
    rooted = scratch.keep(ids.join(roots.hint("merge"), F.col("node") == F.col("_node"), "left").select("id", "node", "copies", F.coalesce("_root", "node").alias("root")), "rooted")
    return rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component_id")).hint("merge"), "root").select(F.col("id").alias(id_col), "node", "copies", "root", "component_id")
