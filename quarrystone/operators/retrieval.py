"""Sparse, dense and hybrid top-k retrieval as set-oriented plans: one job for all queries.

BM25 is an aggregation over (document, term) counts. Only the terms' document
frequencies see the whole vocabulary; scoring joins the postings of query terms.
Ranks are row_number windows with a limit, which Spark plans as a group limit before
the shuffle, and every tie goes to the lower index.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.window import Window

from quarrystone.functions.text import tokenize
from quarrystone.scratch import written

K1, B, FLOOR = 1.5, 0.75, 0.25


def top_k(scored: DataFrame, k: int, by: str = "q", score: str = "score", idx: str = "idx") -> DataFrame:
    """Adds rank from 1 and keeps the k best of each group, ties to the lower index."""
    order = Window.partitionBy(by).orderBy(F.desc(score), F.asc(idx))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def postings(docs: DataFrame, idx: str, text: str, tokens: Column | None = None) -> DataFrame:
    """(idx, term, tf)."""
    terms = F.explode(tokenize(F.col(text)) if tokens is None else tokens)
    return docs.select(F.col(idx).alias("idx"), terms.alias("term")).groupBy("idx", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_weights(post: DataFrame, totals: DataFrame) -> DataFrame:
    """(term, idf): negative weights are raised to a quarter of the mean."""
    return weights_of(post.groupBy("term").agg(F.count(F.lit(1)).alias("df")), totals)


def weights_of(held: DataFrame, totals: DataFrame) -> DataFrame:
    """(term, idf) from (term, df)."""
    raw = held.crossJoin(totals).select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))  # totals is one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(mean).select("term", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def term_counts(docs: DataFrame, idx: str, text: str) -> DataFrame:
    """(term, df, tf), written: the documents that hold a term, and how often they do. Rows of one idx are one document.

    Terms are counted where the texts lie, so a row for each term and task is shuffled, none for each document and term.
    """
    split = split_terms(docs, idx, tokenize(F.col(text)))
    again = written(split.groupBy("idx").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("idx").alias("_idx")), "repeated")
    terms, once = split.select("idx", F.explode("_terms").alias("term")), split
    if not again.isEmpty():
        same = F.col("idx").eqNullSafe(F.col("_idx"))
        once = split.join(again, same, "left_anti")
    held = once.select(F.explode(F.array_distinct("_terms")).alias("term"))
    if once is not split:
        held = held.union(terms.join(again, same, "left_semi").distinct().select("term"))
    counts = terms.select("term", F.lit(0).alias("d"), F.lit(1).alias("t")).union(held.select("term", F.lit(1), F.lit(0)))
    return written(counts.groupBy("term").agg(F.sum("d").alias("df"), F.sum("t").alias("tf")), "term-counts")


#: A table of query terms of at most so many rows is broadcast to the postings; a larger one is joined as the planner sees fit.
BROADCAST_ROWS = 500_000


def bm25_scores(docs: DataFrame, queries: DataFrame, idx: str = "idx", text: str = "text", q: str = "q", question: str = "question", tokens: Column | None = None, question_tokens: Column | None = None) -> DataFrame:
    """(q, idx, score) of all documents that share a term with the query; query terms count as often as they occur.

    The documents are tokenised once, into a written table that totals, document frequencies
    and postings read by column; only postings of query terms are shuffled.
    """
    return _scores(*_term_tables(docs, queries, idx, text, q, question, tokens, question_tokens))


def split_terms(docs: DataFrame, idx: str, terms: Column, carry: Sequence[str] = ()) -> DataFrame:
    """(idx, dl, _terms, carry), written: the length is computed below an explode of the terms, not again for every word."""
    return written(docs.select(F.col(idx).alias("idx"), terms.alias("_terms"), *carry).select("idx", F.size("_terms").alias("dl"), "_terms", *carry), "terms")


def _term_tables(docs: DataFrame, queries: DataFrame, idx: str, text: str, q: str, question: str, tokens: Column | None = None, question_tokens: Column | None = None, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(idx, dl, _terms, carry) and (q, term, qtf), both written."""
    terms = tokenize(F.col(text)) if tokens is None else tokens
    split = split_terms(docs, idx, terms, carry)
    asked = written(postings(queries, q, question, question_tokens).withColumnsRenamed({"idx": "q", "tf": "qtf"}), "asked")
    return split, asked


def _weights(split: DataFrame, asked: DataFrame) -> DataFrame:
    """(q, term, w, avgdl) of the query terms that documents hold."""
    totals = split.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("all_dl"))
    df = split.select(F.explode(F.array_distinct("_terms")).alias("term"))
    weights = term_weights(df, totals.select("n"))
    terms = asked.select("term").distinct()
    held = weights.join(F.broadcast(terms) if _few(asked) else terms, "term", "left_semi")
    return asked.join(held, "term").crossJoin(totals).select("q", "term", (F.col("qtf") * F.col("idf")).alias("w"), (F.col("all_dl") / F.col("n")).alias("avgdl"))  # totals is one row


def _few(asked: DataFrame) -> bool:
    return asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _scores(split: DataFrame, asked: DataFrame) -> DataFrame:
    small = _few(asked)

    def near(side: DataFrame) -> DataFrame:
        return F.broadcast(side) if small else side

    words = split.select("idx", "dl", F.explode("_terms").alias("term"))
    post = words.join(near(asked.select("term").distinct()), "term", "left_semi").groupBy("idx", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    return weigh(post.join(near(_weights(split, asked)), "term"))


#: A batch of documents is scored in parts of about so many terms: a worker's memory follows from it, not from the rows of a batch.
PART_TERMS = 1 << 18


def _parts(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of rows that hold about PART_TERMS terms."""
    ends = np.cumsum(lengths)
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PART_TERMS, "right")))
        yield start, stop
        start = stop


def _best_of_blocks(split: DataFrame, weights: pa.Table, k: int, within: str | None = None) -> DataFrame:
    """(q, idx, score): the k best documents for each query in each part of an Arrow batch of documents. A part's terms are counted where they are; nothing but its best leaves it.

    weights: a bounded table (q, term, w, avgdl), sent to every worker. With the name of a column of split, the k best documents of
    positive score for each query and value of it, which is a column of the result as well.
    """
    terms = weights["term"].combine_chunks().unique()
    of_term = pc.index_in(weights["term"], terms).to_numpy()
    order = np.argsort(of_term, kind="stable")
    names = weights["q"].combine_chunks().unique()
    asked_by = pc.index_in(weights["q"], names).to_numpy()[order]
    starts = np.searchsorted(of_term[order], np.arange(len(terms) + 1))
    shared = split.sparkSession.sparkContext.broadcast((terms, names, starts, asked_by, weights["w"].to_numpy()[order], weights["avgdl"][0].as_py()))
    carried = [within] if within else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, names, starts, asked_by, w, avgdl = shared.value
        for b in (whole.slice(i, j - i) for whole in batches for i, j in _parts(whole.column("_terms").value_lengths().fill_null(0).to_numpy())):
            n, lists = len(b), b.column("_terms")
            doc = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy())
            term = pc.fill_null(pc.index_in(lists.flatten(), terms), -1).to_numpy()
            held, tf = np.unique(doc[term >= 0] * len(terms) + term[term >= 0], return_counts=True)
            doc, term = held // len(terms), held % len(terms)
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * b.column("dl").fill_null(0).to_numpy()[doc] / avgdl))
            many = starts[term + 1] - starts[term]
            at = np.repeat(starts[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
            pairs, same = np.unique(asked_by[at] * n + np.repeat(doc, many), return_inverse=True)
            score = np.bincount(same, np.repeat(part, many) * w[at], len(pairs))
            score = np.sign(score) * np.floor(np.abs(score) * 1e6 + 0.5) / 1e6
            if within:
                pairs, score = pairs[score > 0], score[score > 0]
            q, doc = pairs // n, pairs % n
            group = q
            if within:
                kinds = b.column(within).dictionary_encode(null_encoding="encode")
                group = q * len(kinds.dictionary) + kinds.indices.to_numpy()[doc]
            place = np.argsort(pc.sort_indices(b.column("idx")).to_numpy())  # of each document in the order of idx
            best = np.lexsort((place[doc], -score, group))
            rank = np.arange(len(best)) - np.searchsorted(group[best], group[best])
            best = best[rank < k]
            own = pa.array(doc[best])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q[best])), *[b.column(c).take(own) for c in carried], b.column("idx").take(own), pa.array(score[best])], ["q", *carried, "idx", "score"])

    fields = [T.StructField("q", from_arrow_type(weights.schema.field("q").type)), *[T.StructField(c, split.schema[c].dataType) for c in (*carried, "idx")], T.StructField("score", T.DoubleType())]
    return split.mapInArrow(run, T.StructType(fields))


def posting_blocks(docs: DataFrame, idx: str, terms: Column) -> DataFrame:
    """(term, idx, dl, tf), the last three arrays of one length, written: the postings of a term in a part of an Arrow batch of documents, made where the texts lie. Of a null term, the lengths of all documents of the part."""
    rows = docs.select(F.col(idx).alias("idx"), terms.alias("_terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, j - i) for whole in batches for i, j in _parts(whole.column("_terms").value_lengths().fill_null(0).to_numpy())):
            lists = b.column("_terms")
            dl = lists.value_lengths().fill_null(0).to_numpy()
            names = lists.flatten().dictionary_encode()
            held, tf = np.unique(names.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(b) + np.repeat(np.arange(len(b)), dl), return_counts=True)
            doc = np.concatenate((held % len(b), np.arange(len(b))))
            starts = np.append(np.searchsorted(held // len(b), np.arange(len(names.dictionary) + 1)), len(doc)).astype(np.int32)
            columns = b.column("idx").take(pa.array(doc)), pa.array(dl[doc], pa.int32()), pa.array(np.concatenate((tf, dl)), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([names.dictionary, pa.nulls(1, names.dictionary.type)]), *[pa.ListArray.from_arrays(starts, c) for c in columns]], ["term", "idx", "dl", "tf"])

    return written(rows.mapInArrow(run, f"term string, idx array<{rows.schema['idx'].dataType.simpleString()}>, dl array<int>, tf array<long>"), "blocks")


def best_of_postings(post: DataFrame, asked: DataFrame, weights: DataFrame, k: int) -> DataFrame | None:
    """(q, idx, score): for each query the k best documents of each part of them, and more, from postings (idx, dl, term, tf), the query terms (q, term, qtf) and (q, term, w, avgdl), or None if these are many.

    The postings of query terms come together by document, 64-bit hashes for terms, and are scored as in bm25_search: no row for each query and document is shuffled.
    """
    if not _few(asked):
        return None
    weights = weights.withColumn("term", F.xxhash64("term")).toArrow()
    if not len(weights):
        return None
    held = post.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").select("idx", "dl", F.xxhash64("term").alias("term"), F.col("tf").cast("int").alias("tf"))
    terms = F.flatten(F.collect_list(F.array_repeat("term", F.col("tf")))).alias("_terms")
    return _best_of_blocks(held.repartition("idx", "dl").groupBy("idx", "dl").agg(terms), weights, k)


def weigh(met: DataFrame) -> DataFrame:
    """(q, idx, score) from postings (idx, dl, term, tf) joined with their weights (q, term, w, avgdl)."""
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return met.groupBy("q", "idx").agg(F.round(F.sum(part), 6).alias("score"))


def _hashed(terms: Column) -> Column:
    return F.transform(terms, lambda t: F.xxhash64(t))


def bm25_search(docs: DataFrame, queries: DataFrame, k: int = 5, idx: str = "idx", text: str = "text", q: str = "q", question: str = "question", **tokens: Column) -> DataFrame:
    """(q, idx, score, rank): the k best documents; where fewer match, those of score 0 with the lowest indices follow.

    Terms are known by hashes of 64 bits. Where the query terms are counted to be few, batches of documents are scored where they lie and send their k best of each query, so the only shuffle above the
    texts is that of these. Else scores are sums over postings, joined and grouped.
    """
    own = _hashed(tokens.get("tokens", tokenize(F.col(text)))), _hashed(tokens.get("question_tokens", tokenize(F.col(question))))
    split, asked = _term_tables(docs, queries, idx, text, q, question, *own)
    lowest = written(split.orderBy("idx").limit(k), "lowest")
    # Which of the few lowest documents match is read from their own terms, so scoring stands in the plan once.
    matched = lowest.select("idx", F.explode(F.array_distinct("_terms")).alias("term")).join(asked.select("q", "term"), "term").select("q", "idx").distinct()
    fill = queries.select(F.col(q).alias("q")).crossJoin(lowest.select("idx")).join(matched, ["q", "idx"], "left_anti").select("q", "idx", F.lit(0.0).alias("score"))
    if not _few(asked):
        return top_k(_scores(split, asked).unionByName(fill), k)
    weights = _weights(split, asked).toArrow()
    return top_k((_best_of_blocks(split, weights, k) if len(weights) else _scores(split, asked)).unionByName(fill), k)


def bm25_search_within(docs: DataFrame, queries: DataFrame, within: str, k: int = 5, idx: str = "idx", text: str = "text", q: str = "q", question: str = "question") -> DataFrame:
    """(q, within, idx, score, rank): the k best documents of positive score for each query and value of a column of docs, found as in bm25_search."""
    split, asked = _term_tables(docs, queries, idx, text, q, question, _hashed(tokenize(F.col(text))), _hashed(tokenize(F.col(question))), [within])
    found = None
    if _few(asked):
        weights = _weights(split, asked).toArrow()
        found = _best_of_blocks(split, weights, k, within) if len(weights) else None
    if found is None:
        found = _scores(split, asked).where("score > 0").join(split.select("idx", within), "idx").select("q", within, "idx", "score")
    rank = F.row_number().over(Window.partitionBy("q", within).orderBy(F.desc("score"), "idx"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _scores_of(kind: str, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """A row of scores for each vector asked: larger is nearer, distances count negative; a zero vector has a cosine of 0. Rounded to six places, halves away from 0."""
    if kind in ("cosine", "dot"):
        out = asked @ rows.T
        if kind == "cosine":
            norms = np.sqrt((asked**2).sum(axis=1))[:, None] * np.sqrt((rows**2).sum(axis=1))
            out = np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)
    elif kind == "euclid":
        out = np.array([-np.sqrt(((rows - x) ** 2).sum(axis=1)) for x in asked])
    else:
        out = np.array([-np.abs(rows - x).sum(axis=1) for x in asked])
    return np.sign(out) * np.floor(np.abs(out) * 1e6 + 0.5) / 1e6


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = 5, kind: str = "cosine", idx: str = "idx", vector: str = "v", q: str = "q", block_rows: int = 8192, block_queries: int = 1024) -> DataFrame:
    """(q, idx, score, rank): the k nearest vectors of every query, by an exact scan in blocks.

    Both sides are dealt into blocks; two meet as matrices in an Arrow group, and only the k best of a block leave it.
    Vectors that are null or hold a null take no part; only vectors of one length are compared.
    """
    if kind not in ("cosine", "dot", "euclid", "manhattan"):
        raise ValueError(f"no similarity is named {kind}")
    whole = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull())
    rows = vectors.where(whole).select(F.col(idx).alias("idx"), F.col(vector).alias("v"), F.size(vector).alias("d"))
    asked = queries.where(whole).select(F.col(q).alias("q"), F.col(vector).alias("v"), F.size(vector).alias("d"))
    many, several = (max(1, -(-t.count() // most)) for t, most in ((rows, block_rows), (asked, block_queries)))

    def dealt(t: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return t.withColumn(own, F.pmod(F.xxhash64(t.columns[0], "v"), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def matrix(t: pa.Table) -> np.ndarray:
        return t.column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(t), -1)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([a.schema.field("q"), b.schema.field("idx"), pa.field("score", pa.float64())])
        if not len(a) or not len(b):
            return schema.empty_table()
        b = b.sort_by("idx")
        scores = _scores_of(kind, matrix(b), matrix(a))
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return pa.Table.from_arrays([a.column("q").take(pa.array(np.repeat(np.arange(len(a)), best.shape[1]))), b.column("idx").take(pa.array(best.ravel())), pa.array(np.take_along_axis(scores, best, 1).ravel())], schema=schema)

    keys = ["d", "qb", "b"]
    types = f"q {asked.schema['q'].dataType.simpleString()}, idx {rows.schema['idx'].dataType.simpleString()}, score double"
    met = dealt(asked, "qb", several, "b", many).groupBy(*keys).cogroup(dealt(rows, "b", many, "qb", several).groupBy(*keys))
    return top_k(met.applyInArrow(meet, types), k)


#: A text is looked for in another by at most so many of its first bytes, which fit a 64-bit integer.
ANCHOR = 8
#: Windows are looked up in a table of 2 ** FLAG_BITS bits (2 MB), of which those of keys are set.
FLAG_BITS = 24
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with eight more behind them, and where each text begins; at last where the last one ends."""
    whole = texts.cast(pa.large_binary())
    at = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, 8 * whole.offset)
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return np.concatenate((data, np.zeros(8, np.uint8))), at - at[0]


def _windows(data: np.ndarray, n: int | np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Hashes of the n bytes that begin at each place of data, or at those given, but for the last eight places."""
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    return (np.ndarray(len(data) - 8, "<u8", data, strides=(1,))[at] & masks[n]) * _MIX


def _first_window(key: Column, anchor: int) -> Column:
    @F.arrow_udf(T.LongType())
    def run(keys: pa.Array) -> pa.Array:
        data, at = _bytes_of(keys)
        data = np.append(data, np.uint8(0))  # an empty key can stand last
        return pa.array(_windows(data, np.minimum(np.diff(at), anchor), at[:-1]).view(np.int64))

    return run(key)


def _flags(windows: DataFrame) -> np.ndarray:
    """2 ** FLAG_BITS bits in bytes: those at the first bits of each _w are set."""
    place = F.shiftrightunsigned("_w", 64 - FLAG_BITS) + 1
    flags = np.zeros((1 << FLAG_BITS - 15, 4096), np.uint8)
    for part, bits in windows.groupBy(F.bitmap_bucket_number(place)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place))).collect():  # at most 512 parts of 4 KB
        flags[part - 1] = np.frombuffer(bits, np.uint8)
    return flags.ravel()


def _flagged(flags: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Places of the windows whose bit is set."""
    place = windows >> np.uint64(64 - FLAG_BITS)
    return np.flatnonzero(flags[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)


def _windows_met(texts: DataFrame, text: str, asked: DataFrame, key: str, carry: Sequence[str]) -> DataFrame:
    """(carry, _w): the distinct windows of each text that are in asked (key, _n, _w), and a few more; found in parts of an Arrow batch of texts, where these lie.

    Places where no key's shortest window begins are left at once, the others are tried with each length.
    """
    lengths = [r[0] for r in asked.select("_n").distinct().collect()]  # at most ANCHOR of them
    shortest = min(lengths, default=ANCHOR)
    begin = asked.select(_first_window(F.col(key), shortest).alias("_w"))
    shared = texts.sparkSession.sparkContext.broadcast((_flags(begin), _flags(asked)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, whole_windows = shared.value
        for b in (whole.slice(i, j - i) for whole in batches for i, j in _parts(pc.binary_length(whole.column(text)).fill_null(0).to_numpy())):
            data, at = _bytes_of(b.column(text))
            row, held = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for start in range(0, len(data) - 8, PART_TERMS):
                part = data[start : start + PART_TERMS + 8]
                begun = _flagged(begin, _windows(part, shortest))
                of = np.searchsorted(at, start + begun, "right") - 1
                left = at[of + 1] - start - begun
                for n in lengths:
                    w = _windows(part, n, begun)
                    hit = _flagged(whole_windows, w)
                    hit = hit[left[hit] >= n]
                    row.append(of[hit])
                    held.append(w[hit])
            rows, windows = np.concatenate(row), np.concatenate(held)
            order = np.lexsort((windows, rows))
            rows, windows = rows[order], windows[order]
            first = np.append(True, (rows[1:] != rows[:-1]) | (windows[1:] != windows[:-1]))[: len(rows)]
            own, starts = np.unique(rows[first], return_index=True)
            lists = pa.ListArray.from_arrays(np.append(starts, first.sum()).astype(np.int32), pa.array(windows[first].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(own)) for c in carry], lists], [*carry, "_ws"])

    met = texts.mapInArrow(run, T.StructType([*[texts.schema[c] for c in carry], T.StructField("_ws", T.ArrayType(T.LongType()))]))
    return met.select(*carry, F.explode("_ws").alias("_w"))


def substring_join(texts: DataFrame, keys: DataFrame, text: str, key: str, on: Sequence[str] = (), anchor: int = ANCHOR) -> DataFrame:
    """Pairs of rows of texts and keys, equal in ``on``, whose text holds the key, character by character; keys that are null or empty are in none.

    A key is looked up by its first bytes, at most ``anchor`` (and 8): every window of that length in a text is tried in a table of bits where the text lies, those
    found join the keys by a hash, and what has met is compared whole. Only windows of the lengths that keys have are made. Few keys are broadcast, so that
    nothing is shuffled; with more, only the windows found are, without their text. Columns other than ``on`` should differ in name.
    """
    anchor = min(anchor, ANCHOR)
    asked = keys.where(F.length(key) > 0).withColumn("_n", F.least(F.octet_length(key), F.lit(anchor)))
    asked = written(asked.withColumn("_w", _first_window(F.col(key), anchor)), "keys")
    if _few(asked):
        met = _windows_met(texts, text, asked, key, texts.columns).join(F.broadcast(asked), [*on, "_w"])
        return met.where(F.contains(text, key)).drop("_n", "_w")
    each = written(texts.withColumn("_t", F.monotonically_increasing_id()), "texts")
    pairs = _windows_met(each.select("_t", *on, text), text, asked, key, ["_t", *on]).join(asked, [*on, "_w"]).drop("_w", "_n", *on)
    return pairs.join(each, "_t").where(F.contains(text, key)).drop("_t")


def holding(docs: DataFrame, passages: DataFrame, idx: str = "idx", text: str = "text", q: str = "q", passage: str = "question") -> DataFrame:
    """(q, idx) of every document whose text holds the passage, character by character.

    The words of a passage but for its first and last are words of such a text, in the same order: the two join on the
    first three of them, and what they join is compared whole. Passages of fewer than five words are joined by windows of characters; an empty one is in every text.
    """
    split = r"[\x20\x09-\x0D]+"
    texts = docs.select(F.col(idx).alias("idx"), F.col(text).alias("text"))
    asked = passages.select(F.col(q).alias("q"), F.col(passage).alias("passage")).withColumn("words", F.split("passage", split))
    keyed = asked.where(F.size("words") >= 5).select("q", "passage", F.xxhash64(*[F.get("words", F.lit(k)) for k in (1, 2, 3)]).alias("key"))
    words = texts.select("idx", F.split("text", split).alias("words")).where(F.size("words") >= 3)
    keys = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda k: F.xxhash64(F.get("words", k), F.get("words", k + 1), F.get("words", k + 2)))
    met = words.select("idx", F.explode(F.array_distinct(keys)).alias("key")).join(keyed, "key").select("q", "idx", "passage")
    found = met.join(texts, "idx").where(F.contains("text", "passage")).select("q", "idx")
    few = asked.where(F.size("words") < 5).select("q", "passage")
    if few.isEmpty():
        return found.distinct()
    anywhere = few.where("passage = ''").agg(F.collect_list("q").alias("qs"))  # one row
    everywhere = texts.where("text IS NOT NULL").crossJoin(anywhere).select(F.explode("qs").alias("q"), "idx")
    return found.union(substring_join(texts, few, "text", "passage").select("q", "idx")).union(everywhere).distinct()


def min_max(scores: DataFrame, constant: str = "one", by: str = "q") -> DataFrame:
    """Scores from 0 to 1 within each query. A constant list becomes 1, or with constant="sign" 1 where positive and else 0."""
    whole = Window.partitionBy(by)
    low, high = F.min("score").over(whole), F.max("score").over(whole)
    flat = F.lit(1.0) if constant == "one" else F.when(F.col("score") > 0, 1.0).otherwise(0.0)
    return scores.withColumn("norm", F.when(low == high, flat).otherwise((F.col("score") - low) / (high - low)))


def fuse(dense: DataFrame, sparse: DataFrame, k: int = 5, dense_weight: float = 0.6, sparse_weight: float = 0.4, constant: str = "one") -> DataFrame:
    """(q, idx, score, rank): weighted sums of normalised scores over the union of candidates, missing ones 0."""
    d = min_max(dense, constant).select("q", "idx", F.col("norm").alias("dense"))
    s = min_max(sparse, constant).select("q", "idx", F.col("norm").alias("sparse"))
    both = d.join(s, ["q", "idx"], "full")
    score = F.round(dense_weight * F.coalesce("dense", F.lit(0.0)) + sparse_weight * F.coalesce("sparse", F.lit(0.0)), 6)
    return top_k(both.select("q", "idx", score.alias("score")), k)


def with_threshold(found: DataFrame, queries: DataFrame, least: float = 0.7, q: str = "q") -> DataFrame:
    """Results of at least the threshold; a query without any keeps one row of nulls."""
    good = found.where(F.col("score") >= least)
    none = queries.select(F.col(q).alias("q")).join(good.select("q").distinct(), "q", "left_anti")
    return good.unionByName(none, allowMissingColumns=True)


# --- similarity of two short texts ------------------------------------------------------------------------------

TERM = r"\b\w\w+\b"


def text_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?U){TERM}"), F.lit(0))


def pair_similarity(ta: Column, tb: Column) -> Column:
    """Cosine of the TF-IDF vectors fitted on just two texts, given as columns of their terms: a shared term weighs 1, another 1 + ln 1.5. Null where neither has a term."""
    apart = 1 + F.log(F.lit(1.5))

    def times(terms: Column, x: Column) -> Column:
        return F.size(F.filter(terms, lambda y: y == x)).cast("double")

    def square(own: Column, other: Column) -> Column:
        return F.aggregate(F.array_distinct(own), F.lit(0.0), lambda s, x: s + F.pow(times(own, x) * F.when(F.array_contains(other, x), 1.0).otherwise(apart), F.lit(2.0)))

    shared = F.aggregate(F.array_intersect(ta, tb), F.lit(0.0), lambda s, x: s + times(ta, x) * times(tb, x))
    norms = F.sqrt(square(ta, tb)) * F.sqrt(square(tb, ta))
    return F.when((F.size(ta) > 0) | (F.size(tb) > 0), F.when(norms > 0, shared / norms).otherwise(0.0))


def prefix_terms(terms: Column, ordered: Column, least: float) -> Column:
    """The first of a text's distinct terms, in the order given, of which two texts more similar than least share one, if both sides use one order.

    If a pair's similarity is above least, the squared counts of the terms that it does not share are below a
    share r / (1 + r) of all, r = (1 - least ** 2) / (least ** 2 * w), w the square of an unshared term's weight. So
    the first shared term stands within the first terms whose squared counts reach that share, on both sides.
    """
    apart = (1 + log(1.5)) ** 2
    r = (1 - least**2) / (least**2 * apart)
    squares = F.transform(ordered, lambda t: F.pow(F.size(F.filter(terms, lambda y: y == t)), F.lit(2)))
    whole = F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)

    def before(i: Column) -> Column:
        return F.aggregate(F.slice(squares, F.lit(1), i), F.lit(0.0), lambda a, x: a + x)

    return F.filter(ordered, lambda t, i: before(i) < whole * (r / (1 + r)) + 1e-9)


def _prefixes(texts: Sequence[DataFrame], least: float) -> list[DataFrame]:
    """For tables of distinct texts, (_text, _terms, _prefix): terms that are rare in all texts come first, so few texts meet at one."""
    split = [written(t.select("_text", text_terms(F.col("_text")).alias("_terms")).where(F.size("_terms") > 0), "terms") for t in texts]
    each = [t.select("_text", F.explode(F.array_distinct("_terms")).alias("_term")) for t in split]
    held = written(reduce(DataFrame.unionByName, each).groupBy("_term").agg(F.count(F.lit(1)).alias("_n")), "held")
    out = []
    for t, e in zip(split, each, strict=True):
        order = e.join(held, "_term").groupBy("_text").agg(F.array_sort(F.collect_list(F.struct("_n", "_term"))).alias("_order"))
        ordered = t.join(order, "_text").withColumn("_order", F.transform("_order", lambda x: x["_term"]))
        out.append(written(ordered.select("_text", "_terms", prefix_terms(F.col("_terms"), F.col("_order"), least).alias("_prefix")), "prefixes"))
    return out


def fuzzy_join(left: DataFrame, right: DataFrame, left_text: str, right_text: str, least: float = 0.9) -> DataFrame:
    """Pairs of similarity strictly above least (0 < least < 1), exactly: candidates come from an equi-join on prefix_terms, at 0.9 one or two of a short text.

    Distinct texts are compared, once each, and at the first term that both prefixes hold; copies meet their text's pairs last.
    """
    a, b = _prefixes([left.select(F.col(left_text).alias("_text")).distinct(), right.select(F.col(right_text).alias("_text")).distinct()], least)
    a = a.select(F.col("_text").alias("_text_a"), F.col("_terms").alias("_ta"), F.col("_prefix").alias("_pa"), F.explode("_prefix").alias("_term"))
    b = b.select(F.col("_text").alias("_text_b"), F.col("_terms").alias("_tb"), F.col("_prefix").alias("_pb"), F.explode("_prefix").alias("_term"))
    candidates = a.join(b, "_term").where(F.col("_term") == F.get(F.array_intersect("_pa", "_pb"), F.lit(0)))
    pairs = candidates.select("_text_a", "_text_b", F.round(pair_similarity(F.col("_ta"), F.col("_tb")), 6).alias("similarity")).where(F.col("similarity") > least)
    met = left.join(pairs, F.col(left_text) == F.col("_text_a")).join(right, F.col("_text_b") == F.col(right_text))
    return met.select(*[left[c] for c in left.columns], *[right[c] for c in right.columns], "similarity")


def best_match(left: DataFrame, right: DataFrame, left_text: str, right_text: str, order: str, least: float = 0.9) -> DataFrame:
    """left with the first row of right, by order, whose text is similar: what a loop over candidates in that order returns. Rows without one go.

    Equal texts are compared once: only representatives are joined, so copies never multiply.
    """
    mine = left.select(F.col(left_text).alias("_left")).distinct()
    theirs = right.groupBy(F.col(right_text).alias("_right")).agg(F.min(order).alias(order))
    pairs = fuzzy_join(mine, theirs, "_left", "_right", least)
    best = pairs.groupBy("_left").agg(F.min_by(F.struct(order, F.col("_right").alias(right_text), "similarity"), order).alias("_best"))
    return left.join(best, F.col(left_text) == F.col("_left")).select(*left.columns, "_best.*")
