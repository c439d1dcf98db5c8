"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of labelled documents, at most about
``max_train_docs`` a language (drawn by a hash of the id, so that reruns agree),
in Arrow batches, sums them in Spark and brings one count for each language and
bucket to the driver: buckets x languages numbers, whatever the corpus. The
matrix of log probabilities is broadcast, in fixed point, so that a document's
score does not depend on the batch it is in. Scoring is numpy over whole texts:
the n-grams of a batch are hashed at once, the matrix gathered at them and summed
by document. A text above ``SLICE`` characters is gone through in slices that hand
their last two letters on, which gives the same n-grams in bounded memory.

N-grams are those of the lower-cased text in which a run of characters that are
not letters counts as one space, so symbols, digits and markup say nothing.

Defined cases: null text and text without a letter are ``und`` with score 0;
documents with null label or null id are never learned from; with no training
documents every document is ``und``; ties go to the least label; columns of the input
named like the two that are added are replaced.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3)
SCALE = 1 << 12
SLICE = 1 << 20
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:  # once a worker
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def _buckets(code: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """The bucket of the n-gram at every start."""
    spread = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
    many = len(code) - n + 1
    h = code[:many] * spread[0]
    for k in range(1, n):
        h = (h ^ (h >> np.uint64(29))) * spread[k] + code[k : k + many]
    h = (h ^ (h >> np.uint64(31))) * spread[0]
    return (h >> np.uint64(40)).astype(np.int64) & (buckets - 1)


def long_ngrams(text: str, buckets: int, most: int = SLICE) -> Iterator[np.ndarray]:
    """The buckets of a long text's n-grams, slice by slice: together those of ngrams([text])."""
    lowered = text.lower() + " "
    tail, tail_letter, after_letter = np.zeros(0, np.uint64), np.zeros(0, bool), False
    for at in range(0, len(lowered), most):
        code = np.frombuffer(lowered[at : at + most].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[code]
        keep = letter | np.concatenate([[after_letter], letter[:-1]])
        after_letter = bool(letter[-1])
        code = np.concatenate([tail, np.where(letter, code, 32)[keep].astype(np.uint64)])
        letter = np.concatenate([tail_letter, letter[keep]])
        for n in ORDERS:
            start = max(0, len(tail) - n + 1)
            if len(code) - start >= n:
                found = _buckets(code[start:], n, buckets)
                yield found[letter[start:]] if n == 1 else found
        tail, tail_letter = code[-2:], letter[-2:]


def ngrams(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram of every text, by document; documents without a letter have none."""
    lowered = [(t or "").lower() for t in texts]
    # Every text ends in a space and begins after one: n-grams never cross texts.
    code = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))
    doc = np.repeat(np.arange(len(lowered), dtype=np.int32), sizes)
    letter = _is_letter()[code]
    # Keep letters and, of each run of others, the first.
    keep = letter | np.concatenate([[False], letter[:-1]])
    code, doc, letter = np.where(letter, code, 32)[keep].astype(np.uint64), doc[keep], letter[keep]
    out_doc, out_hash = [], []
    for n in ORDERS:
        many = len(code) - n + 1
        if many <= 0:
            continue
        ok = doc[:many] == doc[n - 1 :]
        if n == 1:
            ok &= letter
        out_doc.append(doc[:many][ok])
        out_hash.append(_buckets(code, n, buckets)[ok])
    return (np.concatenate(out_doc), np.concatenate(out_hash)) if out_doc else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def _slices(b: pa.RecordBatch, column: int, most: int = SLICE) -> Iterator[tuple[int, list[str | None]]]:
    """(start, texts) of parts of a batch of at most so many characters, or of one longer text: bounds the arrays made at once."""
    part: list[str | None] = []
    start = size = 0
    for i, t in enumerate(b.column(column)):
        t = t.as_py()
        if part and size + len(t or "") > most:
            yield start, part
            start, part, size = i, [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield start, part


class Model:
    """labels and the fixed-point log probabilities: matrix[bucket, label] and prior[label]."""

    def __init__(self, labels: list[str], matrix: np.ndarray, prior: np.ndarray) -> None:
        self.labels, self.matrix, self.prior = labels, matrix, prior


def held_out(id_col: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls in the held-out fold; null ids do not."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_train_docs: int = 5000, buckets: int = 1 << 16) -> Model:
    """Learns from the given rows with a label."""
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    per = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # as many rows as labels
    labels = sorted(per)
    if not labels:
        return Model([], np.zeros((buckets, 0), np.int32), np.zeros(0, np.int64))
    index = {label: k for k, label in enumerate(labels)}
    odds = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(0.0)
    for label in labels:
        share = F.when(F.col("label") == label, F.lit(min(1.0, max_train_docs / per[label]))).otherwise(share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([index[x.as_py()] for x in b.column(0)], np.int64)
            for start, texts in _slices(b, 1):
                if len(texts) == 1 and len(texts[0] or "") > SLICE:
                    found = (own[start] * buckets + bucket for bucket in long_ngrams(texts[0], buckets))
                else:
                    doc, bucket = ngrams(texts, buckets)
                    found = iter([own[start:][doc] * buckets + bucket])
                for each in found:
                    keys, n = np.unique(each, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    counted = rows.where(odds < share).select("label", "text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # at most buckets x labels rows
    counts = np.zeros(len(labels) * buckets)
    counts[found.column("key").to_numpy()] = found.column("n").to_numpy()
    counts = counts.reshape(len(labels), buckets).T + 0.5
    matrix = np.round(np.log(counts / counts.sum(axis=0)) * SCALE).astype(np.int32)
    docs_per = np.array([per[label] for label in labels], float)
    return Model(labels, matrix, np.round(np.log(docs_per / docs_per.sum()) * SCALE).astype(np.int64))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score: the posterior of the prediction, from 0 to 1."""
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score")).schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        buckets = len(m.matrix)
        for b in batches:
            for start, texts in _slices(b, at):
                sums = np.zeros((len(texts), max(len(m.labels), 1)), np.int64)
                sums[:, : len(m.labels)] = m.prior
                if len(texts) == 1 and len(texts[0] or "") > SLICE:
                    known = np.zeros(1, bool)
                    for bucket in long_ngrams(texts[0], buckets):
                        known |= len(bucket) > 0
                        for k in range(len(m.labels)):
                            sums[0, k] += np.take(m.matrix[:, k], bucket).sum(dtype=np.int64)
                else:
                    doc, bucket = ngrams(texts, buckets)
                    known = np.bincount(doc, minlength=len(texts)) > 0
                    for k in range(len(m.labels)):  # int32 sums are exact in doubles
                        sums[:, k] += np.bincount(doc, weights=np.take(m.matrix[:, k], bucket), minlength=len(texts)).astype(np.int64)
                known &= bool(m.labels)
                best = sums.argmax(axis=1)
                score = 1 / np.exp((sums - sums.max(axis=1, keepdims=True)) / SCALE).sum(axis=1)
                names = [m.labels[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
                part = b.slice(start, len(texts))
                yield part.append_column("lang_pred", pa.array(names, pa.string())).append_column("lang_score", pa.array(np.where(known, score, 0.0), pa.float64()))

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **options: int) -> DataFrame:
    """Learns from the rows outside the held-out fold and predicts every row."""
    model = train(docs.where(~held_out(F.col(id_col))), id_col, text_col, label_col, **options)
    return predict(docs, model, id_col, text_col)
