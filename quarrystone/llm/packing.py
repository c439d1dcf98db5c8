"""Packing along a space-filling curve.

1. One pass tokenizes whole texts (Arrow batches) and writes token ids with a
   Hilbert key: the tokens are hashed to a vector of square-rooted counts, projected
   to four dimensions by a fixed Gaussian matrix and put on a Hilbert curve, so
   documents of like vocabulary get near keys.
2. Rows are range-partitioned by (key, id) and sorted, so neighbours on the curve
   are neighbours in a partition; ties on the key, as in a huge group of copies, are
   dealt by id.
3. Each partition cuts its stream of tokens into sequences as it comes by, in
   bounded memory. All sequences of a partition but its last are full, so padding is
   below one sequence a partition.

Token ids move through one shuffle of two bytes a token.

Defined cases: null text is empty and packs as the closing id alone; repeated rows
are packed each; runs of millions of equal characters are text as any other; an empty
table gives an empty result. A text, its ids and its pieces are held at once by one task.
"""

from __future__ import annotations

import base64
import os
import zlib
from array import array
from collections.abc import Iterator
from math import erf, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

DIMS, BITS, HASHED = 4, 12, 4096
#: One text in so many is encoded by the tokenizer file itself too.
CHECKED = 512
_encoders: dict[Tokenizer, Encoder] = {}


class Tokenizer(NamedTuple):
    """A tokenizers file and, if there is one, the same vocabulary as byte-pair ranks with its splitting pattern."""

    path: str
    ranks: str | None = None
    pattern: str | None = None


class Encoder:
    """Token ids of texts, as little-endian unsigned 16-bit integers (32 if the vocabulary asks for it).

    The ids are those of the tokenizers file. Where the same vocabulary is there as
    ranks, the ids come from those, some five times faster, and one text in CHECKED is
    compared with the file's own ids; a difference stops the run. Tests compare both for
    every code point beside letters, digits, blanks and apostrophes, for runs of all lengths
    that matter and for every token, which covers all that the splitting pattern and the
    merges depend on. Texts that hold an added token, such as <|endoftext|>, and those that
    the ranks' pattern engine can't split (very long white space) go through the file itself.
    """

    def __init__(self, t: Tokenizer) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(t.path)
        self.added = [a.content for a in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.seen = 0
        self.fast = None
        if t.ranks and t.pattern:
            import tiktoken

            with open(t.ranks, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=t.pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out = []
        for t in texts:
            if any(a in t for a in self.added):  # the ranks do not know them
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.dtype).tobytes())
                continue
            try:
                ids = self.fast.encode_ordinary(t)
            except (KeyboardInterrupt, SystemExit, MemoryError):
                raise
            except BaseException:  # its pattern engine gives up on runs of some 100,000 blanks, by an error or a panic that is no Exception
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.dtype).tobytes())
                continue
            if self.seen % CHECKED == 0 and ids != self.tokenizer.encode(t, add_special_tokens=False).ids:
                raise ValueError("the ranks and the tokenizers file give different ids")
            self.seen += 1
            out.append(array("H" if self.dtype.itemsize == 2 else "I", ids).tobytes())
        return out


def encoder(t: Tokenizer) -> Encoder:
    if t not in _encoders:  # once a worker
        _encoders[t] = Encoder(t)
    return _encoders[t]


def default_tokenizer() -> Tokenizer:
    import public_tokenizers

    return Tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def hilbert(at: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of integer coordinates below 2 ** bits (Skilling's transform, all rows at once)."""
    x = at.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            set_ = (x[:, i] & q) != 0
            swap = np.where(set_, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(set_, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[:, i] >> bit & 1)
    return key


def _plane() -> np.ndarray:
    return np.random.default_rng(8).standard_normal((HASHED, DIMS))


def curve_keys(encoded: list[bytes], dtype: np.dtype, plane: np.ndarray) -> np.ndarray:
    """The Hilbert key of every document."""
    at = np.zeros((len(encoded), DIMS), np.int64)
    for i, raw in enumerate(encoded):
        ids = np.frombuffer(raw, dtype).astype(np.uint32)
        if len(ids):
            counts = np.bincount((ids * np.uint32(2654435761)) >> np.uint32(20), minlength=HASHED)
            used = np.flatnonzero(counts)
            z = np.sqrt(counts[used]) @ plane[used] / sqrt(len(ids))
            at[i] = [min((1 << BITS) - 1, int((1 + erf(v / sqrt(2))) / 2 * (1 << BITS))) for v in z.tolist()]
    return hilbert(at, BITS)


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: Tokenizer | None = None, most_chars: int = 1 << 21) -> DataFrame:
    """(id, key, ids binary) for each row."""
    chosen = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, plane = encoder(chosen), _plane()

        def done(ids: list, texts: list[str]) -> pa.RecordBatch:
            raw = enc.encode(texts)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(curve_keys(raw, enc.dtype, plane), pa.int64()), pa.array(raw, pa.binary())], names=["id", "key", "ids"])

        for b in batches:
            id_type = b.schema.field(0).type
            ids: list = []
            texts: list[str] = []
            size = 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= most_chars:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield done(ids, texts)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key long, ids binary")


def pack(docs: DataFrame, length: int = 1024, closing_id: int = 0, id_col: str = "doc_id", text_col: str = "text", tokenizer: Tokenizer | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset), with the piece's ids (32-bit, little-endian) if asked for."""
    scratch = Scratch(docs.sparkSession, "packing")
    rows = scratch.keep(tokenized(docs, id_col, text_col, tokenizer), "tokens", "zstd")
    chosen = tokenizer or default_tokenizer()
    ordered = rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(chosen).dtype
        sequence, filled = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            out: list[list] = [[] for _ in names]
            for i, raw in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                ids = np.append(np.frombuffer(raw.as_py(), dtype), closing_id).astype("<u4")
                at = 0
                while at < len(ids):
                    if filled == length:
                        sequence, filled = sequence + 1, 0
                    many = min(length - filled, len(ids) - at)
                    piece = ids[at : at + many].tobytes()
                    for column, value in zip(out, (i, at, many, zlib.crc32(piece), len(ids), sequence, filled, piece), strict=False):
                        column.append(value)
                    at += many
                    filled += many
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, [b.schema.field(0).type, *[pa.int64()] * 6, pa.binary()], strict=False)], names=names)

    return ordered.mapInArrow(run, schema)
