"""The ranks give the ids of the tokenizers file: for every code point in every neighbourhood that the splitting pattern sees, and for long runs."""

from __future__ import annotations

import random
import sys
import zlib

import numpy as np
import pytest

from quarrystone.llm.packing import Encoder, Tokenizer, default_tokenizer, pack


@pytest.fixture(scope="module")
def both():
    fast = Encoder(default_tokenizer())
    return fast, Encoder(Tokenizer(default_tokenizer().path))


def same(both, texts):
    fast, plain = both
    for k in range(0, len(texts), 4096):
        for t, a, b in zip(texts[k : k + 4096], fast.encode(texts[k : k + 4096]), plain.encode(texts[k : k + 4096]), strict=True):
            assert a == b, ascii(t[:80])


def test_every_code_point_among_its_neighbours(both):
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    same(both, ["".join("a{0}b {0}1{0}'{0}s{0}{0}!\n".format(c) for c in points[k : k + 64]) for k in range(0, len(points), 64)])


def test_every_token(both):
    texts = [t.decode() for t in both[0].fast.token_byte_values() if _is_text(t)]
    assert len(texts) > 40_000
    rng = random.Random(8)
    same(both, texts + ["".join(rng.choices(texts, k=20)) for _ in range(3000)])


def _is_text(raw: bytes) -> bool:
    try:
        return bool(raw.decode())
    except UnicodeDecodeError:
        return False


def test_runs_of_all_lengths(both):
    kinds = [" ", "\n", "\t", "　", "a", "é", "1", "!", "'", " a", "\r\n"]
    same(both, [f"x{k * n}y{k * n}" for k in kinds for n in (*range(1, 70), 127, 128, 255, 256, 257, 1000, 4097)])


@pytest.mark.parametrize("run", [" ", "\n", "e", "7"])
def test_a_run_of_two_million_characters(spark, both, run):
    text = "a" + run * 2_000_000 + "b"
    got = pack(spark.createDataFrame([(1, text), (2, "c")], "doc_id long, text string"), with_ids=True).where("doc_id = 1").orderBy("start").collect()
    ids = np.frombuffer(b"".join(bytes(r.ids) for r in got), "<u4")
    assert ids[:-1].tolist() == both[1].tokenizer.encode(text, add_special_tokens=False).ids and ids[-1] == 0
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.doc_tokens == len(ids) for r in got)
