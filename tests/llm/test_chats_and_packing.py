from __future__ import annotations

import zlib

import numpy as np
import pytest
from compare import assert_same, connect
from tokenizers import Tokenizer as File

from quarrystone.llm import queries
from quarrystone.llm.chats import collapse
from quarrystone.llm.packing import default_tokenizer, encoder, hilbert, pack, tokenized

CHATS = "conv_id long, turn long, role string, text string, place int, p1 long"


def chats(spark, convs):
    rows = [(c, k, r, t, 0, 0) for c, turns in convs for k, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, CHATS)


def test_prefixes_and_copies_go(spark):
    a = [("user", "x"), ("assistant", "y"), ("user", "z")]
    df = chats(spark, [(1, a[:1]), (2, a[:2]), (3, a), (4, a), (5, [("user", "x"), ("assistant", "n")]), (6, [("user", None)]), (7, [("user", "")]), (8, [(None, "<|end|>")])])
    got = {r.conv_id: r.n_turns for r in collapse(df).collect()}
    assert got == {3: 3, 5: 2, 6: 1, 7: 1, 8: 1}
    assert collapse(df).where("conv_id = 8").first().rendered == "<||>\n<\\|end|>\n<|end|>\n"


def test_no_two_conversations_render_alike(spark):
    turns = [[("user", "<|")], [("user", "<\\|")], [("user", "\\<|")], [("a|>\nx\n<|end|>\n<|b", "y")], [("a", "x"), ("b", "y")], [("a\\|", "y")], [("a|", "y")], [("a|>\nx", "y")], [("a", "x\n<|end|>")]]
    got = [r.rendered for r in collapse(chats(spark, list(enumerate(turns)))).collect()]
    assert len(got) == len({*got}) == len(turns)
    assert all(r.rendered.count("\n<|end|>\n") == r.n_turns for r in collapse(chats(spark, list(enumerate(turns)))).collect())


def test_a_common_first_turn_and_a_huge_group_of_copies(spark):
    convs = [(k, [("user", "hi"), ("assistant", str(k % 50))]) for k in range(600)] + [(1000 + k, [("user", "hi")]) for k in range(300)]
    assert {r.conv_id for r in collapse(chats(spark, convs)).collect()} == set(range(50))


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 0, "user", "q", 0, 0), (1, None, "user", "a", 0, 0), (1, None, "user", "b", 0, 0)], CHATS)
    assert {(r.conv_id, r.n_turns) for r in collapse(df).collect()} == {(None, 1), (1, 2)}
    assert collapse(spark.createDataFrame([], CHATS)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf).toPandas(), connect(sf).execute(queries.ORACLE_SQL[name]).df())


def test_every_query_is_registered():
    assert sorted(q.split("_")[0] for q in queries.QUERIES) == sorted(f"op{n}" for n in range(1, 14))


def file_ids(texts):
    t = File.from_file(default_tokenizer().path)
    return [np.array([*e.ids, 0], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_pieces(df, out, length=1024):
    want = {}
    rows = df.collect()
    for r, ids in zip(rows, file_ids([r.text for r in rows]), strict=True):
        want.setdefault(r.doc_id, []).append(ids.tobytes())
    pieces = sorted(out.collect(), key=lambda r: (r.sequence_id, r.offset))
    filled, open_docs, got = {}, {}, {}
    for p in pieces:
        assert p.offset == filled.get(p.sequence_id, 0) and p.length > 0 and zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        filled[p.sequence_id] = p.offset + p.length
        held = open_docs.setdefault(p.doc_id, [])
        if not p.start:
            held.append(b"")
        one = next(k for k, h in enumerate(held) if len(h) == 4 * p.start)
        held[one] += p.ids
        if len(held[one]) == 4 * p.doc_tokens:
            got.setdefault(p.doc_id, []).append(held.pop(one))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert max(filled.values(), default=0) <= length
    return filled


def test_pieces_restore_every_document(docs):
    filled = check_pieces(docs, pack(docs, with_ids=True))
    padding = sum(1024 - n for n in filled.values())
    assert padding <= 0.05 * sum(filled.values())


def test_packing_awkward(awkward, empty):
    check_pieces(awkward, pack(awkward, with_ids=True))
    assert pack(empty).count() == 0


def test_ranks_give_the_ids_of_the_file():
    texts = ["", " ", "a  b\n\n c\t", "don't I'LL 's", "\u00a0x\u2003y\x85z\x1c", "é̂ 漢字かな 🙂🏽 ²½Ⅳ", "<|endoftext|> x", "A" * 5000, "\r\n \r\n", "\ufeff\u200b"]
    t = default_tokenizer()
    slow = encoder(t._replace(ranks=None, pattern=None)).encode(texts)
    assert encoder(t).encode(texts) == slow == [ids[:-1].astype("<u2").tobytes() for ids in file_ids(texts)]


def test_hilbert_visits_every_cell_by_single_steps():
    bits, dims = 3, 3
    cells = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
    keys = hilbert(cells, bits)
    assert sorted(keys) == list(range(1 << bits * dims))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_copies_have_equal_keys(docs):
    by = {}
    for r in tokenized(docs).collect():
        by.setdefault(bytes(r.ids), set()).add(r.key)
    assert all(len(v) == 1 for v in by.values())
