from __future__ import annotations

import math
import random

import corpus_pipeline
import numpy as np
import pytest

from quarrystone.llm.common import Scratch
from quarrystone.llm.near_copies import BANDS, ROWS, _across, _like_another, _permutations, grid_pairs, least_agreement, minima, near_copies, shingles, similarity
from quarrystone.llm.simhash import simhash


def shingle_set(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}


def brute(texts, least=0.8):
    """Least key of the component of each text, all pairs compared."""
    sets, parent = {k: shingle_set(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {k: find(k) for k in keys}


def changed(at, words=200):
    return " ".join(f"x{k}" if k in at else f"w{k * k % 1009}" for k in range(words))


#: 0 to 2 are a chain: 0 and 2 are below 0.8, each is above with 1. 3 is below 0.8 with all. 4 to 6 hold no word.
TEXTS = {0: changed([]), 1: changed([50, 100]), 2: changed([50, 100, 130, 160]), 3: changed(range(0, 200, 20)), 4: None, 5: "", 6: " \n", 7: "one", 8: "ONE", 9: "two"}


def test_near_copies_beyond_two_bits(spark):
    want = {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7, 8: 7, 9: 9}
    assert brute(TEXTS) == want
    assert any((simhash(TEXTS[a].encode()) ^ simhash(TEXTS[b].encode())).bit_count() > 2 for a, b in ((0, 1), (1, 2)))
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies(docs).collect()} == want
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == set(want.values())


def test_documents_against_brute_force(docs, texts):
    assert {r.doc_id: r.component_id for r in near_copies(docs).collect()} == brute(texts)


@pytest.mark.parametrize(("block", "most"), [(3, 200), (4096, 1 << 21)])
def test_texts_that_share_passages_against_brute_force(spark, block, most):
    """Texts around the threshold, many of them in the same buckets, with buckets above and below the size of a block."""
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    texts = {}
    for k in range(160):
        own = [f"own{rng.randrange(12)}_{j}" for j in range(rng.choice([4, 8, 12, 20, 40]))]
        at = rng.randrange(2)
        texts[k] = " ".join(passage + own if at else own + passage)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies(docs, block=block, block_shingles=most).collect()} == brute(texts)


def test_blocks_link_all_that_is_similar(spark):
    """Across components of one bucket, whatever the size of its blocks."""
    rng = random.Random(7)
    texts = {k: changed(rng.sample(range(200), rng.randrange(12))) for k in range(40)}
    sets = {k: shingles(t.encode()) for k, t in texts.items()}
    root = {k: k % 5 if k < 20 else 9 for k in texts}
    sketch = {k: minima(x, _permutations()) for k, x in sets.items()}
    rows = [(1, 0, k, root[k], bytearray(x.astype("u1").tobytes() + np.full(32, 1, np.int64).tobytes()), sets[k].astype("i8").tolist()) for k, x in sketch.items()]
    members = spark.createDataFrame(rows, "p long, band int, node long, root long, sketch binary, shingles array<long>")
    alike = {(b, a) for a in range(40) for b in range(a + 1, 40) if root[a] != root[b] and similarity(sets[a], sets[b]) >= 0.8}
    want = joined(range(40), alike, root)
    assert 0 < len(alike) < 40 * 39 / 2
    for block in (4, 7, 100):
        close = {r.node for r in _like_another(members, 0.8, block).collect()}
        assert close >= {k for pair in alike for k in pair}
        got = {(r.u, r.v) for r in _across(members, 0.8, 60 * block).collect()}
        assert got <= alike and joined(range(40), got, root) == want


def joined(nodes, links, root):
    """The groups of nodes that links and equal roots join."""
    groups = {frozenset(n for n in nodes if root[n] == r) for r in set(root.values())}
    for a, b in links:
        x, y = next(g for g in groups if a in g), next(g for g in groups if b in g)
        groups = (groups - {x, y}) | {x | y}
    return groups


def test_least_agreement():
    n, most = BANDS * ROWS, least_agreement(0.8) - 1
    assert sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(most + 1)) < 4e-6


@pytest.mark.parametrize("size", [300])
def test_a_large_group_is_one_component(spark, size):
    docs = spark.createDataFrame([(k, changed([k % 200])) for k in range(size)], "doc_id long, text string")
    assert {r.component_id for r in near_copies(docs).collect()} == {0}


def test_one_row_a_component_whatever_the_ids(spark):
    other = " ".join(f"other{k}" for k in range(200))
    rows = [(None, "alone one"), (None, "alone two"), (None, "alone two"), (1, "first text"), (1, "second text"), (1, "second text"), (None, TEXTS[0]), (5, TEXTS[1]), (3, other), (3, TEXTS[0]), (2, other)]
    want = [(None, "alone one"), (None, "alone two"), (1, "first text"), (1, "second text"), (2, other), (3, TEXTS[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()), key=key) == sorted(want, key=key)


def test_grid_pairs_against_all_pairs_of_fingerprints(spark):
    """The pipeline's candidates begin with the numbered SimHash grid: its links join what fingerprints within 2 bits join."""
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(30)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), n)) for f in fps[:20] for n in (0, 1, 2, 3)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = grid_pairs(spark.createDataFrame(list(enumerate(signed)), "node long, fp long"), Scratch(spark, "test-grid")).collect()
    near = {(b, a) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 2}
    own = {n: n for n in range(len(fps))}
    assert got and all(r.u > r.v for r in got) and joined(own, {(r.u, r.v) for r in got}, own) == joined(own, near, own)
