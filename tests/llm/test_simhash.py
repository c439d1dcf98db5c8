from __future__ import annotations

import random
import re
import string

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrystone.llm.common import Scratch
from quarrystone.llm.components import components
from quarrystone.llm.simhash import fingerprints, hex16, links, near_dedup, popcount_cell, simhash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
MASK = (1 << 64) - 1


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def roots(items):
    """Least key of the component of each (key, fingerprint) within 2 bits."""
    parent = {k: k for k, _ in items}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if (x ^ y).bit_count() <= 2:
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {k: find(k) for k, _ in items}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB é\n\t\x1c\u00a0", max_size=60))
def test_fingerprint(text):
    assert simhash(text.encode()) & MASK == brute(text)


def test_against_brute_force(docs, texts):
    got = {r.doc_id: (r.f, r.component_id) for r in near_dedup(docs).select("doc_id", hex16(F.col("fp")).alias("f"), "component_id").collect()}
    fps = {k: brute(t) for k, t in texts.items()}
    least = roots(list(fps.items()))
    assert got == {k: (f"{fps[k]:016x}", least[k]) for k in fps}


def test_no_link_is_lost_among_crowded_fingerprints(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)] + [0, MASK]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(60)}
    signed = sorted((f ^ 1 << 63) - (1 << 63) for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long").withColumn("cell", popcount_cell(F.col("fp")))
    scratch = Scratch(spark, "test")
    got = {r.node: r.root for r in components(links(df, scratch), scratch).collect()}
    want = roots([(f, f & MASK) for f in signed])
    assert {f: got.get(f, f) for f in signed} == want


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(300)] + [(1001, 1000)], "u long, v long")
    got = {r.node: r.root for r in components(edges, Scratch(spark, "test")).collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000}


def test_awkward_rows(awkward, empty):
    got = near_dedup(awkward).collect()
    assert len(got) == awkward.count()
    blank = [r for r in got if r.fp == 0]
    assert {r.component_id for r in blank} == {0} and len(blank) == 3
    assert {r.component_id for r in got if r.doc_id == 4} == {4} and {r.component_id for r in got if r.doc_id in (3, 50)} == {3}
    assert fingerprints(empty).count() == near_dedup(empty).count() == 0
