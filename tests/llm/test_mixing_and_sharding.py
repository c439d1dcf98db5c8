from __future__ import annotations

import re
import zlib

import pytest
from pyspark.sql import functions as F

from quarrystone.llm import sharding
from quarrystone.llm.mixing import mix, water_fill


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, None: 100}, {"a": 1, "b": 1000, "c": 3, "d": 40}, {"x": 7}, {"a": 0, "b": 10}, {f"s{k}": 13 * k % 50 for k in range(30)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in water_fill(df, (5, 2, 1), 1.5, 2).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def check_mix(df, out, slack):
    size = {}
    words = [(r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in df.collect()]
    for s, n in words:
        size[s] = size.get(s, 0) + n
    rows = out.collect()
    assert sorted(r["size"] for r in rows) == sorted(n for _, n in words)
    want, taken = brute_targets(size), {}
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= slack * max((n for t, n in words if t == s), default=0), s


def test_mix(docs):
    check_mix(docs, mix(docs), 0.5)


def test_mix_awkward(awkward, empty):
    check_mix(awkward, mix(awkward), 1.0)
    assert mix(empty).count() == 0


def test_mix_reruns_agree(docs):
    a, b = (sorted((r.doc_id, r.copies) for r in mix(docs.repartition(n)).collect()) for n in (1, 6))
    assert a == b


def test_mix_solves_the_dual(docs):
    """Each rate is the source's tilt to the power of the relative size, and rates meet the target before rounding."""
    rows = mix(docs, tilt=1.0).where("size > 0").collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        assert sum(r.rate * r["size"] for r in rs) == pytest.approx(rs[0].target, rel=1e-6)


def test_mix_has_no_python(docs):
    plan = mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def check_shards(df, out, shards):
    rows = out.collect()
    want = sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.crc) for r in rows) == want
    slots, sizes = {}, {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return sizes


def test_shards(docs):
    sizes = check_shards(docs, sharding.shard(docs, 10), 10)
    mean = sum(sizes.values()) / 10
    largest = docs.agg(F.max(F.octet_length("text"))).first()[0]
    assert all(abs(s - mean) <= 1.02 * largest + 0.02 * mean for s in sizes.values())


def test_shards_split_a_hot_text_and_keep_small_groups(spark):
    rows = [(k, "hot") for k in range(3000)] + [(10_000 + k, f"copy {k // 5} " + "x" * (k // 5 % 40)) for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard(df, 8, rows_per_range=100, per_range=4)
    sizes = check_shards(df, out, 8)
    assert max(sizes.values()) <= 1.05 * min(sizes.values())
    spread = out.join(df, "doc_id").groupBy("text").agg(F.count_distinct("shard").alias("n"))
    assert spread.where("text = 'hot'").first().n > 1 and spread.where("text <> 'hot' AND n > 1").count() <= 8


@pytest.mark.parametrize("copies", [1, 2, 5, 20, 60, 400])
def test_one_rule_for_groups_of_all_sizes(spark, copies):
    """Every end of a shard moves by at most the slack, and a group is cut only where an edge is not that near."""
    df = spark.createDataFrame([(k, f"group {k // copies} " + "y" * 50) for k in range(2000)], "doc_id long, text string")
    out = sharding.shard(df, 10, rows_per_range=100, per_range=4, slack=0.04)
    sizes = check_shards(df, out, 10)
    mean = sum(sizes.values()) / 10
    assert all(abs(s - mean) <= 0.08 * mean + 100 for s in sizes.values())
    cut = out.join(df, "doc_id").groupBy("text").agg(F.count_distinct("shard").alias("n")).where("n > 1").count()
    assert cut == 0 if copies <= 5 else cut <= 9


def test_shards_of_rows_without_ids(spark):
    df = spark.createDataFrame([(None, "same")] * 3000 + [(k, f"text {k}") for k in range(3000)], "doc_id long, text string")
    out = sharding.shard(df, 8, rows_per_range=100, per_range=4)
    sizes = check_shards(df, out, 8)
    assert max(sizes.values()) <= 1.05 * min(sizes.values())


def test_shards_awkward(awkward, empty):
    check_shards(awkward, sharding.shard(awkward, 4), 4)
    assert sharding.shard(empty, 4).count() == 0


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs.limit(100), str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 100


@pytest.mark.parametrize("parts", [1, 6])
def test_sources_of_repeated_rows_meet_their_targets(spark, parts):
    """Three sources of 10,000 words: one of different texts, one of ten, one of a single row a thousand times."""
    rows = [(k, f"word{k} " * 10, "a") for k in range(1000)] + [(k % 10, f"w{k % 10} " * 10, "b") for k in range(1000)] + [(7, "x " * 10, "c")] * 1000 + [(None, None, "c")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
    out = mix(df).collect()
    assert len(out) == 3050
    for source in "abc":
        own = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 5 and all(r.taken <= 2 * r.size for r in own)
    again = mix(df.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.source, r.copies)
    assert sorted(map(key, out), key=str) == sorted(map(key, again), key=str)
    assert sorted(r.repeat for r in out if r.source == "c" and r.size) == list(range(1, 1001))
