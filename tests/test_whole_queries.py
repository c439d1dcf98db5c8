"""Queries take whole tables and whole texts; test_oracles.py compares each with its SQL."""

from __future__ import annotations

from quarrystone.plans.registry import QUERIES


def test_every_row_is_in(spark, sf):
    def rows(name):
        return spark.read.parquet(f"{sf}/{name}.parquet")

    def count(name):
        return QUERIES[name](spark, sf).count()

    assert count("t12_fenced_json") == rows("events").count()
    assert count("o2_natural_order") == rows("lineitem").count()
    assert count("j4_related_papers") == rows("lineitem").select("l_orderkey", "l_partkey").distinct().count()
    ids = rows("documents").select("doc_id").union(rows("embeddings").select("vec_id"))
    assert count("j2_full_outer") == ids.distinct().count()


def test_every_item_is_asked(spark, sf):
    asked = {r.item_id for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    found = {r.q for r in QUERIES["r10_per_source_topk"](spark, sf).collect()}
    assert found <= asked and max(found) >= 5


def test_texts_are_formatted(spark, sf):
    first = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").first()
    contexts = {r.source: r.context for r in QUERIES["t20_format_docs"](spark, sf).collect()}
    assert contexts[first.source].startswith(f"[1] {first.text}")
    assert QUERIES["t3_normalize_topic"](spark, sf).selectExpr("max(length(topic))").first()[0] > 70


def test_screening_prompts_hold_texts(spark, sf, monkeypatch):
    from quarrystone.plans import workflow

    seen = []
    monkeypatch.setattr(workflow.W, "screen", lambda docs, *a, **k: seen.append(docs))
    workflow.screen(spark, sf)
    texts = spark.read.parquet(f"{sf}/documents.parquet")
    assert seen[0].join(texts, "doc_id").where("NOT title <=> text").count() == 0


def test_kappa_has_2000_replicates(spark, sf, monkeypatch):
    from quarrystone.plans import statistics

    counts, drawn = [], statistics.S.resampled
    monkeypatch.setattr(statistics.S, "resampled", lambda rows, cell, replicates: counts.append(replicates) or drawn(rows, cell, replicates=replicates))
    statistics.bootstrap_kappa(spark, sf)
    assert counts == [2000]
