from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from quarrystone.llm.line_dedup import dedup_lines

from test_lines_and_quality import brute_lines
from test_mixing_and_sharding import check_mix
from test_near_copies import brute

from quarrystone.llm.mixing import mix


def test_stages_are_the_ones_asked_for():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]


def test_each_stage_against_brute_force(spark, docs, sf, tmp_path):
    stages = dict(corpus_pipeline.STAGES)

    def kept(df, name):
        assert df.columns == docs.columns
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    one = kept(stages["language_id"](spark, docs, sf), "1")
    assert one.count() >= 0.99 * docs.count()
    two = kept(stages["line_dedup"](spark, one, sf), "2")
    before = [(r.doc_id, r.text) for r in one.orderBy("doc_id").collect()]
    want = {i: w[2] for (i, _), w in zip(before, brute_lines([t for _, t in before], 10), strict=True)}
    assert {r.doc_id: r.text for r in two.collect()} == want and two.where(F.col("n_chars") != F.length("text")).count() == 0
    three = kept(stages["near_dedup"](spark, two, sf), "3")
    assert {r.doc_id for r in three.collect()} == set(brute(want).values())
    check_mix(three, mix(three), 0.5)
    four = kept(stages["mixing"](spark, three, sf), "4")
    copies = {r.doc_id: r.copies for r in mix(three).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in four.groupBy("doc_id").count().collect()} == copies
    five = stages["packing"](spark, four, sf).collect()
    assert sum(r.start == 0 for r in five) == four.count()


def test_awkward_rows(spark, awkward, empty, sf, tmp_path):
    for k, table in enumerate((awkward, empty)):
        df = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, sf)
            assert out.columns == table.columns
            out.write.parquet(str(tmp_path / f"{k}-{name}"))
            df = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
        pieces = corpus_pipeline.STAGES[-1][1](spark, df, sf).count()
        assert pieces == 0 if k else pieces > 0


def test_columns_named_like_those_of_the_stages(spark, docs, sf):
    names = ["lang_pred", "lang_score", "_own", "_id", "_hash", "_copies", "_copy", "_node", "copies", "carried", "text_hash", "size", "root", "extra_0"]
    table = docs.limit(60)
    for k, name in enumerate(names):
        table = table.withColumn(name, F.lit(k) + F.col("doc_id"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, sf)
        assert out.columns == table.columns, name
        assert out.count() and all(out.where(F.col(n) != F.lit(k) + F.col("doc_id")).isEmpty() for k, n in enumerate(names)), name
    assert corpus_pipeline.STAGES[-1][1](spark, table, sf).count() > 0


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024


def test_line_stage_leaves_no_common_line(docs):
    again = dedup_lines(dedup_lines(docs).select("doc_id", F.col("kept_text").alias("text")))
    assert again.agg(F.sum("n_dropped")).first()[0] == 0
