"""Ties that an order leaves open go to the row stored first; classes without a drawn row are there."""

from __future__ import annotations

import html

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F

from quarrystone.functions import text
from quarrystone.operators import retrieval, segments, statistics, workflow
from quarrystone.plans.registry import ORACLE_SQL, QUERIES
from quarrystone.sources import sinks


@pytest.fixture()
def tied(spark, tmp_path):
    """Lines in two files, the larger one second: every order and every paper has ties, within a file and across files, that differ in part and flag."""
    def lines(start, stop):
        return spark.range(start, stop, 1, 1).selectExpr(
            "id % 40 AS l_orderkey", "IF(id % 17 = 0, NULL, id % 200 * 10 + id % 2) AS l_partkey", "CAST(1 AS INT) AS l_linenumber",
            "CASE WHEN id % 40 = 7 THEN NULL WHEN id % 40 = 8 THEN double('NaN') ELSE double(id div 80 % 3) END AS l_extendedprice", "IF(id % 3 = 0, 'R', 'N') AS l_returnflag")

    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    for k, part in enumerate([lines(0, 300), lines(300, 3000)]):
        part.toPandas().astype({"l_partkey": "Int64"}).to_parquet(folder / f"part-{k}.parquet")
    return str(tmp_path)


def test_last_wins_of_equal_prices(spark, tied):
    con = connect(tied)
    con.execute("SET threads = 1")
    assert_same(QUERIES["a16_last_wins"](spark, tied).toPandas(), con.execute(ORACLE_SQL["a16_last_wins"]).df())


def test_searchable_of_equal_places(spark, tied):
    """SQL leaves open which of equal places comes first (DuckDB's pick changes with its threads), so the rows are those of SQL with the stored order as last key."""
    want = connect(tied).execute(f"""SELECT paper, pos FROM (SELECT l_partkey AS paper, l_orderkey * 10 + l_linenumber AS pos, l_returnflag, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber, filename, file_row_number) AS n
        FROM read_parquet('{tied}/lineitem.parquet/*.parquet', filename = true, file_row_number = true) WHERE l_linenumber % 4 <> 0) WHERE n = 1 AND l_returnflag <> 'R'""").df()
    assert_same(QUERIES["f1_searchable"](spark, tied).toPandas(), want)


def test_all_positives_has_each_class(spark, tmp_path):
    """With 80 positives or more no other row is drawn, and the class is there with none."""
    spark.range(500).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality").write.parquet(str(tmp_path / "labels.parquet"))
    got = QUERIES["u6_all_positives"](spark, str(tmp_path))
    assert_same(got.toPandas(), connect(str(tmp_path)).execute(ORACLE_SQL["u6_all_positives"]).df())


def test_page_recommendations_over_blocks(spark):
    """Spans go over blocks, headings within one and broken between two: the rows are those of the whole text."""
    said = ["lead 9.9 Not", "1.2 Use of a ( b ) we recom-", "mend c #QoE low# tail", None, "x 2.1 We suggest d 1.2 Again advised", "1.2 We recommend e", "(", "3.4 Preferred is &lt;f&gt; SoR Discussion g", "we recommend 4.1", "Use SoR advised", "8.1 Use SoR", "5.1 None SoR", "6.1  Two (SoR advised"]
    rows = [(by, n // 3, n, t) for by in (1, None) for n, t in enumerate(said)]
    blocks = spark.createDataFrame(rows, "by long, page long, n long, text string")
    whole = spark.createDataFrame([(" ".join(t for t in said if t is not None),)], "body string")
    want = whole.select(segments.clean_text(F.col("body")).alias("body")).select(F.explode(segments.keyword_sections(F.col("body"))).alias("number", "text")).collect()
    got = segments.page_recommendations(blocks, "by", "page", "n", "text").collect()
    assert sorted(r.number for r in want) == ["1.2", "2.1", "3.4", "4.1", "6.1"]
    for by in (1, None):
        assert {(r.number, r.text) for r in got if r.by == by} == {(r.number, r.text) for r in want}


def test_page_recommendations_hold_no_document_whole(spark):
    rows = spark.range(20_000).selectExpr("id % 1 AS by", "id % 9 AS page", "id AS n", "concat('1.', id, ' We recommend ', id, ' #QoE low#') AS text")
    assert segments.page_recommendations(rows, "by", "page", "n", "text").toPandas().number.nunique() == 20_000


def test_first_entry_meets_a_text_once(spark, tmp_path):
    """The plan joins one row a text, not every entry of it."""
    spark.range(3000).selectExpr("id AS c_custkey", "CAST(id % 2 AS INT) AS c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(3000).selectExpr("id AS s_suppkey", "CAST(id % 3 AS INT) AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    got = QUERIES["j8_first_by_trimmed_text"](spark, str(tmp_path))
    assert_same(got.toPandas(), connect(str(tmp_path)).execute(ORACLE_SQL["j8_first_by_trimmed_text"]).df())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


@pytest.mark.parametrize("few", [True, False])
def test_best_of_each_source_in_parts(spark, tmp_path, monkeypatch, few):
    """Batches are scored in parts of a few terms, sources may be null, and with many query terms the joined way gives the same rows."""
    monkeypatch.setattr(retrieval, "PART_TERMS", 5)
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 500_000 if few else 0)
    docs = "id AS doc_id, IF(id % 9 = 0, NULL, concat_ws(' ', 'a', repeat('b ', int(id % 5)), 'c', concat('d', id % 7), repeat('e ', int(id % 11)))) AS text, get(array('x', 'y', 'z'), int(id % 4)) AS source"
    spark.sql(f"SELECT {docs} FROM range(200)").write.parquet(str(tmp_path / "documents.parquet"))
    spark.sql("SELECT id AS item_id, concat('b d', id, ' e e zz') AS text FROM range(9)").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = connect(str(tmp_path))
    for name in ("r10_per_source_topk", "bm25_topk"):
        assert_same(QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(ORACLE_SQL[name]).df())


def test_parts_hold_about_as_many_terms(monkeypatch):
    monkeypatch.setattr(retrieval, "PART_TERMS", 5)
    assert list(retrieval._parts(np.array([1, 4, 9, 0, 0, 5, 1]))) == [(0, 2), (2, 3), (3, 6), (6, 7)]
    assert list(retrieval._parts(np.array([], int))) == []


def test_documents_become_objects_a_few_at_a_time(spark):
    batch = pa.RecordBatch.from_pydict({"i": list(range(500)), "t": ["A b. " * 30] * 500})
    assert [len(b) for b in segments._some(iter([batch, batch.slice(0, 3)]))] == [64] * 7 + [52, 3]
    rows = spark.range(300).selectExpr("IF(id % 7 = 0, NULL, id) AS i", "IF(id % 5 = 0, NULL, repeat('ab. cd ', int(id))) AS t")
    got = segments.recursive_chunks(rows.where("i IS NOT NULL"), "i", "t", 100, 0).groupBy("i").agg(F.sum(F.length("piece")).alias("n"))
    assert {(r.i, r.n) for r in got.collect()} == {(i, 7 * i) for i in range(1, 300) if i % 7 and i % 5}


def test_an_encoder_sees_a_few_texts_at_a_time(spark):
    class ShortCalls:
        """An encoder that refuses long calls."""

        def __call__(self, texts):
            if len(texts) > 256:
                raise ValueError("too many texts")
            return [[3.0 * len(t), 4.0 * len(t)] for t in texts]

    rows = spark.range(0, 1000, 1, 1).selectExpr("id", "IF(id % 10 = 0, NULL, 'x') AS text")
    got = workflow.embed(rows, "text", ShortCalls, 2).collect()
    assert len(got) == 1000 and all([round(x, 4) for x in r.embedding] == ([0.6, 0.8] if r.text else [0, 0]) for r in got)


def test_only_texts_with_an_ampersand_pass_through_python(spark, monkeypatch):
    @F.pandas_udf("string")
    def strict(t: pd.Series) -> pd.Series:
        assert t.dropna().str.contains("&").all()
        return t.map(html.unescape, na_action="ignore")

    monkeypatch.setattr(text, "unescape_html", strict)
    rows = spark.createDataFrame([("a &lt; b",), ("plain",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.clean_text(F.col("t"))).collect()] == ["a < b", "plain", ""]


def test_an_interval_holds_no_value_table_whole(spark):
    values = spark.range(1001).selectExpr("IF(id % 10 = 3, NULL, int(id * id % 389)) AS v")
    got = statistics.interval(values, "v")
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()
    known = [r.v for r in values.collect() if r.v is not None]
    for part in (known, known[:1], []):
        some = spark.createDataFrame([(v,) for v in part] + [(None,)], "v int")
        want = [round(float(x), 6) for x in np.percentile(part, [2.5, 97.5])] if part else [None, None]
        assert list(statistics.interval(some, "v").first()) == want


def test_override_by_equal_prices(spark, tmp_path):
    spark.sql("SELECT id AS o_orderkey, 'p' AS o_orderpriority FROM range(50)").write.parquet(str(tmp_path / "orders.parquet"))
    lines = "SELECT id % 40 AS l_orderkey, double(id div 80 % 3) AS l_extendedprice, 31.0D AS l_quantity, timestamp_seconds(id * 86400) AS l_shipdate FROM range(0, 3000, 1, 1)"
    spark.sql(lines).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = connect(str(tmp_path))
    con.execute("SET threads = 1")
    assert_same(QUERIES["j3_override_last"](spark, str(tmp_path)).toPandas(), con.execute(ORACLE_SQL["j3_override_last"]).df())


def shuffled_rows(df):
    """Rows that the exchanges of a plan have written, after it ran."""
    def walk(node):
        kids, name = node.children(), node.nodeName()
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else []
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
        return own + sum(walk(k) for k in [kids.apply(i) for i in range(kids.size())] + inner)

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_bm25_index_of_repeated_ids(spark, tmp_path):
    """Rows of one id, or of none, are one document, as in SQL."""
    rows = [(1, "a b b"), (1, "b c"), (2, "a"), (None, "a c"), (None, "c"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = QUERIES["r1_bm25_index"](spark, str(tmp_path))
    assert_same(got.toPandas(), connect(str(tmp_path)).execute(ORACLE_SQL["r1_bm25_index"]).df())


def test_bm25_index_shuffles_no_row_for_each_posting(spark, tmp_path):
    spark.range(0, 3000, 1, 4).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 49), x -> 'w' || (id * 7 + x) % 90)) AS text").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["r1_bm25_index"](spark, str(tmp_path))
    assert got.count() == 90 and shuffled_rows(got) < 3000


def test_saved_bm25_shuffles_no_row_for_each_question_and_document(spark, tmp_path):
    docs = spark.range(0, 2000, 1, 4).selectExpr("id AS idx", "concat_ws(' ', transform(sequence(0, 9), x -> 'w' || (id * 7 + x * x) % 30)) AS text")
    asked = spark.range(40).selectExpr("id AS q", "concat('w', id % 30, ' w', (id + 1) % 30, ' w', (id + 2) % 30, ' w', (id + 3) % 30, ' w', (id + 4) % 30) AS question")
    sinks.save_bm25(docs, str(tmp_path / "i"), "idx", "text")
    got = sinks.search_bm25(spark, str(tmp_path / "i"), asked)
    assert got.count() == 200 and shuffled_rows(got) < 30_000
    assert_same(got.select("q", "idx", "score", "rank").toPandas(), retrieval.bm25_search(docs, asked).select("q", "idx", "score", "rank").toPandas())
