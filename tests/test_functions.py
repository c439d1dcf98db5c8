"""Hand-worked rows for functions and operators, the traps among them."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarrystone.functions import ids, projection
from quarrystone.functions import text as X
from quarrystone.operators import evidence, memory, model, records, retrieval, segments, statistics
from quarrystone.streaming import events


def value(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], list(row)) if row else spark.range(1)
    return df.select(column).first()[0]


def text(spark, f, t):
    return spark.createDataFrame([(t,)], "t string").select(f(F.col("t"))).first()[0]


def test_tokens(spark):
    assert text(spark, X.tokenize, "Follow-up of the patient's X-ray-2, é") == ["follow-up", "of", "the", "patient's", "x-ray", "2"]


def test_clean_text_order(spark):
    assert text(spark, X.clean_text, " A &amp; B\r\nhyphen- ated ( firstline ) , end ") == "A & B hyphenated (first-line), end"
    assert text(spark, X.clean_text, None) == ""


def test_numbered_items_drop_the_lead_in(spark):
    assert text(spark, X.split_numbered, "Lead 1. Take rest 2. Drink 3.5 litres") == ["1. Take rest", "2. Drink 3.5 litres"]
    assert text(spark, X.split_numbered, "nothing numbered") == ["nothing numbered"]
    assert text(spark, X.split_numbered, "") == []


def test_json_object(spark):
    assert text(spark, X.json_object, 'x ```json\n{"a": {"b": 1}}\n```') == '{"a": {"b": 1}}'
    assert text(spark, X.json_object, "none") is None
    assert text(spark, X.json_object, "{broken") is None


def test_tags_and_lines(spark):
    assert text(spark, lambda c: X.tagged_lines(c, "q"), "<q>a\n\n b</q> <q>c</q>") == ["a", "b", "c"]


def test_bricks(spark):
    assert text(spark, X.apply_bricks, "‘é’  a\nb\n\nc") == "'' a b c"
    assert text(spark, lambda c: X.apply_bricks(c, [("clean_prefix", {"pattern": "SUMMARY"}), ("clean_trailing_punctuation", {})]), "SUMMARY: good.") == "good"
    with pytest.raises(ValueError, match="no cleaner"):
        X.apply_bricks(F.lit(""), [("unknown", {})])


def test_extractors(spark):
    assert text(spark, lambda c: X.extract_all(c, "email"), "a.b@c.org, x@y") == ["a.b@c.org"]
    assert text(spark, lambda c: X.extract_all(c, "datetime"), "Fri, 26 Mar 2021 11:04:09 +1200") == ["Fri, 26 Mar 2021 11:04:09 +1200"]
    assert text(spark, X.ordered_bullet, "1.2.b next") == ["1", "2", "b"]


def test_postfix_of_a_known_comparator(spark):
    assert text(spark, ids.comparator_postfix, "continue DMARDs at the same doses") == "_c590558"


def test_uid_needs_something(spark):
    none = F.lit(None).cast("string")
    assert value(spark, ids.paper_uid(none, none, none, none)) is None


def test_pico_scalar_outcome(spark):
    got = text(spark, projection.normalize_pico, '{"O": {"a": "x", "b": null, "c": " "}}')
    assert got.O == {"a": ["x"], "b": [], "c": []} and got.P == "" and got.C == []


def test_judge_without_yes_has_no_answer(spark):
    got = text(spark, projection.judge, '{"decision": "perhaps", "candidate_based_brief_answer": "x", "supporting_candidate_ranks": [1, null, "2"]}')
    assert (got.decision, got.answer, got.ranks) == ("no", "", [1, 2])
    assert text(spark, projection.judge, '{"decision": false}').decision == "no"


def test_truncate(spark):
    assert text(spark, lambda c: X.truncate(c, 3), "ab cd") == "ab...[truncated]"
    assert text(spark, lambda c: X.truncate(c, 0), "ab cd") == "ab cd"


def test_bm25_returns_documents_of_score_zero(spark):
    docs = spark.createDataFrame([(1, "x y"), (2, "z"), (3, "")], "idx int, text string")
    asked = spark.createDataFrame([(1, "z z"), (2, "nothing")], "q int, question string")
    got = {(r.q, r.rank): (r.idx, r.score) for r in retrieval.bm25_search(docs, asked, 3).collect()}
    assert [got[1, k][0] for k in (1, 2, 3)] == [2, 1, 3] and [got[2, k] for k in (1, 2, 3)] == [(1, 0.0), (2, 0.0), (3, 0.0)]
    # n = 3, df = 1, avgdl = 1: idf ln(2.5 / 1.5), tf part 2.5 / 2.5, the query's term twice
    assert got[1, 1][1] == pytest.approx(2 * 0.510826, abs=1e-5)


def test_constant_lists(spark):
    scores = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.0), (2, 1, 3.0)], "q int, idx int, score double")
    assert [r.norm for r in retrieval.min_max(scores).orderBy("q", "idx").collect()] == [1, 1, 1]
    assert [r.norm for r in retrieval.min_max(scores, "sign").orderBy("q", "idx").collect()] == [0, 0, 1]


def test_fusion_ties_go_to_the_lower_index_and_scores_stay_in_range(spark):
    dense = spark.createDataFrame([(1, 5, 0.9), (1, 7, 0.1)], "q int, idx int, score double")
    sparse = spark.createDataFrame([(1, 7, 4.0), (1, 9, 2.0)], "q int, idx int, score double")
    got = [(r.idx, r.score) for r in retrieval.fuse(dense, sparse, 3).orderBy("rank").collect()]
    assert got == [(5, 0.6), (7, 0.4), (9, 0.0)]


def test_pair_similarity(spark):
    df = spark.createDataFrame([("aa bb", "aa bb"), ("aa bb", "aa cc"), ("a", "!"), ("aa", "bb")], "a string, b string")
    got = [r[0] for r in df.select(*[retrieval.text_terms(F.col(c)).alias(c) for c in "ab"]).select(retrieval.pair_similarity(F.col("a"), F.col("b"))).collect()]
    apart = 1 + 0.4054651081
    assert got[0] == pytest.approx(1) and got[1] == pytest.approx(1 / (1 + apart**2)) and got[2] is None and got[3] == 0


def test_invalid_first_copy_takes_its_later_copies(spark):
    rows = spark.createDataFrame([("p", "a", ["Review"], 1), ("p", "a", ["Trial"], 2), ("q", "", None, 3), ("r", None, None, 4)], "i string, abstract string, types array<string>, at int")
    assert [r.i for r in records.searchable(rows, "i", "abstract", "types", ["Review"], "at").collect()] == ["q"]


def test_vote_threshold_is_checked(spark):
    with pytest.raises(ValueError, match="threshold"):
        records.included_by_votes(spark.range(1), ["id"], "v", 4, 3)


def test_budget_marks_groups_that_cannot_fit(spark):
    units = spark.createDataFrame([(1, 1, 1.0, 50), (1, 2, 0.9, 30), (2, 1, 0.5, 30), (2, 2, 0.9, 20)], "g int, i int, score double, tokens int")
    got = {(r.g, r.i): r.over_budget for r in memory.token_budget(units, ["g"], "i", "i", "score", "tokens", 40).collect()}
    assert got == {(2, 2): False}


def test_decay_counts_only_other_turns(spark):
    turns = spark.createDataFrame([(1, 1, "system"), (1, 2, "user"), (1, 3, "assistant")], "g int, t int, role string")
    got = [r.score for r in memory.decay_scores(turns, ["g"], "t", F.col("role") == "system").orderBy("t").collect()]
    assert got == pytest.approx([1.0, 0.81, 0.9])


def test_recommendation_spans(spark):
    t = "Intro Recommendation 1.2 Do x [QoE: High] more text. Comment: no Recommendation 1.3 Do y Statement 4.1 z"
    assert text(spark, segments.recommendation_spans, t) == ["Recommendation 1.2 Do x [QoE: High]", "Recommendation 1.3 Do y"]
    assert text(spark, segments.recommendation_spans, "Statement 1.1 Unclear [No recommendation] x") == ["Statement 1.1 Unclear [No recommendation]"]


def test_keyword_sections(spark):
    t = "1.1 We recommend A. #QoE high# rest 1.2 Nothing said 1.3 It is suggested B Discussion long 1.1 We recommend again"
    assert text(spark, segments.keyword_sections, t) == {"1.1": "1.1 We recommend A. #QoE high#", "1.3": "1.3 It is suggested B"}


def test_krippendorff_of_full_agreement_and_a_known_case(spark):
    same = spark.createDataFrame([(u, v) for u, v in enumerate([1, 2, 3]) for _ in range(3)], "u int, v int")
    assert statistics.krippendorff(same, "u", "v").first()[0] == 1.0


def test_impossible_totals_raise(spark):
    totals = spark.createDataFrame([(5, 8, 7, 9)], "tp int, p int, pp int, n int")
    with pytest.raises(PySparkException):
        statistics.label_vectors(totals).collect()


def test_no_items_have_no_rank(spark):
    empty = spark.createDataFrame([], "t int, c array<int>")
    assert list(statistics.ranking_metrics(empty, "t", "c").first()) == [0, 0.0, 0.0, 0.0, 0.0]


def test_model_map_asks_each_prompt_once_and_keeps_errors(spark):
    rows = spark.createDataFrame([(1, "1|a"), (2, "1|a"), (3, "7|b")], "i int, p string")
    got = {r.i: (r.response, r.error) for r in model.model_map(rows, "p", model.EchoLength).collect()}
    assert got == {1: ("1", None), 2: ("1", None), 3: (None, "refused")}


def test_graph_links_need_both_nodes(spark):
    t = "Node(id='a', type='X')\nRelationship(subj=Node(id='a', type='X'), obj=Node(id='b', type='X'), type='R')"
    got = text(spark, evidence.graph_elements, t)
    assert got.nodes == ["a"] and got.links == []


def test_streaming_totals_equal_the_batch(spark, sf, tmp_path):
    path = f"{sf}/events.parquet"
    batch = spark.read.parquet(path)
    (tmp_path / "in").mkdir()
    batch.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = events.windowed_totals(events.read(spark, str(tmp_path / "in"), batch.schema), "1 day")
    run = stream.writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = sorted(map(tuple, events.windowed_totals(batch, "1 day").collect()))
    assert sorted(map(tuple, spark.table("totals").collect())) == want


def test_dense_search_in_blocks(spark):
    rows = [(k, [float(k % 7), float(k % 5), 1.0]) for k in range(60)] + [(60, None), (61, [1.0, None, 1.0]), (62, [1.0, 1.0]), (63, [0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "idx int, v array<float>")
    queries = spark.createDataFrame([(k, [float(k), 2.0, 1.0]) for k in range(5)] + [(5, None), (6, [0.0, 0.0, 0.0])], "q long, v array<float>")
    for kind in ("cosine", "dot", "euclid", "manhattan"):
        whole, cut = ({(r.q, r["rank"]): (r.idx, r.score) for r in retrieval.dense_search(vectors, queries, 4, kind, **sizes).collect()} for sizes in ({}, {"block_rows": 7, "block_queries": 2}))
        assert whole == cut and len(whole) == 24
    assert [retrieval.dense_search(vectors, queries, 1, "manhattan").where(f"q = {k}").first().idx for k in range(5)] == [7, 22, 2, 17, 32]
    assert retrieval.dense_search(vectors.where("idx < 0"), queries).count() == 0
    with pytest.raises(ValueError):
        retrieval.dense_search(vectors, queries, kind="none")


def test_holding_finds_what_contains_finds(spark):
    texts = ["a b c d e f", "xa b c d ex", "a b  c d e", "b c d", "", None, "a b c d e\na b c d e", "  a b c d e  "]
    passages = ["a b c d e", "b c d", " b c d ", "c", "", None, "a b c d e f g", "d e\na b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "idx int, text string")
    asked = spark.createDataFrame(list(enumerate(passages)), "q int, question string")
    got = sorted(map(tuple, retrieval.holding(docs, asked).collect()))
    assert got == [(q, k) for q, p in enumerate(passages) for k, t in enumerate(texts) if p is not None and t is not None and p in t]


def test_numbered_over_many_ranges(spark):
    rows = spark.range(1000).repartition(5).withColumn("x", (F.col("id") * 7919) % 1000)
    got = {r.x: r.n for r in records.numbered(rows, F.col("x")).collect()}
    assert got == {x: x + 1 for x in range(1000)}
    assert records.numbered(rows.where("x < 0"), F.col("x")).count() == 0


def test_recommendations_are_cleaned_and_kept_once(spark):
    t = "Recommendation 1.2 Use\nfirstline ( A ) [QoE: Low] x Recommendation 1.2 Use firstline (A) [QoE: Low] y"
    assert text(spark, segments.recommendation_spans, t) == ["Recommendation 1.2 Use first-line (A) [QoE: Low]"]
    assert text(spark, segments.recommendation_spans, None) == []


def test_a_graded_span_has_to_recommend(spark):
    t = "1.1 Graded SoR 2.1 References we recommend 3.1 Early is preferred SoR 4.1 We recommend B Discussion C"
    assert text(spark, segments.keyword_sections, t) == {"3.1": "3.1 Early is preferred SoR", "4.1": "4.1 We recommend B"}


def test_page_recommendations_end_with_the_last_page(spark):
    rows = [("d", 1, 0, "1.1 We recommend A &amp;"), ("d", 2, 1, "B. 2.1 We suggest\nC"), ("d", 3, 20, "3.1 We recommend D"), ("e", 1, 30, "1.1 We recommend E"), (None, 1, 2, None)]
    blocks = spark.createDataFrame(rows, "doc string, k int, page int, t string")
    got = {(r.doc, r.number): r.text for r in segments.page_recommendations(blocks, "doc", "page", "k", "t").collect()}
    assert got == {("d", "1.1"): "1.1 We recommend A & B.", ("d", "2.1"): "2.1 We suggest C"}


def test_chunks_by_title(spark):
    rows = [("d", 1, True, "T1"), ("d", 2, False, "a" * 8), ("d", 3, False, "b" * 8), ("d", 4, True, "T2"), ("d", 5, False, "c"), ("d", 6, True, "T3"), ("d", 7, False, "one two three four five six"), ("d", 8, None, None), ("e", 1, False, " "), (None, 1, None, "x" * 25)]
    elements = spark.createDataFrame(rows, "doc string, k int, title boolean, t string")
    got = segments.chunk_by_title(elements, "doc", "k", F.col("title"), "t", 20).orderBy("doc", "chunk").collect()
    # a section is cut where it would grow too long; small sections share a chunk, up to 19 characters here
    assert [(r.doc, r.chunk, r.piece) for r in got] == [(None, 0, "x" * 20), (None, 1, "x" * 5), ("d", 0, "T1\n\n" + "a" * 8), ("d", 1, "b" * 8 + "\n\nT2\n\nc\n\nT3"), ("d", 2, "one two three four"), ("d", 3, "five six")]


def test_pooled_interval_is_that_of_all_replicates(spark):
    import numpy as np

    rows = spark.createDataFrame([(e, k, int((k + e) % 3 > 0)) for e in range(3) for k in range(20 + 10 * e)], "e int, k int, x int")
    value = F.sum(F.col("x") * F.col("copies")) / F.sum("copies")
    low, high = statistics.pooled_interval(rows, "e", ["k", "x"], value, 50).first()
    drawn = statistics.resampled(rows, ["k", "x"], ["e"], 50).toPandas()
    means = [np.average(g.x, weights=g.copies) for _, g in drawn.groupby(["e", "replicate"])]
    assert len(means) == 150 and [low, high] == pytest.approx(np.percentile(means, [2.5, 97.5]), abs=1e-6)
