"""Projection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import nested as N
from quarrystone.functions import projection as P
from quarrystone.functions import text as X

from .base import Queries, declare, table

queries: Queries = {}
query = declare(queries)


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as question frames in three written forms."""
    name, key = F.col("s_name"), F.col("s_suppkey")
    plain = F.concat(F.lit('{"P": " adults ", "I": "'), name, F.lit('", "C": ["a", " ", "b"], "O": {"a": "pain", "b": ["x", ""], " ": "gone", "c": null}}'))
    wrapped = F.concat(F.lit('{"pico": {"P": "children", "I": "'), name, F.lit('", "C": "placebo", "O": {"placebo": ["death"]}}}'))
    listed = F.concat(F.lit('[{"pico": {"P": "all", "I": "'), name, F.lit('"}}]'))
    text = F.when(key % 3 == 0, plain).when(key % 3 == 1, wrapped).otherwise(listed)
    return table(spark, sf, "supplier").select("s_suppkey", "s_name", text.alias("json"))


_KIND = "CASE s_suppkey % 3 WHEN 0 THEN {} WHEN 1 THEN {} ELSE {} END"
_FRAME = "SELECT s_suppkey, " + _KIND.format("'adults'", "'children'", "'all'") + " AS p, s_name AS i, " + _KIND.format("'a;b'", "'placebo'", "''") + " AS c, "


@query("p1_normalize_pico", _FRAME + _KIND.format("'a=pain;b=x;c='", "'placebo=death'", "''") + " AS o FROM supplier")
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _frame_columns(spark, sf, keep_empty=True)


@query("p2_pico_without_empty", _FRAME + _KIND.format("'a=pain;b=x'", "'placebo=death'", "''") + " AS o FROM supplier")
def without_empty(spark: SparkSession, sf: str) -> DataFrame:
    return _frame_columns(spark, sf, keep_empty=False)


def _frame_columns(spark: SparkSession, sf: str, keep_empty: bool) -> DataFrame:
    n = _frames(spark, sf).select("s_suppkey", P.normalize_pico(F.col("json"), keep_empty).alias("n"))
    pairs = F.transform(F.array_sort(F.map_entries("n.O")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))
    return n.select("s_suppkey", F.col("n.P").alias("p"), F.col("n.I").alias("i"), F.array_join("n.C", ";").alias("c"), F.array_join(pairs, ";").alias("o"))


@query("p3_query_text", "SELECT s_suppkey, 'question: Which ' || s_name || '?' || chr(10) || 'pico: ' || " + _KIND.format(
    """'{"C": ["a", "b"], "I": "' || s_name || '", "O": {"a": ["pain"], "b": ["x"], "c": []}, "P": "adults"}'""",
    """'{"C": ["placebo"], "I": "' || s_name || '", "O": {"placebo": ["death"]}, "P": "children"}'""",
    """'{"C": [], "I": "' || s_name || '", "O": {}, "P": "all"}'""") + " AS query_text FROM supplier")
def query_text(spark: SparkSession, sf: str) -> DataFrame:
    n = _frames(spark, sf).withColumn("n", P.normalize_pico(F.col("json")))
    return n.select("s_suppkey", P.query_text(F.concat(F.lit(" Which "), "s_name", F.lit("? ")), F.col("n")).alias("query_text"))


@query("p4_search_text", "SELECT p_partkey, 'question: ' || p_name || chr(10) || 'disease: ' || p_brand || chr(10) || 'topic: ' || p_type || chr(10) || 'pico: ' || chr(10) || 'synonyms: ' || p_size AS search_text FROM part")
def search_text(spark: SparkSession, sf: str) -> DataFrame:
    text = P.search_text(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.lit(None).cast("string"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", text.alias("search_text"))


@query("p5_payload", "SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, '' AS topic FROM documents")
def payload(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.lit(None).cast("string"), F.lit("")).alias("topic"))


@query("p6_truncate", "SELECT doc_id, CASE WHEN length(text) > 80 THEN regexp_replace(substring(text, 1, 80), '[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+$', '') || '...[truncated]' ELSE text END AS short FROM documents")
def truncate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.truncate(F.col("text"), 80).alias("short"))


@query("p7_p20_lists", "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ' | ' ORDER BY l_partkey) FILTER (WHERE rn <= 2) AS answer, greatest(count(*) - 2, 0) AS omitted FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS rn FROM lineitem) GROUP BY l_orderkey")
def lists(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("parts"))
    short = parts.withColumn("c", P.compact_list(F.col("parts"), 2))
    return short.select("l_orderkey", P.format_answer(F.col("c.items").cast("array<string>")).alias("answer"), F.col("c.omitted").cast("long").alias("omitted"))


@query("p8_optional_numbers", "SELECT event_id, try_cast(CASE event_id % 3 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN 'n/a' ELSE NULL END AS BIGINT) AS i, try_cast(CASE event_id % 2 WHEN 0 THEN value::VARCHAR ELSE 'x' END AS DOUBLE) AS f FROM events")
def optional_numbers(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("event_id")
    i = F.when(key % 3 == 0, key.cast("string")).when(key % 3 == 1, "n/a")
    f = F.when(key % 2 == 0, F.col("value").cast("string")).otherwise("x")
    return table(spark, sf, "events").select("event_id", P.optional_int(i).alias("i"), P.optional_float(f).alias("f"))


@query("p9_judge_payload", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'yes' ELSE 'no' END AS decision, CASE c_custkey % 4 WHEN 3 THEN '' ELSE c_name END AS reason, CASE c_custkey % 4 WHEN 0 THEN '1,3' WHEN 2 THEN '2' ELSE '' END AS ranks, CASE WHEN c_custkey % 4 IN (0, 2) THEN c_mktsegment ELSE '' END AS answer FROM customer")
def judge(spark: SparkSession, sf: str) -> DataFrame:
    name, segment, k = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey") % 4
    a = F.concat(F.lit('{"decision": " YES ", "reason": "'), name, F.lit('", "supporting_candidate_ranks": [1, "x", 3], "answer_basis": "'), segment, F.lit('"}'))
    b = F.concat(F.lit('{"判断": "maybe", "理由": " '), name, F.lit('", "candidate_based_brief_answer": "'), segment, F.lit('"}'))
    c = F.concat(F.lit('{"can_answer": true, "reason": "'), name, F.lit('", "best_candidate_ranks": ["2"], "candidate_based_brief_answer": "'), segment, F.lit('"}'))
    reply = F.when(k == 0, a).when(k == 1, b).when(k == 2, c).otherwise("no JSON")
    rows = table(spark, sf, "customer").select("c_custkey", P.judge(reply).alias("j"))
    return rows.select("c_custkey", "j.decision", "j.reason", F.array_join(F.col("j.ranks").cast("array<string>"), ",").alias("ranks"), "j.answer")


@query("p10_p14_flatten", "SELECT n_nationkey, n_name || ' x y' AS flat, 'a: ' || n_name || chr(10) || 'b: z' || chr(10) AS lines FROM nation")
def flatten(spark: SparkSession, sf: str) -> DataFrame:
    lists = F.create_map(F.lit("k"), F.array("n_name", F.lit("x")), F.lit("l"), F.array(F.lit("y")))
    values = F.create_map(F.lit("b"), F.lit("z"), F.lit("a"), F.col("n_name"))
    return table(spark, sf, "nation").select("n_nationkey", P.flatten_values(lists).alias("flat"), P.key_value_lines(values).alias("lines"))


@query("p11_p12_names", "SELECT c_custkey, split_part('2020-01-' || c_custkey, '-', 1) AS year, trim(regexp_replace(regexp_replace(lower(c_name || '_x-Y  z'), '[_-]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM customer")
def names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", P.publication_year(F.concat(F.lit("2020-01-"), "c_custkey")).alias("year"), X.match_name(F.concat("c_name", F.lit("_x-Y  z"))).alias("name"))


@query("p17_p22_answers", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'brief' ELSE CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END END AS answer, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE '' END AS shown FROM orders")
def answers(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    ranks = F.when(key % 3 == 0, F.array(F.lit(9))).otherwise(F.array(F.lit(9), F.lit(2)))
    brief = F.when(key % 2 == 0, "brief").otherwise(" ")
    got = P.answer_from_candidates(brief, ranks, F.array(F.lit("first"), F.col("o_orderpriority")))
    return table(spark, sf, "orders").select("o_orderkey", got.alias("answer"), P.suppress_answer(F.when(F.col("o_orderstatus") == "O", "yes").otherwise("no"), F.col("o_orderpriority")).alias("shown"))


@query("p18_arithmetic", "SELECT l_orderkey, l_linenumber, (l_orderkey + l_partkey)::BIGINT AS added, (l_orderkey - l_partkey)::BIGINT AS subtracted, (l_orderkey * l_partkey)::BIGINT AS multiplied FROM lineitem")
def arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("l_orderkey"), F.col("l_partkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (a + b).alias("added"), (a - b).alias("subtracted"), (a * b).alias("multiplied"))


@query("p19_nested", """SELECT vec_id, '{"id":' || vec_id || ',"kept":[1,2],"in":{"deep":[["x"]],"none":null}}' AS v FROM embeddings""")
def drop_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Records that hold their embedding at three depths."""
    v = F.struct(F.col("vec_id").alias("id"), F.col("embedding").alias("long"), F.array(F.lit(1), F.lit(2)).alias("kept"), F.struct(F.array(F.array(F.lit("x")), F.col("embedding").cast("array<string>")).alias("deep"), F.lit(None).cast("int").alias("none"), F.col("embedding").alias("more")).alias("in"))
    return table(spark, sf, "embeddings").select("vec_id", N.drop_long_lists_nested(F.to_json(v, {"ignoreNullFields": "false"}), 64).alias("v"))


_CUT = "CASE WHEN length(text) > 40 THEN rtrim(substr(text, 1, 40), ' ' || chr(10)) || '...[truncated]' ELSE text END"


@query("p6_p10_nested", f"SELECT item_id, item_id || ' ' || trim({_CUT}, ' ' || chr(10)) || ' x' AS v FROM benchmark UNION ALL SELECT doc_id, doc_id || ' ' || trim({_CUT}, ' ' || chr(10)) || ' x' FROM documents WHERE trim(text, ' ' || chr(10)) <> ''")
def nested(spark: SparkSession, sf: str) -> DataFrame:
    """Texts inside lists inside objects are cut, and then all of a record becomes one text."""
    rows = table(spark, sf, "benchmark").select("item_id", "text").unionByName(table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text").where(F.trim(F.translate("text", "\n", " ")) != ""))
    v = F.to_json(F.struct(F.col("item_id"), F.struct(F.array(F.lit(""), F.col("text")).alias("b"), F.lit("x").alias("c")).alias("a")))
    return rows.select("item_id", N.nested_text(N.truncate_nested(v, 40)).alias("v"))


@query("p19_drop_long_lists", "SELECT vec_id, CASE WHEN vec_id % 3 > 0 THEN 7 - vec_id % 3 END AS kept FROM embeddings")
def drop_long(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of 7, 6 and 5 values, at the bound and below it."""
    values = F.slice("embedding", F.lit(1), (7 - F.col("vec_id") % 3).cast("int"))
    rows = table(spark, sf, "embeddings").select("vec_id", P.drop_long_lists(values, 7).alias("v"))
    return rows.select("vec_id", F.when(F.col("v").isNotNull(), F.size("v")).alias("kept"))


@query("p13_p23_prompt_tokens", "SELECT doc_id, len(regexp_extract_all(lower('In adults, is ' || lang || ' better than ' || source || '?' || text), '[a-z0-9]+(?:[-''][a-z0-9]+)?')) AS tokens FROM documents")
def prompt_tokens(spark: SparkSession, sf: str) -> DataFrame:
    prompt = F.concat(F.lit("In adults, is "), "lang", F.lit(" better than "), "source", F.lit("?"), "text")
    return table(spark, sf, "documents").select("doc_id", X.token_count(prompt).cast("long").alias("tokens"))
