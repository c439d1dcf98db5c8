"""Window, memory and vector-store queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import memory as M
from quarrystone.operators import retrieval as R

from .base import Queries, declare, table

queries: Queries = {}
query = declare(queries)
_TOKENS = "len(regexp_extract_all(lower(text), '[a-z0-9]+(?:[-''][a-z0-9]+)?'))"


@query("w1_w2_ranks", "SELECT l_orderkey, l_partkey, rank, 1 / rank AS reciprocal FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem) WHERE rank <= 2")
def ranks(spark: SparkSession, sf: str) -> DataFrame:
    top = R.top_k(table(spark, sf, "lineitem"), 2, "l_orderkey", "l_extendedprice", "l_linenumber")
    return top.select("l_orderkey", "l_partkey", "rank", (1 / F.col("rank")).alias("reciprocal"))


@query("w5_decay", "SELECT conv_id, turn, CASE WHEN role = 'system' THEN 1.0 ELSE round(power(0.9, sum(CASE WHEN role = 'system' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn DESC)), 9) END AS score FROM conversations")
def decay(spark: SparkSession, sf: str) -> DataFrame:
    scored = M.decay_scores(table(spark, sf, "conversations"), ["conv_id"], "turn", F.col("role") == "system")
    return scored.select("conv_id", "turn", F.round("score", 9).alias("score"))


@query("w6_last_n", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def last_n(spark: SparkSession, sf: str) -> DataFrame:
    return M.last_n(table(spark, sf, "conversations"), ["conv_id"], "turn", 3).select("conv_id", "turn")


@query("w7_token_budget", f"""WITH t AS (SELECT conv_id, turn, {_TOKENS} AS tokens, CASE WHEN role = 'system' THEN 1.0 ELSE power(0.9, sum(CASE WHEN role = 'system' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn DESC)) END AS score FROM conversations),
d AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) - (sum(tokens) OVER (PARTITION BY conv_id ORDER BY score, turn ROWS UNBOUNDED PRECEDING) - tokens) > 150 AS gone FROM t)
SELECT conv_id, turn, tokens FROM d WHERE NOT gone""")
def budget(spark: SparkSession, sf: str) -> DataFrame:
    from quarrystone.functions.text import token_count

    scored = M.decay_scores(table(spark, sf, "conversations"), ["conv_id"], "turn", F.col("role") == "system").withColumn("tokens", token_count(F.col("text")).cast("long"))
    return M.token_budget(scored, ["conv_id"], "turn", "turn", "score", "tokens", 150).select("conv_id", "turn", "tokens")


@query("u10_merge_context", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY part, turn) AS position FROM (SELECT conv_id, turn, CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN 0 ELSE 2 END AS part FROM conversations UNION ALL SELECT conv_id, turn + 100, 1 FROM conversations WHERE turn = 1)")
def merge(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    hits = c.where("turn = 1").withColumn("turn", F.col("turn") + 100)
    return M.merge_context(c, hits, ["conv_id"], "turn").select("conv_id", "turn", "position")


@query("o5_merge_results", "SELECT idx, score FROM (SELECT idx, max(score) AS score FROM (SELECT l_partkey AS idx, round(l_discount, 6) AS score FROM lineitem WHERE l_quantity > 49) GROUP BY idx) ORDER BY score DESC, idx LIMIT 20")
def merge_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results of several contents, the best score of each, ordered as numbers and capped: a top-k report."""
    got = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("idx"), F.round("l_discount", 6).alias("score"))
    return got.groupBy("idx").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "idx").limit(20)


@query("k7_k11_vector_store", "SELECT vec_id, CASE WHEN vec_id % 10 = 1 THEN -1 ELSE label END AS label FROM embeddings WHERE NOT (vec_id % 10 = 0 OR label = 5)")
def vector_store(spark: SparkSession, sf: str) -> DataFrame:
    """Delete by ids and by payload, then a payload update, as one plan."""
    from quarrystone.sources import vectors as V

    store = table(spark, sf, "embeddings").select("vec_id", "label")
    gone = store.where("vec_id % 10 = 0").select("vec_id")
    rest = V.delete(store, "vec_id", ids=gone, payload={"label": 5})
    new = rest.where("vec_id % 10 = 1").select("vec_id", F.lit(-1).alias("label"))
    return V.update_payload(rest, new, "vec_id", ["label"])


@query("k11_status", "SELECT count(*) AS vectors, max(len(embedding))::INT AS dimension FROM embeddings")
def status(spark: SparkSession, sf: str) -> DataFrame:
    from quarrystone.sources import vectors as V

    return V.status(table(spark, sf, "embeddings"), "embedding")


@query("m_model_map", "SELECT item_id, length(text) AS answer, CASE WHEN item_id % 7 = 0 THEN 'refused' END AS error FROM benchmark WHERE item_id % 7 <> 0 UNION ALL SELECT item_id, NULL, 'refused' FROM benchmark WHERE item_id % 7 = 0")
def model_map(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in model over prompts, some of them answered from a cache, some refused."""
    from quarrystone.operators import model as L

    prompts = table(spark, sf, "benchmark").select("item_id", F.concat("item_id", F.lit("|"), "text").alias("prompt"))
    cache = prompts.where("item_id % 5 = 0 AND item_id % 7 <> 0").select(L.prompt_key("prompt").alias("key"), (F.length("prompt") - F.locate("|", F.col("prompt"))).cast("string").alias("response"))
    out = L.model_map(prompts, "prompt", L.EchoLength, cache=cache, concurrency=2)
    return out.select("item_id", F.col("response").cast("long").alias("answer"), "error")


@query("x_events_per_hour", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_per_hour(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form of the streaming extension's windowed totals."""
    from quarrystone.streaming.events import windowed_totals

    return windowed_totals(table(spark, sf, "events"), "1 hour").select(F.col("start").alias("hour"), "event_type", "n", "total")
