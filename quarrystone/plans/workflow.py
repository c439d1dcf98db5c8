"""Model-step queries with stand-in clients: only the deterministic envelope is compared."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.projection import normalize_pico
from quarrystone.functions.text import tokenize
from quarrystone.operators import workflow as W
from quarrystone.operators.model import model_batches

from .base import Queries, declare, table

queries: Queries = {}
query = declare(queries)


class FrameClient:
    """Names the interventions of a question frame by the words of the prompt."""

    def __call__(self, prompt: str) -> str:
        key, _, name = prompt.partition("|")
        if int(key) % 5 == 0:
            return "I cannot."
        return "```json\n" + json.dumps({"pico": {"P": "adults", "I": name, "C": "none", "O": {"none": ["death", " "]}}, "synonyms": {"x": [name, name]}}) + "\n```"


class VoteClient:
    """Includes a paper by a rule on its key and run."""

    def __call__(self, prompt: str) -> str:
        run, key, *_ = prompt.removeprefix("run ").split("|")
        return f"<verdict>{'Included' if (int(key) * 7 + int(run) * 3) % 5 < 2 else 'Excluded'}</verdict>"


class AbstractClient:
    """Finds an answer in prompts with an even key only, or in any full text."""

    def __call__(self, prompt: str) -> str:
        kind, key, *_ = prompt.split("|")
        return f"{kind} {key}" if kind == "full" or int(key) % 2 == 0 else W.FAILURE


class LengthClient:
    def __call__(self, prompt: str) -> str:
        return str(-len(prompt))


@query("m1_decompose", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS intervention, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'none' END AS comparator FROM supplier")
def decompose(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select("s_suppkey", F.concat("s_suppkey", F.lit("|"), "s_name").alias("prompt"))
    out = W.decompose(rows, "prompt", FrameClient)
    return out.select("s_suppkey", F.col("pico.I").alias("intervention"), F.array_join("pico.C", ",").alias("comparator"))


@query("m2_enrich", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 END AS synonyms, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'death' END AS outcome FROM supplier")
def enrich(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select("s_suppkey", F.concat("s_suppkey", F.lit("|"), "s_name").alias("prompt"))
    out = W.enrich(rows, "prompt", FrameClient)
    return out.select("s_suppkey", F.coalesce(F.size(F.try_element_at("synonyms", F.lit("x"))), F.lit(0)).alias("synonyms"), F.array_join(F.flatten(F.map_values("pico.O")), ",").alias("outcome"))


class FrameBatches:
    """Answers lists of prompts as FrameClient does one by one, but fails on a list with a key that ends in 3."""

    def __call__(self, prompts: list[str]) -> list[str]:
        if any(p.partition("|")[0].endswith("3") for p in prompts):
            raise ValueError("refused")
        return [FrameClient()(p) for p in prompts]


@query("m2_batches", "SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 3 THEN 'refused' END AS error, CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 10 = 3 THEN '' ELSE 'death' END AS outcome FROM supplier")
def batches(spark: SparkSession, sf: str) -> DataFrame:
    """Eight prompts a call; a call that fails is split until only the bad rows have failed."""
    rows = table(spark, sf, "supplier").select("s_suppkey", F.concat("s_suppkey", F.lit("|"), "s_name").alias("prompt"))
    out = W.enrich(rows, "prompt", FrameBatches, model_batches, size=8)
    return out.select("s_suppkey", "error", F.array_join(F.flatten(F.map_values("pico.O")), ",").alias("outcome"))


@query("m3_route", "SELECT s_suppkey, 'no' AS decision, CASE WHEN s_suppkey % 5 = 0 THEN 'no JSON object' END AS error FROM supplier")
def route(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select("s_suppkey", F.concat("s_suppkey", F.lit("|"), "s_name").alias("prompt"))
    return W.route(rows, "prompt", FrameClient).select("s_suppkey", "judge.decision", "error")


@query("m4_screen", "SELECT doc_id, count(*) FILTER (WHERE (doc_id * 7 + run * 3) % 5 < 2) AS included_num, count(*) AS runs FROM labels, range(1, 4) t(run) WHERE quality = 1 GROUP BY doc_id HAVING included_num >= 2")
def screen(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs over the documents that a label does not rule out."""
    judged = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("title"))
    return W.screen(docs, "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.col("title")), VoteClient, judged_keys=judged)


@query("m5_short_circuit", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'abstract ' ELSE 'full ' END || p_partkey AS answer FROM part")
def short_circuit(spark: SparkSession, sf: str) -> DataFrame:
    """The abstract first; only papers without an answer there cost a second call."""
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("abstract|"), "p_partkey").alias("a"), F.concat(F.lit("full|"), "p_partkey").alias("f"))
    return W.extract_first(rows, ["a", "f"], AbstractClient).select("p_partkey", "answer")


class ThirdClient:
    """Answers with the number that the context begins with if three divides it."""

    def __call__(self, prompt: str) -> str:
        number = prompt.split("\n")[0]
        return number if number and int(number) % 3 == 0 else W.FAILURE


class WordWriter:
    """Two words to look for after each round."""

    def __call__(self, prompt: str) -> str:
        return {"1": "und\n die\n", "2": "the\nque\n\nthe"}[prompt.partition("|")[0]]


@query("m5_retrieve_and_ask", """WITH w AS (SELECT * FROM (VALUES (1, 0, 'that'), (2, 0, 'und'), (2, 1, 'die'), (3, 0, 'the'), (3, 1, 'que')) t(round, n, word)),
t AS (SELECT DISTINCT source, doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[-''][a-z0-9]+)?')) AS word FROM documents WHERE source IS NOT NULL),
c AS (SELECT source, round, n, min(doc_id) AS doc_id FROM t JOIN w ON t.word = w.word GROUP BY source, round, n),
g AS (SELECT source, round, min(n) AS n, doc_id FROM c WHERE doc_id % 3 = 0 GROUP BY source, round, doc_id),
a AS (SELECT source, round, string_agg(doc_id::VARCHAR, ',' ORDER BY n) AS answers FROM g GROUP BY source, round QUALIFY row_number() OVER (PARTITION BY source ORDER BY round) = 1)
SELECT s.source, coalesce(answers, '') AS answers, round FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) s LEFT JOIN a ON s.source = a.source""")
def retrieve_and_ask(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as papers: the first document with a query's word is the context; open ones look for other words in up to three rounds."""
    docs = table(spark, sf, "documents").where("source IS NOT NULL").select("source", "doc_id", "text")
    words = docs.select("source", "doc_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("query"))

    def retrieve(asked: DataFrame) -> DataFrame:
        first = words.join(asked.select("query").distinct(), "query", "left_semi").groupBy("source", "query").agg(F.min("doc_id").cast("string").alias("context"))
        return asked.join(first, ["source", "query"], "left")

    papers = docs.select("source", F.lit("that").alias("question")).distinct()
    return W.retrieve_and_ask(papers, "source", "question", ThirdClient, retrieve, WordWriter).select("source", F.array_join("answers", ",").alias("answers"), "round")


@query("m6_bias", "SELECT s_suppkey, count(*) AS questions, CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN -1 WHEN 2 THEN -2 END AS steps FROM supplier, range(6) GROUP BY s_suppkey")
def bias(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    asked = W.bias_prompts(rows, {f"d{k}": f"question {k}" for k in range(6)}, "s_name")
    rating = F.element_at(F.array(F.lit("Not serious"), F.lit("SERIOUS"), F.lit(" very-serious "), F.lit("?")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return asked.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("questions")).withColumn("steps", W.grade_steps(rating))


class YesClient:
    """Yes to questions with an even length of the prompt; refuses papers whose title ends in 7."""

    def __call__(self, prompt: str) -> str:
        if prompt.split("\n")[0].endswith("7"):
            raise ValueError("refused")
        return "yes" if len(prompt) % 2 == 0 else "no"


class YesJudge:
    """A rating by the number of answers that are yes."""

    def __call__(self, prompt: str) -> str:
        return f"<option>{('Not serious', 'Serious', 'Very serious', 'Unclear')[prompt.count(': yes') % 4]}</option>"


@query("m6_rating", """WITH a AS (SELECT s_nationkey, s_name LIKE '%7' AS refused, (length(s_name) + 12) % 2 = 0 AS yes FROM supplier, range(6)),
g AS (SELECT s_nationkey, count(*) FILTER (WHERE refused) AS failed, (count(*) FILTER (WHERE yes AND NOT refused)) % 4 AS y FROM a GROUP BY s_nationkey)
SELECT s_nationkey, CASE y WHEN 0 THEN 'Not serious' WHEN 1 THEN 'Serious' WHEN 2 THEN 'Very serious' END AS rating, CASE y WHEN 0 THEN 0 WHEN 1 THEN -1 WHEN 2 THEN -2 END AS steps, failed FROM g""")
def rating(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as papers of a nation, six questions each, one rating a nation."""
    rows = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_name")
    return W.bias_rating(rows, "s_nationkey", "s_suppkey", "s_name", {f"d{k}": f"question {k}?" for k in range(6)}, YesClient, YesJudge)


class CountClient:
    """The number that the context begins with; fails without one."""

    def __call__(self, prompt: str) -> str:
        return str(int(prompt.split("\n")[0]))


class SumClient:
    """Sums the numbers of the lines, each after its paper; prose instead of JSON where a rule or the sum forbids it."""

    def __call__(self, prompt: str) -> str:
        numbers = {line.split(" (")[0]: line.rsplit(": ", 1)[1] for line in prompt.split("\n") if "): " in line}
        total = sum(map(int, numbers.values()))
        return "There are many." if total % 9 == 0 else "```json\n" + json.dumps({"participants": str(total), "by_paper": numbers}) + "\n```"


@query("m9_participants", """WITH p AS (SELECT c_nationkey, c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
g AS (SELECT c_nationkey, count(*) AS studies, count(*) FILTER (WHERE n = 0) AS failed, coalesce(sum(n), 0)::BIGINT AS total, count(*) FILTER (WHERE n > 0) AS papers FROM p GROUP BY c_nationkey)
SELECT c_nationkey, studies, CASE WHEN total % 9 <> 0 THEN total END AS participants, CASE WHEN total % 9 <> 0 THEN papers ELSE -1 END AS papers, failed, CASE WHEN total % 9 = 0 THEN 'no number of participants' END AS error FROM g""")
def participants(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as papers of a nation's outcome, their orders as what they say; the numbers are extracted paper by paper and summed."""
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).cast("string").alias("context"))
    pairs = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_name", F.lit("drug").alias("group"), F.lit("pain").alias("outcome"))
    out = W.participants(pairs, "c_nationkey", "c_custkey", "c_name", "group", "outcome", lambda df: df.join(orders, "c_custkey", "left"), CountClient, SumClient, "Count every patient once.", retries=1)
    return out.select("c_nationkey", "studies", "participants", F.coalesce(F.size("by_paper"), F.lit(-1)).cast("long").alias("papers"), "failed", "error")


@query("m7_m8_cells", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 6 WHEN 1 THEN 4 ELSE 6 END AS cells FROM nation WHERE n_regionkey < 3")
def cells(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("n_regionkey") == 0, "Dichotomous Data").when(F.col("n_regionkey") == 1, "Continuous Data").when(F.col("n_regionkey") == 2, "Time-to-event Data").otherwise("Count Data")
    rows = table(spark, sf, "nation").select("n_nationkey", kind.alias("kind"), F.col("n_name").alias("intervention"), F.lit("placebo").alias("comparator"), F.lit("death").alias("outcome"))
    return W.cell_questions(rows).groupBy("n_nationkey").agg(F.count_distinct("cell").alias("cells"))


class Perturber:
    """Changes the intervention as asked; every third key only at the second attempt, every fifth changes the population too, every seventh never writes JSON."""

    def __call__(self, prompt: str) -> str:
        attempt, key, name = prompt.split("|")
        if int(key) % 7 == 0:
            return "Sorry."
        if int(key) % 3 == 0 and attempt == "0":
            name, new = name, name.upper() + "  "
        else:
            new = f"new {name}"
        return json.dumps({"question": f"What about {new}?", "pico": {"P": "children" if int(key) % 5 == 0 else "adults", "I": new, "C": ["none"], "O": {"none": ["death"]}}})


@query("m12_perturbed", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 THEN 'What about new ' || s_name || '?' END AS question, CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 THEN 'new ' || s_name END AS intervention, CASE WHEN s_suppkey % 7 = 0 THEN 'no JSON object' WHEN s_suppkey % 5 = 0 THEN 'only I may change' END AS error FROM supplier")
def perturbed(spark: SparkSession, sf: str) -> DataFrame:
    """Questions about suppliers whose intervention, and nothing else, is to change."""
    frame = F.concat(F.lit('{"P": "adults", "I": "'), "s_name", F.lit('", "C": ["none"], "O": {"none": ["death"]}}'))
    rows = table(spark, sf, "supplier").select("s_suppkey", normalize_pico(frame).alias("pico"), F.concat("s_suppkey", F.lit("|"), "s_name").alias("prompt"), F.lit("I").alias("component"), F.lit(None).cast("int").alias("place"))
    return W.perturb(rows, "s_suppkey", "pico", "prompt", Perturber, 1).select("s_suppkey", "question", F.col("pico.I").alias("intervention"), "error")


@query("m10_recommend", "SELECT s_nationkey, -(length(string_agg(s_name, chr(10) ORDER BY s_suppkey)) + 5)::BIGINT AS answer FROM supplier GROUP BY s_nationkey")
def recommend(spark: SparkSession, sf: str) -> DataFrame:
    out = W.recommend(table(spark, sf, "supplier"), "s_nationkey", "s_suppkey", "s_name", "Sum: ", LengthClient)
    return out.select("s_nationkey", F.col("response").cast("long").alias("answer"))


class BracketClient:
    """Answers with the prompt in brackets, but not to what holds its refused word."""

    def __call__(self, prompt: str) -> str:
        if prompt.startswith("i ") and int(prompt[-9:]) % 4 == 0:
            raise ValueError("refused")
        return f"[{prompt}]"


@query("m10_recommendation_chain", """WITH s AS (SELECT n_regionkey, s_nationkey, '[s ' || coalesce(string_agg('[i ' || s_name || ']', chr(10) ORDER BY s_suppkey) FILTER (WHERE s_suppkey % 4 <> 0), '') || ']' AS said, count(*) FILTER (WHERE s_suppkey % 4 = 0) AS failed FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL),
r AS (SELECT n_regionkey, '[r ' || string_agg(s_nationkey || ': ' || said, chr(10) ORDER BY s_nationkey) || ']' AS rationale, sum(failed)::BIGINT AS failed FROM s GROUP BY n_regionkey)
SELECT n_regionkey, rationale, '[f ' || rationale || ']' AS recommendation, failed FROM r""")
def recommendation_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as outcomes, nations as comparisons, regions as questions; each fourth outcome gets no reply."""
    outcomes = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return W.recommendation_chain(outcomes, "n_regionkey", "s_nationkey", "s_suppkey", "s_name", ("i ", "s ", "r ", "f "), BracketClient)


class RevisingClient:
    """Adds a mark to a strategy until it has two or is long."""

    def __call__(self, prompt: str) -> str:
        strategy, revised, _ = prompt.partition("\n")
        if not revised:
            return prompt
        return "SEARCH_COMPLETE" if strategy.endswith("!!") or len(strategy) > 9 else strategy + "!"


@query("m11_search_rounds", "SELECT n_nationkey, n_name || CASE WHEN length(n_name) > 9 THEN '' WHEN length(n_name) = 9 THEN '!' ELSE '!!' END AS strategy FROM nation")
def search_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Strategies revised on feedback until they are complete."""
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name")
    out = W.search_rounds(rows, "n_name", RevisingClient, lambda df: df.withColumn("feedback", F.lit("more")))
    return out.select("n_nationkey", "strategy")


class LengthEncoder:
    """Vectors of a text's length and 1."""

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), 1.0] for t in texts]


@query("r3_embed", "SELECT doc_id, round(length(text) / sqrt(length(text) * length(text) + 1), 4) AS x, round(1 / sqrt(length(text) * length(text) + 1), 4) AS y FROM documents")
def embed(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of length 1 from an encoder that sees batches."""
    out = W.embed(table(spark, sf, "documents").select("doc_id", "text"), "text", LengthEncoder, 2)
    return out.select("doc_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("x"), F.round(F.get("embedding", F.lit(1)).cast("double"), 4).alias("y"))


@query("m12_variants", "SELECT n_nationkey, '-' || length(n_name) AS variant FROM nation")
def variants(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return W.variants(rows, "n_name", "n_name", LengthClient).select("n_nationkey", "variant")


@query("r14_rerank", "SELECT p_size AS q, p_partkey AS idx, row_number() OVER (PARTITION BY p_size ORDER BY length(p_name), p_partkey) AS rank FROM part QUALIFY rank <= 3")
def rerank(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "part").select(F.col("p_size").alias("q"), F.col("p_partkey").alias("idx"), "p_name", F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    return W.rerank(found, "p_name", LengthClient, 3).select("q", "idx", "rank")


@query("p21_retrieval_items", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS n, CASE n_regionkey WHEN 4 THEN NULL ELSE n_name END AS first FROM nation")
def items(spark: SparkSession, sf: str) -> DataFrame:
    record = F.concat(F.lit('{"index": "3", "score": 0.5, "record": {"question_id": "'), "n_name", F.lit('"}}'))
    flat = F.concat(F.lit('{"question": "q", "question_id": "'), "n_name", F.lit('"}'))
    k = F.col("n_regionkey")
    text = (
        F.when(k == 0, F.concat(F.lit('{"hybrid_results": ['), record, F.lit(","), flat, F.lit("]}")))
        .when(k == 1, F.concat(F.lit("["), flat, F.lit("]")))
        .when(k == 2, flat)
        .when(k == 3, F.concat(F.lit('{"results": ['), flat, F.lit(","), record, F.lit("]}")))
        .otherwise('{"other": 1}')
    )
    rows = table(spark, sf, "nation").select("n_nationkey", W.candidates(text).alias("c"))
    return rows.select("n_nationkey", F.when(F.col("c").isNotNull(), F.size("c")).alias("n"), F.expr("c[0].question_id").alias("first"))
