"""Retrieval queries: benchmark items as questions over documents, embeddings as vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import retrieval as R
from quarrystone.operators import workflow as W
from quarrystone.scratch import shared_folder
from quarrystone.sources import sinks

from .base import Queries, declare, table

queries: Queries = {}
query = declare(queries)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), "text")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("question"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("v"))


def _vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """A vector for each benchmark item that has one: the pairing of item_id and vec_id is a convention."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("q"))
    return items.join(_vectors(spark, sf).withColumnRenamed("idx", "q"), "q")


def _bm25(tokens: str) -> str:
    return f"""
dt AS (SELECT doc_id AS idx, unnest({tokens.format("text")}) AS term FROM documents),
post AS (SELECT idx, term, count(*) AS tf FROM dt GROUP BY ALL),
dl AS (SELECT idx, sum(tf) AS dl FROM post GROUP BY idx),
tot AS (SELECT count(*) AS n FROM documents),
av AS (SELECT (SELECT sum(dl) FROM dl) / (SELECT n FROM tot) AS avgdl),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, tot GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT item_id AS q, unnest({tokens.format("text")}) AS term FROM benchmark),
qp AS (SELECT q, term, count(*) AS qtf FROM qt GROUP BY ALL),
matched AS (SELECT q, idx, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
            FROM qp JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (idx), av GROUP BY q, idx),
scored AS (SELECT item_id AS q, doc_id AS idx, coalesce(score, 0.0) AS score FROM benchmark CROSS JOIN documents LEFT JOIN matched ON q = item_id AND idx = doc_id)"""


_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+(?:[-''][a-z0-9]+)?')"
_SPACED = "string_split({}, ' ')"
_TOP = "SELECT q, idx, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, idx) AS rank FROM {} QUALIFY rank <= {}"
_COSINE = """
vq AS (SELECT item_id AS q, embedding AS qv FROM benchmark JOIN embeddings ON vec_id = item_id),
dense AS (SELECT q, vec_id AS idx, round(list_dot_product(qv::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(qv::DOUBLE[], qv::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS score FROM vq, embeddings)"""


@query("r1_bm25_index", f"""WITH {_bm25(_TOKENS)}
SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, round(any_value(idf), 6) AS idf FROM post JOIN idf USING (term) GROUP BY term""")
def bm25_index(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    counts = R.term_counts(docs, "idx", "text")
    weights = R.weights_of(counts, docs.agg(F.count(F.lit(1)).alias("n")))
    return counts.join(weights, "term").select("term", "df", "tf", F.round("idf", 6).alias("idf"))


@query("bm25_topk", f"WITH {_bm25(_TOKENS)} {_TOP.format('scored', 5)}")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.bm25_search(_docs(spark, sf), _asked(spark, sf))


@query("k8_saved_bm25", f"WITH {_bm25(_TOKENS)} {_TOP.format('scored', 5)}")
def saved_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """The same results from an index that was saved before."""
    path = f"{shared_folder(spark)}/bm25-{uuid.uuid4().hex}"
    sinks.save_bm25(_docs(spark, sf), path, "idx", "text")
    return sinks.search_bm25(spark, path, _asked(spark, sf))


@query("r12_bm25_by_spaces", f"WITH {_bm25(_SPACED)} {_TOP.format('scored', 5)}")
def bm25_by_spaces(spark: SparkSession, sf: str) -> DataFrame:
    return R.bm25_search(_docs(spark, sf), _asked(spark, sf), tokens=F.split("text", " "), question_tokens=F.split("question", " "))


@query("r4_dense_cosine", f"WITH {_COSINE} {_TOP.format('dense', 5)}")
def dense_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return R.dense_search(_vectors(spark, sf), _vector_queries(spark, sf))


@query("r11_examples", f"WITH {_COSINE} {_TOP.format('dense', 3)}")
def examples(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest examples for prompts."""
    return W.examples(_vectors(spark, sf), _vector_queries(spark, sf))


def _dense(kind: str, sql: str) -> None:
    @query(f"r15_dense_{kind}", f"WITH s AS (SELECT item_id AS q, e.vec_id AS idx, round({sql}, 6) AS score FROM benchmark JOIN embeddings x ON x.vec_id = item_id CROSS JOIN embeddings e) {_TOP.format('s', 5)}")
    def dense(spark: SparkSession, sf: str) -> DataFrame:
        return R.dense_search(_vectors(spark, sf), _vector_queries(spark, sf), kind=kind)


_dense("dot", "list_dot_product(x.embedding::DOUBLE[], e.embedding::DOUBLE[])")
_dense("euclid", "0 - list_distance(x.embedding::DOUBLE[], e.embedding::DOUBLE[])")
_dense("manhattan", "0 - list_sum(list_transform(list_zip(x.embedding::DOUBLE[], e.embedding::DOUBLE[]), lambda z: abs(z[1] - z[2])))")


def _pools(spark: SparkSession, sf: str, pool: int) -> tuple[DataFrame, DataFrame]:
    dense = R.dense_search(_vectors(spark, sf), _vector_queries(spark, sf), pool).select("q", "idx", "score")
    return dense, R.bm25_search(_docs(spark, sf), _asked(spark, sf), pool).select("q", "idx", "score")


def _fused(pool: int, flat: str) -> str:
    norm = "SELECT q, idx, CASE WHEN min(score) OVER w = max(score) OVER w THEN {flat} ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM {t} WINDOW w AS (PARTITION BY q)"
    return f"""WITH {_bm25(_TOKENS)}, {_COSINE},
dp AS (SELECT q, idx, score FROM ({_TOP.format("dense", pool)})), sp AS (SELECT q, idx, score FROM ({_TOP.format("scored", pool)})),
dn AS ({norm.format(flat=flat, t="dp")}), sn AS ({norm.format(flat=flat, t="sp")}),
f AS (SELECT coalesce(dn.q, sn.q) AS q, coalesce(dn.idx, sn.idx) AS idx, round(0.6 * coalesce(dn.norm, 0) + 0.4 * coalesce(sn.norm, 0), 6) AS score FROM dn FULL JOIN sn ON dn.q = sn.q AND dn.idx = sn.idx)
"""


@query("r5_r7_hybrid_topk", _fused(5, "1.0") + _TOP.format("f", 5))
def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.fuse(*_pools(spark, sf, 5))


@query("r6_r8_hybrid_pool", _fused(20, "CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END") + _TOP.format("f", 5))
def hybrid_pool(spark: SparkSession, sf: str) -> DataFrame:
    return R.fuse(*_pools(spark, sf, 20), constant="sign")


@query("f10_threshold", f"WITH {_COSINE}, t AS ({_TOP.format('dense', 5)}), g AS (SELECT * FROM t WHERE score >= 0.35 AND idx <> q) SELECT * FROM g UNION ALL SELECT q, NULL, NULL, NULL FROM vq WHERE q NOT IN (SELECT q FROM g)")
def threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest others of at least 0.35 and a row of nulls for queries without any."""
    found = dense_cosine(spark, sf).where("idx <> q")
    return R.with_threshold(found, _vector_queries(spark, sf), 0.35)


@query("f11_filtered_dense", f"WITH {_COSINE}, s AS (SELECT dense.* FROM dense JOIN embeddings ON vec_id = idx WHERE label = 3) {_TOP.format('s', 5)}")
def filtered_dense(spark: SparkSession, sf: str) -> DataFrame:
    """Equality on the payload goes below the ranking, into the scan."""
    held = table(spark, sf, "embeddings").where("label = 3").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("v"))
    return R.dense_search(held, _vector_queries(spark, sf))


@query("f6_filter_after_topk", f"WITH {_bm25(_TOKENS)}, t AS ({_TOP.format('scored', 5)}) SELECT t.* FROM t JOIN documents ON doc_id = idx WHERE lang = 'en'")
def filter_after_topk(spark: SparkSession, sf: str) -> DataFrame:
    """A filter above the limit may leave fewer than k."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), "lang")
    return bm25_topk(spark, sf).join(docs, "idx").where("lang = 'en'").select("q", "idx", "score", "rank")


@query("f7_without_self", f"WITH {_COSINE} SELECT * FROM ({_TOP.format('dense', 5)}) WHERE idx <> q")
def without_self(spark: SparkSession, sf: str) -> DataFrame:
    """Results as one array a query, the query itself filtered out of it, exploded again."""
    nested = dense_cosine(spark, sf).groupBy("q").agg(F.collect_list(F.struct("idx", "score", "rank")).alias("hits"))
    rest = nested.select("q", F.filter("hits", lambda x: x["idx"] != F.col("q")).alias("hits"))
    return rest.select("q", F.inline("hits"))


@query("r10_per_source_topk", f"WITH {_bm25(_TOKENS)}, s AS (SELECT scored.*, source FROM scored JOIN documents ON doc_id = idx WHERE score > 0) SELECT q, source, idx, score, row_number() OVER (PARTITION BY q, source ORDER BY score DESC, idx) AS rank FROM s QUALIFY rank <= 2")
def whole_per_source_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The best of each source for every benchmark item."""
    return _per_source(spark, sf, _asked(spark, sf))


def _per_source(spark: SparkSession, sf: str, asked: DataFrame) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), "text", "source")
    return R.bm25_search_within(docs, asked, "source", 2).select("q", "source", "idx", "score", "rank")


@query("a5_ir_metrics", f"""WITH {_bm25(_TOKENS)}, t AS ({_TOP.format('scored', 5)}),
gold AS (SELECT item_id AS q, min(doc_id) AS gold FROM benchmark JOIN documents ON contains(documents.text, benchmark.text) GROUP BY 1),
r AS (SELECT g.q, coalesce(min(t.rank), 0) AS rank FROM gold g LEFT JOIN t ON t.q = g.q AND t.idx = g.gold GROUP BY g.q)
SELECT count(*) AS items, round(avg(CASE WHEN rank = 1 THEN 1 ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN rank BETWEEN 1 AND 3 THEN 1 ELSE 0 END), 6) AS recall_3,
round(avg(CASE WHEN rank BETWEEN 1 AND 5 THEN 1 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN rank > 0 THEN 1 / rank ELSE 0 END), 6) AS mrr FROM r""")
def ir_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Hit@1, Recall@3, Recall@5 and MRR where the target is the first document that holds the item's passage."""
    from quarrystone.operators.statistics import ranking_metrics

    gold = R.holding(_docs(spark, sf), _asked(spark, sf)).groupBy("q").agg(F.min("idx").alias("target"))
    lists = bm25_topk(spark, sf).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "idx"))).alias("hits"))
    items = gold.join(lists, "q", "left").select("target", F.transform("hits", lambda x: x["idx"]).alias("candidates"))
    return ranking_metrics(items, "target", "candidates")


_TERMS = "regexp_extract_all(lower({}), '\\b\\w\\w+\\b')"


def _pair(a: str, b: str) -> str:
    ta, tb = _TERMS.format(a), _TERMS.format(b)

    def square(own: str, other: str) -> str:
        return f"list_sum(list_transform(list_distinct({own}), lambda x: power(len(list_filter({own}, lambda y: y = x)) * CASE WHEN list_contains({other}, x) THEN 1.0 ELSE 1 + ln(1.5) END, 2)))"

    shared = f"coalesce(list_sum(list_transform(list_distinct(list_intersect({ta}, {tb})), lambda x: len(list_filter({ta}, lambda y: y = x)) * len(list_filter({tb}, lambda y: y = x)))), 0)"
    return f"round({shared} / (sqrt({square(ta, tb)}) * sqrt({square(tb, ta)})), 6)"


_NAMES = f"n AS (SELECT p_name, min(p_partkey) AS key, count(*) AS parts FROM part GROUP BY p_name), s AS (SELECT a.p_name AS na, b.p_name AS nb, b.key AS kb, a.parts * b.parts AS pairs, {_pair('a.p_name', 'b.p_name')} AS similarity FROM n a, n b)"


@query("r16_j5_fuzzy_match", f"WITH {_NAMES} SELECT na, nb, pairs, similarity FROM s WHERE similarity > 0.9")
def fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of part names more similar than 0.9, each name standing for all parts that bear it, and how many pairs of parts that makes."""
    names = table(spark, sf, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("parts"))
    a, b = names.select(F.col("p_name").alias("na"), F.col("parts").alias("pa")), names.select(F.col("p_name").alias("nb"), F.col("parts").alias("pb"))
    return R.fuzzy_join(a, b, "na", "nb").select("na", "nb", (F.col("pa") * F.col("pb")).alias("pairs"), "similarity")


@query("r16_best_match", f"WITH {_NAMES}, m AS (SELECT na, min(kb) AS kb, arg_min(similarity, kb) AS similarity FROM s WHERE similarity > 0.9 GROUP BY na) SELECT p_partkey AS ka, kb, similarity FROM part JOIN m ON p_name = na")
def best_match(spark: SparkSession, sf: str) -> DataFrame:
    """For every part the first part with a name more similar than 0.9, itself included."""
    part = table(spark, sf, "part")
    a, b = part.select(F.col("p_partkey").alias("ka"), F.col("p_name").alias("na")), part.select(F.col("p_partkey").alias("kb"), F.col("p_name").alias("nb"))
    return R.best_match(a, b, "na", "nb", "kb").select("ka", "kb", "similarity")


@query("p1_min_max_norms", f"WITH {_COSINE}, p AS ({_TOP.format('dense', 10)}) SELECT q, idx, round(CASE WHEN min(score) OVER w = max(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS norm FROM p WINDOW w AS (PARTITION BY q)")
def min_max_norms(spark: SparkSession, sf: str) -> DataFrame:
    found = R.dense_search(_vectors(spark, sf), _vector_queries(spark, sf), 10)
    return R.min_max(found).select("q", "idx", F.round("norm", 6).alias("norm"))


@query("r10_by_paper", """WITH s AS (SELECT 'p' || label AS paper, vec_id AS idx, embedding::DOUBLE[] AS v FROM embeddings),
a AS (SELECT DISTINCT 'p' || ((item_id + j) % 10) AS paper, item_id AS q, x.embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings x ON x.vec_id = item_id, range(3) r(j)),
c AS (SELECT a.paper, q, idx, round(coalesce(list_dot_product(a.v, s.v) / nullif(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(s.v, s.v)), 0), 0), 6) AS score FROM a JOIN s ON a.paper = s.paper)
SELECT paper, q, idx, score, row_number() OVER (PARTITION BY paper, q ORDER BY score DESC, idx) AS rank FROM c QUALIFY rank <= 5""")
def by_paper(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as papers: vectors are stored by paper, some first with wrong values, mended by an upsert, and searched inside the papers that a query names."""
    from quarrystone.sources import vectors as V

    rows = table(spark, sf, "embeddings").select(F.concat(F.lit("p"), "label").alias("paper"), F.col("vec_id").alias("idx"), F.col("embedding").alias("v"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = V.save_by_paper(rows.where("idx % 4 <> 0").withColumn("v", F.when(F.col("idx") % 3 == 0, F.reverse("v")).otherwise(F.col("v"))), buckets)
    store = V.upsert_by_paper(first, rows.where("idx % 4 = 0 OR idx % 3 = 0"), buckets)
    asked = table(spark, sf, "benchmark").join(rows.withColumnRenamed("idx", "item_id"), "item_id").select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"), F.col("item_id").alias("q"), "v")
    asked = asked.select(F.concat(F.lit("p"), ((F.col("q") + F.col("j")) % 10).cast("string")).alias("paper"), "q", "v")
    return V.search_by_paper(store, asked)
