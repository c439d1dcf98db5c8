"""Statistics queries: the two labels of a document act as two raters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import statistics as S

from .base import Queries, declare, table

queries: Queries = {}
query = declare(queries)


@query("a11_recall_precision", "SELECT round(sum(quality * toxic) / sum(quality), 6) AS recall, round(sum(quality * toxic) / sum(toxic), 6) AS precision FROM labels")
def recall_precision(spark: SparkSession, sf: str) -> DataFrame:
    return S.recall_precision(table(spark, sf, "labels"), "quality", "toxic")


@query("a12_confusion", "SELECT a::BIGINT AS a, b::BIGINT AS b, count(doc_id) AS n FROM range(3) x(a) CROSS JOIN range(3) y(b) LEFT JOIN labels ON quality = a AND toxic = b GROUP BY ALL")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return S.confusion(table(spark, sf, "labels"), "quality", "toxic", [0, 1, 2])


_KAPPA = """WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {t} GROUP BY ALL), t AS (SELECT sum(n) AS n FROM c),
ra AS (SELECT a, sum(n) AS n FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS n FROM c GROUP BY b)
SELECT round(1 - (SELECT sum({w} * n) FROM c) * (SELECT n FROM t) / (SELECT sum({w} * ra.n * rb.n) FROM ra, rb), 6) AS kappa"""


@query("a13_kappa", _KAPPA.format(a="quality", b="toxic", t="labels", w="(a <> b)::INT"))
def kappa(spark: SparkSession, sf: str) -> DataFrame:
    return S.kappa(table(spark, sf, "labels"), "quality", "toxic")


@query("a13_kappa_quadratic", _KAPPA.format(a="l_linenumber", b="(l_partkey % 4 + l_linenumber % 3)", t="lineitem", w="power(a - b, 2)"))
def kappa_quadratic(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("a"), (F.col("l_partkey") % 4 + F.col("l_linenumber") % 3).alias("b"))
    return S.kappa(rows, "a", "b", weights="quadratic")


_RATINGS = "SELECT doc_id AS u, (n_chars + r * (doc_id % 3)) % 4 AS v FROM documents, range(3) t(r) WHERE NOT (doc_id % 11 = 0 AND r > 0)"


@query("a14_krippendorff", f"""WITH ratings AS ({_RATINGS}), c AS (SELECT u, v, count(*) AS c FROM ratings GROUP BY ALL), m AS (SELECT u, sum(c) AS m FROM c GROUP BY u HAVING m > 1),
o AS (SELECT x.v AS x, y.v AS y, sum(x.c * (y.c - CASE WHEN x.v = y.v THEN 1 ELSE 0 END) / (m - 1)) AS o FROM c x JOIN c y ON x.u = y.u JOIN m ON m.u = x.u GROUP BY 1, 2),
n AS (SELECT x AS v, sum(o) AS n FROM o GROUP BY x), p AS (SELECT v, n, sum(n) OVER (ORDER BY v) - n / 2 AS mid, sum(n) OVER () AS total FROM n)
SELECT round(1 - (max(a.total) - 1) * sum(coalesce(o, 0) * power(a.mid - b.mid, 2)) / sum(a.n * b.n * power(a.mid - b.mid, 2)), 6) AS alpha FROM p a CROSS JOIN p b LEFT JOIN o ON o.x = a.v AND o.y = b.v""")
def krippendorff(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("NOT (doc_id % 11 = 0 AND r > 0)")
    return S.krippendorff(docs.select(F.col("doc_id").alias("u"), ((F.col("n_chars") + F.col("r") * (F.col("doc_id") % 3)) % 4).alias("v")), "u", "v")


@query("a15_percentiles", "SELECT round(quantile_cont(l_extendedprice, 0.025), 6) AS low, round(quantile_cont(l_extendedprice, 0.975), 6) AS high FROM lineitem")
def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return S.interval(table(spark, sf, "lineitem"), "l_extendedprice")


@query("u7_bootstrap_recall")
def bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """The interval of 1000 replicates' recall; SQL elsewhere can't draw the same copies."""
    drawn = S.resampled(table(spark, sf, "labels"), ["quality", "toxic"], replicates=1000)
    truth, both = F.col("quality") * F.col("copies"), F.col("quality") * F.col("toxic") * F.col("copies")
    recalls = drawn.groupBy("replicate").agg(F.when(F.sum(truth) > 0, F.sum(both) / F.sum(truth)).otherwise(0.0).alias("recall"))
    return S.interval(recalls, "recall")


@query("u7_bootstrap_pooled")
def bootstrap_pooled(spark: SparkSession, sf: str) -> DataFrame:
    """The interval of precision over 1000 replicates of each source's labels, pooled."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    guessed = F.sum(F.col("toxic") * F.col("copies"))
    precision = F.when(guessed > 0, F.sum(F.col("quality") * F.col("toxic") * F.col("copies")) / guessed).otherwise(0.0)
    return S.pooled_interval(rows, "source", ["quality", "toxic"], precision)


@query("u7_bootstrap_kappa")
def bootstrap_kappa(spark: SparkSession, sf: str) -> DataFrame:
    drawn = S.resampled(table(spark, sf, "labels"), ["quality", "toxic"], replicates=2000)
    return S.interval(S.kappa(drawn, "quality", "toxic", by=["replicate"], copies="copies"), "kappa")


@query("u8_label_vectors", "SELECT source, quality AS truth, toxic AS guess, count(*) AS n FROM labels JOIN documents ON labels.doc_id = documents.doc_id GROUP BY source, quality, toxic")
def label_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Each source's totals as rows of 0/1 labels again, which have the counts that the totals were taken from."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    totals = rows.groupBy("source").agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("tp"), F.count_if(F.col("quality") == 1).alias("p"), F.count_if(F.col("toxic") == 1).alias("pp"), F.count(F.lit(1)).alias("n"))
    return S.label_vectors(totals, keep=["source"]).groupBy("source", "truth", "guess").agg(F.count(F.lit(1)).alias("n"))


@query("u7_bootstrap_sums", "SELECT source, replicate, n FROM (SELECT source, count(*) AS n FROM labels JOIN documents ON labels.doc_id = documents.doc_id WHERE source IS NOT NULL GROUP BY source), range(1, 51) r(replicate)")
def bootstrap_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Every replicate of each source draws as many rows as the source has, here with every row a cell of its own."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    drawn = S.resampled(rows, ["doc_id"], ["source"], 50, leaf_cells=64)
    return drawn.groupBy("source", "replicate").agg(F.sum("copies").alias("n"))
