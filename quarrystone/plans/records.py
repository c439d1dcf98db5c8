"""Record, screening, sampling and lookup queries; the star schema stands in for literature records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import evidence as E
from quarrystone.operators import records as R
from quarrystone.operators import sampling as S

from .base import Queries, declare, placed, table

queries: Queries = {}
query = declare(queries)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as records: parts as papers, ship modes of three kinds as publication types, some abstracts missing."""
    types = F.when(F.col("l_returnflag") == "R", F.array(F.lit("Review"), F.lit("Journal"))).when(F.col("l_returnflag") == "A", F.array(F.lit("Journal")))
    abstract = F.when(F.col("l_linenumber") % 4 != 0, F.when(F.col("l_linenumber") % 4 == 1, "").otherwise("text"))
    order = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return placed(spark, sf, "lineitem").select(F.col("l_partkey").alias("paper"), order.alias("pos"), "_place", abstract.alias("abstract"), types.alias("types"))


@query("f1_searchable", "SELECT paper, pos FROM (SELECT l_partkey AS paper, l_orderkey * 10 + l_linenumber AS pos, l_returnflag, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem WHERE l_linenumber % 4 <> 0) WHERE n = 1 AND l_returnflag <> 'R'")
def searchable(spark: SparkSession, sf: str) -> DataFrame:
    return R.searchable(_records(spark, sf), "paper", "abstract", "types", ["Review"], "pos", "_place").select("paper", "pos")


@query("f2_dropna", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND lang IS NOT NULL")
def dropna(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a label and a language."""
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.dropna(subset=["quality", "lang"]).select("doc_id", "quality")


_RUNS = "SELECT doc_id, run, CASE WHEN (doc_id * 7 + run * 3) % 5 < 2 THEN 'Included' ELSE 'Excluded' END AS verdict FROM documents, range(3) t(run)"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "documents").select("doc_id", F.explode(F.array(*[F.lit(r).cast("long") for r in range(3)])).alias("run"))
    return runs.withColumn("verdict", F.when((F.col("doc_id") * 7 + F.col("run") * 3) % 5 < 2, "Included").otherwise("Excluded"))


@query("a1_f3_votes", f"SELECT doc_id, count(*) FILTER (WHERE verdict = 'Included') AS included_num, count(*) AS runs FROM ({_RUNS}) GROUP BY doc_id HAVING included_num >= 2")
def votes(spark: SparkSession, sf: str) -> DataFrame:
    return R.included_by_votes(_runs(spark, sf), ["doc_id"], "verdict", 2, 3)


@query("a2_first_row", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def first_row(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_rows(table(spark, sf, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber"]).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("a6_screening_summary", f"SELECT verdict, count(*) AS n, min(doc_id) AS first, round(avg(run), 6) AS mean_run FROM ({_RUNS}) GROUP BY verdict")
def summary(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.round(F.avg("run"), 6).alias("mean_run"))


@query("a6_summaries", f"""WITH r AS (SELECT source, doc_id * 3 + run AS place, doc_id, verdict, coalesce(lang, '') || '-' || run AS published, substr(text, 1, 200) AS reason FROM ({_RUNS}) v JOIN documents d USING (doc_id)),
i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY place) AS n FROM r WHERE verdict = 'Included')
SELECT source, count(*) AS total_screened, count(*) FILTER (WHERE verdict = 'Included') AS total_included, count(*) FILTER (WHERE verdict = 'Excluded') AS total_excluded,
  (SELECT coalesce(string_agg(doc_id || ' ' || split_part(published, '-', 1) || ' ' || length(reason), ';' ORDER BY n), '') FROM i WHERE i.source IS NOT DISTINCT FROM r.source AND n <= 3) AS sample FROM r GROUP BY source""")
def summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Each source's screening in counts, with its first three included rows."""
    rows = _runs(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"), "doc_id")
    rows = rows.withColumn("place", F.col("doc_id") * 3 + F.col("run")).withColumn("published", F.concat(F.coalesce("lang", F.lit("")), F.lit("-"), "run"))
    sample = {"pmid": F.col("doc_id").cast("string"), "year": F.split("published", "-")[0], "reason": F.substring("text", 1, 200)}
    out = R.screening_summary(rows, "source", "place", "verdict", sample)
    lines = F.transform("sample_included", lambda x: F.concat_ws(" ", x["pmid"], x["year"], F.length(x["reason"]).cast("string")))
    return out.select("source", "total_screened", "total_included", "total_excluded", F.array_join(lines, ";").alias("sample"))


@query("a7_routing_counts", "SELECT count(*) FILTER (WHERE toxic = 1) AS yes, count(*) FILTER (WHERE toxic = 0) AS no FROM labels")
def routing(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").agg(F.count_if(F.col("toxic") == 1).alias("yes"), F.count_if(F.col("toxic") == 0).alias("no"))


@query("f4_truthy", "SELECT doc_id FROM documents WHERE lang IS NOT NULL AND length(lang) > 0 AND length(text) > 100")
def truthy(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("lang IS NOT NULL AND length(lang) > 0 AND length(text) > 100").select("doc_id")


@query("f5_not_found", "SELECT s_suppkey FROM supplier WHERE s_nationkey % 3 <> 0")
def not_found(spark: SparkSession, sf: str) -> DataFrame:
    values = F.when(F.col("s_nationkey") % 3 == 0, F.array(F.lit("x"), F.lit("Not found"))).otherwise(F.array(F.lit("x")))
    return table(spark, sf, "supplier").where(~F.array_contains(values, "Not found")).select("s_suppkey")


@query("f8_skip_before_model", "SELECT doc_id, CASE WHEN quality IS NULL THEN 'Excluded' ELSE 'to judge' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)")
def skip(spark: SparkSession, sf: str) -> DataFrame:
    judge, rest = R.split_skipped(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")
    return judge.select("doc_id", F.lit("to judge").alias("verdict")).unionByName(rest.select("doc_id", F.lit("Excluded").alias("verdict")))


_RULES = "list_filter([CASE WHEN length(trim(text)) <= 50 THEN 'length' END, CASE WHEN source NOT LIKE 'src%' OR source IS NULL THEN 'source' END, CASE WHEN n_chars <> length(text) THEN 'count' END], lambda x: x IS NOT NULL)"


@query("f9_rejects", f"SELECT doc_id, array_to_string({_RULES}, ',') AS broken FROM documents")
def rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Good documents, and the rejected ones with the rules that they break."""
    rules = {"length": F.length(F.trim("text")) > 50, "source": F.col("source").startswith("src"), "count": F.col("n_chars") == F.length("text")}
    good, bad = R.split_rejects(table(spark, sf, "documents"), rules)
    return good.select("doc_id", F.lit("").alias("broken")).unionByName(bad.select("doc_id", F.array_join("violations", ",").alias("broken")))


@query("f12_violations", "SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < 200 THEN 'long enough' END, CASE WHEN lang <> 'en' THEN 'english' END], lambda x: x IS NOT NULL), ',') AS broken FROM documents WHERE length(text) < 200 OR lang <> 'en'")
def violations(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"long enough": F.length("text") >= 200, "english": F.col("lang") == "en"}
    return R.violations(table(spark, sf, "documents"), rules).select("doc_id", F.array_join("violations", ",").alias("broken"))


@query("f12_one_changed", "SELECT p_partkey FROM part WHERE p_size % 3 = 1")
def one_changed(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in which exactly one of three fields differs from its original."""
    fields = {"p_name": F.when(F.col("p_size") % 3 >= 1, "x").otherwise(F.col("p_name")), "p_brand": F.when(F.col("p_size") % 3 == 2, "y").otherwise(F.col("p_brand")), "p_type": F.col("p_type")}
    changed = sum((F.when(c.eqNullSafe(F.col(n)), 0).otherwise(1) for n, c in fields.items()), F.lit(0))
    return table(spark, sf, "part").where(changed == 1).select("p_partkey")


@query("f12_u4_key_sets", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'b' ELSE '' END AS missing FROM nation")
def key_sets(spark: SparkSession, sf: str) -> DataFrame:
    want, have = F.array(F.lit("a"), F.lit("b")), F.when(F.col("n_regionkey") == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(F.array_except(want, have), ",").alias("missing"))


@query("j1_payload_override", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN n_name END, c_mktsegment) AS field FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def payload_override(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("c_custkey", F.coalesce(F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")), "c_mktsegment").alias("field"))


@query("j2_full_outer", "SELECT coalesce(a.doc_id, b.vec_id) AS id, coalesce(a.n_chars, 0) AS chars, coalesce(b.label, -1) AS label FROM documents a FULL JOIN embeddings b ON a.doc_id = b.vec_id")
def whole_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    return _outer(table(spark, sf, "documents"), table(spark, sf, "embeddings"))


def _outer(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    a = docs.select(F.col("doc_id").alias("id"), "n_chars")
    b = vectors.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"))
    return a.join(b, "id", "full").select("id", F.coalesce("n_chars", F.lit(0)).alias("chars"), F.coalesce("label", F.lit(-1)).alias("label"))


@query("j3_override_last", "SELECT o_orderkey, coalesce(l, o_orderpriority) AS o_orderpriority FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(l_shipdate::DATE::VARCHAR, l_extendedprice) AS l FROM lineitem WHERE l_quantity > 30 GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def override_last(spark: SparkSession, sf: str) -> DataFrame:
    """Of equal prices the line stored first counts."""
    lines = placed(spark, sf, "lineitem").where("l_quantity > 30 AND l_shipdate IS NOT NULL").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").cast("date").cast("string").alias("_day"), "l_extendedprice", "_place")
    known = lines.groupBy("o_orderkey", "l_extendedprice").agg(F.min_by("_day", "_place").alias("o_orderpriority"))
    return R.override(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), known, "o_orderkey", ["o_orderpriority"], "l_extendedprice")


@query("j4_related_papers", "SELECT l_orderkey AS outcome, l_partkey AS paper_uid, p_name AS title FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey")
def whole_related(spark: SparkSession, sf: str) -> DataFrame:
    return _related(spark, sf, table(spark, sf, "lineitem"))


def _related(spark: SparkSession, sf: str, lines: DataFrame) -> DataFrame:
    outcomes = lines.groupBy(F.col("l_orderkey").alias("outcome")).agg(F.collect_set("l_partkey").alias("related_paper_list"))
    papers = table(spark, sf, "part").select(F.col("p_partkey").alias("paper_uid"), F.col("p_name").alias("title"))
    return E.papers_of_outcomes(outcomes, papers).select("outcome", "paper_uid", "title")


@query("j6_lookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'fulfilled' END AS meaning FROM orders WHERE o_orderstatus IN ('O', 'F')")
def constant_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return E.lookup(table(spark, sf, "orders"), {"O": "open", "F": "fulfilled"}, "o_orderstatus", "meaning").select("o_orderkey", "meaning")


@query("j7_one_to_many", "SELECT n_nationkey, unnest(CASE WHEN n_regionkey = 0 THEN [1, 2] ELSE [3] END)::BIGINT AS question FROM nation WHERE n_regionkey < 2")
def one_to_many(spark: SparkSession, sf: str) -> DataFrame:
    lists = F.when(F.col("n_regionkey") == 0, F.array(F.lit(1), F.lit(2))).when(F.col("n_regionkey") == 1, F.array(F.lit(3)))
    return table(spark, sf, "nation").select("n_nationkey", F.explode(lists.cast("array<bigint>")).alias("question"))


@query("j8_first_by_trimmed_text", "SELECT s_suppkey, (SELECT min(c_custkey) FROM customer WHERE c_nationkey = s_nationkey) AS entry FROM supplier")
def trimmed(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "customer").select(F.concat(F.lit(" "), F.col("c_nationkey").cast("string")).alias("question"), F.col("c_custkey").alias("entry"))
    asked = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.col("s_nationkey").cast("string"), F.lit("  ")).alias("asked"))
    first = entries.groupBy(F.trim("question").alias("_key")).agg(F.min("entry").alias("entry"))  # one row a text meets the other side
    return asked.join(first, F.trim("asked") == F.col("_key"), "left").select("s_suppkey", "entry")


@query("j9_by_ordinal", "SELECT d.doc_id, b.item_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents) d JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id DESC) AS n FROM benchmark) b USING (n)")
def by_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of two lists paired by explicit ordinals, the second list from its end."""
    b = table(spark, sf, "benchmark").select("item_id", (-F.col("item_id")).alias("at"))
    d = R.numbered(table(spark, sf, "documents").select("doc_id"), F.col("doc_id"))
    return d.join(R.numbered(b, F.col("at")), "n").select("doc_id", "item_id")


@query("j10_manifest", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'existing' ELSE 'missing' END AS state FROM documents")
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    have, miss = R.split_skipped(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")
    return have.withColumn("state", F.lit("existing")).unionByName(miss.withColumn("state", F.lit("missing")))


@query("j11_refresh_manifest", "SELECT source, count(*) AS existing FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source")
def refresh(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    both = d.where("doc_id % 2 = 0").select("source", "lang").unionByName(d.where("doc_id % 3 < 3").select("source", "lang"))
    return both.dropDuplicates(["source", "lang"]).groupBy("source").agg(F.count(F.lit(1)).alias("existing"))


_WANTED = "SELECT c_nationkey AS task, c_custkey AS ordinal, 'pdf/' || (c_custkey % 60) AS path FROM customer"
_HELD = "SELECT s_nationkey AS task, s_suppkey AS ordinal, 'pdf/' || s_suppkey AS path FROM supplier WHERE s_suppkey % 2 = 0"


@query("j11_manifest", f"""WITH m AS ({_WANTED}), e AS ({_HELD}), f AS (SELECT DISTINCT 'pdf/' || o_custkey AS path FROM orders WHERE o_custkey % 4 <> 1)
SELECT *, 'existing' AS status FROM e UNION ALL SELECT task, min(ordinal), path, 'existing' FROM m WHERE path IN (SELECT path FROM f) AND NOT EXISTS (SELECT 1 FROM e WHERE e.task = m.task AND e.path = m.path) GROUP BY task, path
UNION ALL SELECT *, 'missing' FROM m WHERE path NOT IN (SELECT path FROM f)""")
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as missing papers, suppliers as existing ones of a nation's manifest, refreshed by the files that orders name."""
    missing = table(spark, sf, "customer").select(F.col("c_nationkey").alias("task"), F.col("c_custkey").alias("ordinal"), F.concat(F.lit("pdf/"), F.col("c_custkey") % 60).alias("path"))
    held = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("task"), F.col("s_suppkey").alias("ordinal"), F.concat(F.lit("pdf/"), "s_suppkey").alias("path"))
    files = table(spark, sf, "orders").where("o_custkey % 4 <> 1").select(F.concat(F.lit("pdf/"), "o_custkey").alias("path"))
    return R.refresh_manifest(missing, held, files)


@query("j12_unassessed", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def unassessed(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(done, "c_custkey", "left_anti").select("c_custkey")


@query("j12_input_postfix", """WITH c AS (SELECT c_nationkey AS task, c_custkey AS comparator, CASE WHEN c_custkey % 3 = 0 THEN '_x' || c_custkey % 7 END AS explicit, '_m' || c_custkey % 5 AS mapped FROM customer WHERE c_custkey % 4 <> 0 OR c_nationkey > 5),
f AS (SELECT DISTINCT s_nationkey AS task, CASE s_suppkey % 3 WHEN 0 THEN '_x' || s_suppkey % 7 WHEN 1 THEN '_m' || s_suppkey % 5 ELSE '' END AS postfix FROM supplier),
d AS (SELECT DISTINCT c_nationkey AS task, o_custkey AS comparator FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'),
n AS (SELECT task FROM c GROUP BY task HAVING count(*) = 1),
w AS (SELECT task, comparator, 0 AS place, explicit AS postfix FROM c UNION ALL SELECT task, comparator, 1, mapped FROM c UNION ALL SELECT task, comparator, 2, '' FROM c WHERE task IN (SELECT task FROM n)
  UNION ALL SELECT c.task, comparator, 3, postfix FROM c JOIN f ON c.task = f.task WHERE c.task IN (SELECT task FROM n)),
b AS (SELECT w.task, comparator, min(struct_pack(place := place, postfix := w.postfix)).postfix AS postfix FROM w JOIN f ON w.task = f.task AND w.postfix = f.postfix GROUP BY w.task, comparator)
SELECT c.task, c.comparator, b.postfix FROM c LEFT JOIN b ON c.task = b.task AND c.comparator = b.comparator WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.task = c.task AND d.comparator = c.comparator)""")
def input_postfix(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as comparisons of a nation that have no finished order, with the first of two postfixes of which a supplier has files."""
    key, s = F.col("c_custkey"), F.col("s_suppkey")
    comparisons = table(spark, sf, "customer").where("c_custkey % 4 <> 0 OR c_nationkey > 5").select(F.col("c_nationkey").alias("task"), key.alias("comparator"), F.when(key % 3 == 0, F.concat(F.lit("_x"), key % 7)).alias("explicit"), F.concat(F.lit("_m"), key % 5).alias("mapped"))
    files = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("task"), F.when(s % 3 == 0, F.concat(F.lit("_x"), s % 7)).when(s % 3 == 1, F.concat(F.lit("_m"), s % 5)).alias("postfix"))
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").join(table(spark, sf, "customer"), F.col("o_custkey") == key).select(F.col("c_nationkey").alias("task"), key.alias("comparator"))
    return R.input_postfixes(comparisons, files, done, ["explicit", "mapped"])


@query("j13_not_included", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45)")
def not_included(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").join(used, "p_partkey", "left_anti").select("p_partkey")


@query("j14_prioritised_match", "SELECT s_suppkey, coalesce(min(CASE WHEN s_suppkey = n_nationkey THEN n_name END), min(CASE WHEN s_nationkey = n_nationkey THEN n_name END)) AS match FROM supplier CROSS JOIN nation GROUP BY s_suppkey")
def prioritised(spark: SparkSession, sf: str) -> DataFrame:
    """Match by exact id, else by a weaker key: both as equi-joins, the least priority wins."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    exact = s.join(n, F.col("s_suppkey") == F.col("n_nationkey")).select("s_suppkey", F.lit(1).alias("priority"), "n_name")
    weak = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lit(2).alias("priority"), "n_name")
    return exact.unionByName(weak).groupBy("s_suppkey").agg(F.min_by("n_name", "priority").alias("match"))


_UPLOADS = "SELECT c_nationkey AS task, c_custkey AS upload, CASE WHEN c_custkey % 4 = 0 THEN 'Scan/Full_' || c_custkey || '.v2.PDF' ELSE c_name || '.pdf' END AS file_name, CASE WHEN c_custkey % 5 = 0 THEN 'S' || (c_custkey % 40) END AS target_uid FROM customer"
_MISSING = "SELECT s_nationkey AS task, s_suppkey AS ordinal, CASE WHEN s_suppkey % 3 = 0 THEN 'S' || (s_suppkey % 40) ELSE s_suppkey::VARCHAR END AS paper_uid, 'p/' || s_suppkey AS path FROM supplier WHERE s_nationkey % 6 <> 0 OR s_suppkey % 3 = 0"


@query("j14_upload_match", f"""WITH u AS (SELECT *, regexp_replace(regexp_replace(file_name, '^.*/', ''), '\\.[^.]+$', '') AS stem FROM ({_UPLOADS})), m AS ({_MISSING}),
f AS (SELECT u.task, upload, min_by(path, ordinal) AS path FROM u JOIN m ON u.task = m.task AND (target_uid = paper_uid OR contains(lower(stem), lower(paper_uid))) GROUP BY ALL),
o AS (SELECT task, min(path) AS path FROM m GROUP BY task HAVING count(*) = 1)
SELECT u.task, u.upload, coalesce(f.path, o.path) AS path FROM u LEFT JOIN f ON u.task = f.task AND u.upload = f.upload LEFT JOIN o ON u.task = o.task""")
def uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' files matched with suppliers as missing papers of their nation: by target, by a uid inside the stem, or as the only one."""
    key = F.col("c_custkey")
    files = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("task"), key.alias("upload"),
        F.when(key % 4 == 0, F.concat(F.lit("Scan/Full_"), key, F.lit(".v2.PDF"))).otherwise(F.concat("c_name", F.lit(".pdf"))).alias("file_name"),
        F.when(key % 5 == 0, F.concat(F.lit("S"), key % 40)).alias("target_uid"),
    )
    n = F.col("s_suppkey")
    papers = table(spark, sf, "supplier").where("s_nationkey % 6 <> 0 OR s_suppkey % 3 = 0").select(
        F.col("s_nationkey").alias("task"), n.alias("ordinal"), F.when(n % 3 == 0, F.concat(F.lit("S"), n % 40)).otherwise(n.cast("string")).alias("paper_uid"), F.concat(F.lit("p/"), n).alias("path")
    )
    return R.match_uploads(files, papers)


@query("j14_substring_join", "SELECT doc_id, item_id FROM documents JOIN (SELECT DISTINCT item_id, unnest([substr(text, 1, 5), substr(text, 10, 12), substr(text, 3, 30)]) AS key FROM benchmark) b ON key <> '' AND contains(text, key)")
def substrings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold short or longer pieces of benchmark items, wherever they stand."""
    from quarrystone.operators.retrieval import substring_join

    pieces = F.array(*[F.substring("text", a, n) for a, n in ((1, 5), (10, 12), (3, 30))])
    keys = table(spark, sf, "benchmark").select("item_id", F.explode(pieces).alias("key")).distinct()
    return substring_join(table(spark, sf, "documents").select("doc_id", "text"), keys, "text", "key").select("doc_id", "item_id")


@query("j15_hierarchy", "SELECT r_name, n_name, count(*) AS suppliers FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).join(table(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("suppliers"))


@query("k3_upsert", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, -1 FROM labels")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "labels").select("doc_id", F.lit(-1).cast("long").alias("n_chars"))
    return R.upsert(table(spark, sf, "documents").select("doc_id", "n_chars"), new, "doc_id")


@query("k5_transfer", "SELECT doc_id, CASE WHEN quality = 1 THEN 'kept' ELSE 'copied' END AS origin FROM documents LEFT JOIN labels USING (doc_id)")
def transfer(spark: SparkSession, sf: str) -> DataFrame:
    target = table(spark, sf, "labels").select("doc_id", "quality", F.lit("kept").alias("origin"))
    source = table(spark, sf, "documents").select("doc_id", F.lit("copied").alias("origin"))
    return R.transfer(source, target, "doc_id", F.col("quality") == 1).select("doc_id", "origin")


_FILES = "SELECT (event_id // 4) AS ts, event_id % 4 AS run, event_id FROM events WHERE value > 10"


@query("s11_newest_complete", f"WITH f AS ({_FILES}) SELECT ts, run, event_id FROM f WHERE ts = (SELECT max(ts) FROM (SELECT ts FROM f GROUP BY ts HAVING count(DISTINCT run) = 4))")
def newest(spark: SparkSession, sf: str) -> DataFrame:
    """An event of a value of 10 or less is a run that left no file."""
    return _newest(table(spark, sf, "events").where("value > 10"))


def _newest(events: DataFrame) -> DataFrame:
    files = events.select(F.expr("event_id div 4").alias("ts"), (F.col("event_id") % 4).alias("run"), "event_id")
    return R.newest_complete(files, "ts", "run", 4)


@query("u1_union_all", "SELECT 'd' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'p', page_id FROM pages")
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id")).unionByName(table(spark, sf, "pages").select(F.lit("p").alias("kind"), F.col("page_id").alias("id")))


@query("u2_u3_sets", "SELECT s_suppkey, CASE WHEN s_nationkey IN (1, 2, 3) THEN true ELSE false END AS shares FROM supplier")
def sets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", F.arrays_overlap(F.array("s_nationkey"), F.array(F.lit(1), F.lit(2), F.lit(3))).alias("shares"))


@query("u5_split_counts", "SELECT 30 AS train, count(*) - 30 AS test FROM documents")
def split(spark: SparkSession, sf: str) -> DataFrame:
    train, test = S.split(table(spark, sf, "documents"), "doc_id", 30)
    return train.agg(F.count(F.lit(1)).alias("train")).crossJoin(test.agg(F.count(F.lit(1)).alias("test")))


@query("u6_all_positives", "SELECT quality, CASE WHEN quality = 0 THEN (SELECT count(*) FROM labels WHERE quality = 0) ELSE greatest(80 - (SELECT count(*) FROM labels WHERE quality = 0), 0) END AS n FROM (SELECT DISTINCT quality FROM labels)")
def positives(spark: SparkSession, sf: str) -> DataFrame:
    """All of the rare class and others up to 80; a class of which none is drawn has a row as well."""
    labels = table(spark, sf, "labels")
    drawn = S.with_all_positives(labels, "doc_id", F.col("quality") == 0, 80).select("quality", F.lit(1).alias("n"))
    return drawn.unionByName(labels.select("quality", F.lit(0).alias("n"))).groupBy("quality").agg(F.sum("n").alias("n"))


@query("u9_choice")
def choice(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", S.choice("doc_id", ["P", "I", "C"]).alias("target"))
