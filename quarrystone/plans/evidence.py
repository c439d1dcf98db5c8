"""Evidence grouping, stage and graph queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import evidence as E
from quarrystone.operators import records as R

from .base import Queries, declare, placed, table

queries: Queries = {}
query = declare(queries)


@query("a3_group_papers", "SELECT l_returnflag, l_suppkey % 10 AS grp, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS papers FROM lineitem GROUP BY ALL")
def group(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_suppkey") % 10).alias("grp"), "l_partkey")
    return E.group_papers(rows, ["l_returnflag", "grp"], "l_partkey").select("l_returnflag", "grp", F.array_join(F.col("papers").cast("array<string>"), ",").alias("papers"))


@query("a4_a9_unions", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT v)), ',') AS v FROM (SELECT o_custkey, unnest([o_orderstatus, o_orderpriority]) AS v FROM orders) GROUP BY o_custkey")
def unions(spark: SparkSession, sf: str) -> DataFrame:
    values = table(spark, sf, "orders").select("o_custkey", F.explode(F.array("o_orderstatus", "o_orderpriority")).alias("v"))
    return values.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("v")), ",").alias("v"))


@query("a10_ordered_union", "SELECT conv_id, array_to_string(list_transform(list_sort(list(struct_pack(t := t, role := role))), lambda x: x.role), ',') AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) GROUP BY conv_id")
def ordered_union(spark: SparkSession, sf: str) -> DataFrame:
    """Answers merged in order, each value once at its first place."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("ts"))
    merged = F.aggregate("ts", F.array().cast("array<string>"), lambda acc, t: F.array_union(acc, F.array(t["role"])))
    return turns.select("conv_id", F.array_join(merged, ",").alias("roles"))


@query("a16_last_wins", "SELECT l_orderkey, arg_max(l_partkey, l_extendedprice) AS part FROM lineitem GROUP BY l_orderkey")
def last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Of equal prices the part stored first counts; a line without a part does not. Prices come first, so that all that is aggregated are numbers."""
    lines = placed(spark, sf, "lineitem").withColumn("_place", F.when(F.col("l_partkey").isNotNull(), F.col("_place")))
    prices = lines.groupBy("l_orderkey", "l_extendedprice").agg(F.min_by("l_partkey", "_place").alias("part"))
    return prices.groupBy("l_orderkey").agg(F.max_by("part", F.when(F.col("part").isNotNull(), F.col("l_extendedprice"))).alias("part"))


@query("a17_a18_profile", "SELECT o_custkey, count(*) AS study_number, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def profile(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("o_totalprice").alias("study_number"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("f13_assessed", "SELECT s_nationkey, sum(CASE WHEN s_suppkey % 3 = 0 THEN 102 ELSE 2 END)::BIGINT AS score FROM supplier GROUP BY s_nationkey HAVING score >= 100")
def assessed(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("Effect"), F.lit("Risk"))).otherwise(F.array(F.lit("Risk"), F.lit("Annotation")))
    return E.assessed(table(spark, sf, "supplier").withColumn("keys", keys), "s_nationkey", "keys")


@query("k9_latest_valid", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events WHERE value > 10 GROUP BY user_id")
def latest(spark: SparkSession, sf: str) -> DataFrame:
    return E.latest(table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id"], "event_id", F.col("value") > 10).select("user_id", "event_type", "event_id")


@query("o2_natural_order", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_linenumber, l_orderkey) AS n FROM lineitem")
def whole_natural(spark: SparkSession, sf: str) -> DataFrame:
    """Codes like Q.2.10 of all lines in the order of their numbers."""
    return _numbered(table(spark, sf, "lineitem"))


def _numbered(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("code", F.concat(F.lit("Q."), "l_linenumber", F.lit("."), "l_orderkey"))
    return R.numbered(rows, E.natural_key(F.col("code"))).select("l_orderkey", "l_linenumber", "n")


@query("o4_latest_name", "SELECT lang, max(source || '_' || lpad(doc_id::VARCHAR, 6, '0')) AS name FROM documents GROUP BY lang")
def latest_name(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("source", F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 6, "0"))
    return table(spark, sf, "documents").groupBy("lang").agg(F.max_by(name, name).alias("name"))


@query("o6_topological", """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
w AS (SELECT DISTINCT parent AS node, 0 AS level FROM e WHERE parent NOT IN (SELECT child FROM e) UNION ALL SELECT e.child, w.level + 1 FROM w JOIN e ON e.parent = w.node)
SELECT node, max(level)::INT AS level FROM w GROUP BY node""")
def topological(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.concat(F.lit("s"), "s_suppkey").alias("child"))
    return E.topological_levels(n.unionByName(s))


_FOREST = "SELECT 'r' || r_regionkey AS node, NULL AS parent, r_regionkey::BIGINT AS place FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 1000000000 + c_custkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, -o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)"


@query("o6_post_order", f"""WITH RECURSIVE f AS ({_FOREST}), w AS (SELECT node, [place] AS path FROM f WHERE parent IS NULL UNION ALL SELECT f.node, list_append(w.path, f.place) FROM w JOIN f ON f.parent = w.node)
SELECT node, row_number() OVER (ORDER BY list_append(path, 9000000000000000000)) AS position FROM w""")
def post_order(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, nations, suppliers, customers and their orders (newest number first) as a forest, children before their parent."""
    def level(name: str, key: str, prefix: str, parent: str | None, above: str, place: Column) -> DataFrame:
        up = F.concat(F.lit(above), parent) if parent else F.lit(None).cast("string")
        return table(spark, sf, name).select(F.concat(F.lit(prefix), key).alias("node"), up.alias("parent"), place.cast("long").alias("place"))

    customers = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("parent"))
    rows = [level("region", "r_regionkey", "r", None, "", F.col("r_regionkey")), level("nation", "n_nationkey", "n", "n_regionkey", "r", F.col("n_nationkey")), level("supplier", "s_suppkey", "s", "s_nationkey", "n", F.col("s_suppkey")),
            level("customer", "c_custkey", "c", "c_nationkey", "n", F.col("c_custkey") + 1000000000), level("orders", "o_orderkey", "o", "o_custkey", "c", -F.col("o_orderkey")).join(customers, "parent", "left_semi").select("node", "parent", "place")]
    return E.post_order(reduce(DataFrame.unionByName, rows))


_LOG = "SELECT user_id AS entity, event_id AS seq, CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' WHEN 'purchase' THEN 'c' WHEN 'error' THEN 'd' ELSE 'e' END AS key, CASE WHEN event_id % 7 <> 0 THEN (floor(value)::BIGINT % 3)::VARCHAR END AS value FROM events"


@query("stages_cascade", f"""WITH RECURSIVE log AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq) AS n FROM ({_LOG})),
w AS (SELECT entity, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS key, NULL::VARCHAR AS value, false AS effective, NULL::VARCHAR AS a, NULL::VARCHAR AS b, NULL::VARCHAR AS c, NULL::VARCHAR AS d FROM (SELECT DISTINCT entity FROM log)
  UNION ALL SELECT x.entity, x.n, x.seq, x.key, x.value, x.changed, CASE WHEN x.changed AND x.key = 'a' THEN x.value ELSE x.a END,
    CASE WHEN x.changed AND x.key = 'b' THEN x.value ELSE x.b END, CASE WHEN x.changed AND x.key = 'c' THEN x.value WHEN x.changed AND x.key IN ('a', 'b') THEN NULL ELSE x.c END,
    CASE WHEN x.changed AND x.key = 'd' THEN x.value WHEN x.changed AND x.key IN ('a', 'b', 'c') THEN NULL ELSE x.d END
  FROM (SELECT log.entity, log.n, log.seq, log.key, log.value, w.a, w.b, w.c, w.d, coalesce(CASE log.key WHEN 'a' THEN w.a IS DISTINCT FROM log.value WHEN 'b' THEN w.b IS DISTINCT FROM log.value
    WHEN 'c' THEN w.c IS DISTINCT FROM log.value WHEN 'd' THEN w.d IS DISTINCT FROM log.value END, false) AS changed FROM w JOIN log ON log.entity = w.entity AND log.n = w.n + 1) x)
SELECT entity, seq, key, value, effective, a AS now_a, b AS now_b, c AS now_c, d AS now_d,
  CASE WHEN a IS NULL OR b IS NULL THEN 0 WHEN c IS NULL THEN 1 WHEN d IS NULL THEN 2 ELSE 3 END AS stage FROM w WHERE n > 0""")
def cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Events as updates of three stages' outputs (a and b, c, d): what each changes and clears, and the state after it."""
    key = F.lit("e")
    for kind, name in (("click", "a"), ("view", "b"), ("purchase", "c"), ("error", "d")):
        key = F.when(F.col("event_type") == kind, name).otherwise(key)
    value = F.when(F.col("event_id") % 7 != 0, (F.floor("value").cast("long") % 3).cast("string"))
    log = table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("seq"), key.alias("key"), value.alias("value"))
    return E.cascade(log, [["a", "b"], ["c"], ["d"]])


@query("g_delete_triplets", "SELECT id FROM (SELECT DISTINCT 'n' || s_nationkey AS id, s_nationkey AS k FROM supplier) x WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = k AND s_suppkey % 4 <> 0) UNION SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0")
def delete(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes left when the links of every fourth supplier go."""
    edges = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("subj"), F.lit("in").alias("rel"), F.concat(F.lit("n"), "s_nationkey").alias("obj"), "s_suppkey")
    nodes = edges.select(F.explode(F.array("subj", "obj")).alias("id")).distinct()
    return E.delete_triplets(edges.drop("s_suppkey"), nodes, edges.where("s_suppkey % 4 = 0").drop("s_suppkey"))[1]


@query("t26_graph_elements", "SELECT n_nationkey, 2 AS nodes, 1 AS links, n_name AS subj FROM nation")
def elements(spark: SparkSession, sf: str) -> DataFrame:
    a = F.concat(F.lit("Node(id='"), "n_name", F.lit("', type='N')"))
    text = F.concat(a, F.lit("\nNode(id='r', type='R')\nRelationship(subj="), a, F.lit(", obj=Node(id='r', type='R'), type='IN')\nRelationship(subj="), a, F.lit(", obj=Node(id='?', type='R'), type='IN')"))
    rows = table(spark, sf, "nation").select("n_nationkey", E.graph_elements(text).alias("g"))
    return rows.select("n_nationkey", F.size("g.nodes").cast("long").alias("nodes"), F.size("g.links").cast("long").alias("links"), F.expr("g.links[0].subj").alias("subj"))


_ART = "SELECT c_custkey AS pico_idx, stage, CASE WHEN stage = 'b' AND c_custkey % 3 = 0 THEN 'stale' ELSE 'o' || (p - 1) END AS input_hash, 'o' || p AS output_hash FROM customer, (VALUES ('a', 1), ('b', 2), ('c', 3)) s(stage, p) WHERE NOT (stage = 'a' AND c_custkey % 5 = 0)"


@query("stages_valid", f"WITH a AS ({_ART}) SELECT pico_idx, stage, CASE WHEN pico_idx % 5 = 0 THEN false WHEN stage = 'a' THEN true ELSE pico_idx % 3 <> 0 END AS valid FROM a")
def stages(spark: SparkSession, sf: str) -> DataFrame:
    return E.valid_stages(_artifacts(spark, sf), ["a", "b", "c"])


@query("stages_current", "SELECT c_custkey AS pico_idx, CASE WHEN c_custkey % 3 = 0 THEN 'a' ELSE 'c' END AS stage FROM customer WHERE c_custkey % 5 <> 0")
def current(spark: SparkSession, sf: str) -> DataFrame:
    return E.current_stage(_artifacts(spark, sf), ["a", "b", "c"])


def _artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Three stages of every customer, some of them stale or missing, with an outdated version of each."""
    kinds = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(p).alias("p")) for s, p in (("a", 1), ("b", 2), ("c", 3))])
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("pico_idx"), F.inline(kinds)).where("NOT (stage = 'a' AND pico_idx % 5 = 0)")
    stale = (F.col("stage") == "b") & (F.col("pico_idx") % 3 == 0)
    now = rows.select("pico_idx", "stage", F.when(stale, "stale").otherwise(F.concat(F.lit("o"), F.col("p") - 1)).alias("input_hash"), F.concat(F.lit("o"), "p").alias("output_hash"), F.lit(2).alias("ts"))
    return now.unionByName(now.withColumn("ts", F.lit(1)).withColumn("output_hash", F.lit("old")))
