"""Text queries over documents, pages and conversations."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import ids
from quarrystone.functions import text as X
from quarrystone.operators import records, segments
from quarrystone.scratch import shared_folder
from quarrystone.sources.paged import paged

from .base import Queries, declare, table

queries: Queries = {}
query = declare(queries)
_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+(?:[-''][a-z0-9]+)?')"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


@query("t1_tokenize", f"SELECT doc_id, len({_TOKENS}) AS n_tokens, len(list_distinct({_TOKENS})) AS n_terms, array_to_string({_TOKENS}[1:5], ' ') AS first FROM documents")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    t = X.tokenize(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_terms"), F.array_join(F.slice(t, 1, 5), " ").alias("first"))


_CLEAN = "replace(replace(text, chr(13), ' '), chr(10), ' ')"
for _ in range(2):
    _CLEAN = f"regexp_replace({_CLEAN}, '([A-Za-z])-\\s+([a-z])', '\\1\\2', 'g')"
_CLEAN = f"regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '\\s+([,.;:)\\]])', '\\1', 'g'), '([(\\[])\\s+', '\\1', 'g'), '\\s+', ' ', 'g')"
for _joined, _fixed in X.JOINED_WORDS.items():
    _CLEAN = f"replace({_CLEAN}, '{_joined}', '{_fixed}')"
_CLEAN = f"trim({_CLEAN})"


@query("t2_clean_text", f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents")
def clean(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


@query("t3_normalize_topic", f"SELECT doc_id, trim(regexp_replace({_CLEAN.replace('(text', '(topic')}, '^\\d+\\.\\s*', '')) AS topic FROM (SELECT doc_id, doc_id || '.  ' || text AS topic FROM documents)")
def whole_topic(spark: SparkSession, sf: str) -> DataFrame:
    return _topic(_docs(spark, sf))


def _topic(docs: DataFrame) -> DataFrame:
    numbered = docs.select("doc_id", F.concat("doc_id", F.lit(".  "), "text").alias("topic"))
    return numbered.select("doc_id", X.normalize_topic(F.col("topic"), unescape=False).alias("topic"))


@query("t6_numbered_items", "SELECT l_orderkey, count(*) AS items, min(l_linenumber || '. Item ' || l_partkey) AS first FROM lineitem GROUP BY l_orderkey")
def numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as texts of numbered items, split again."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.concat("l_linenumber", F.lit(". Item "), "l_partkey").alias("item"))
    texts = rows.groupBy("l_orderkey").agg(F.concat(F.lit("lead-in "), F.array_join(F.sort_array(F.collect_list("item")), " ")).alias("text"))
    items = X.split_numbered(F.col("text"))
    return texts.select("l_orderkey", F.size(items).cast("long").alias("items"), F.array_min(items).alias("first"))


@query("t7_questions", "SELECT p_partkey, 'Which first-line ' || p_name || ' (a) & b ?' AS question FROM part UNION ALL SELECT p_partkey, 'Is it ' || p_type || '?' AS question FROM part")
def questions(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("Topic Which first-\n line "), "p_name", F.lit(" ( a )  &amp; b ? Is\r\nit "), "p_type", F.lit("? How so."))
    return table(spark, sf, "part").select("p_partkey", F.explode(X.split_questions(text)).alias("question"))


@query("t11_dedupe_in_order", f"SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(l), lambda x: struct_pack(p := list_position(l, x), v := x))), lambda s: s.v), chr(10)) AS lines FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_CLEAN.replace('(text', '(x')}), lambda x: x <> '') AS l FROM documents)")
def dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.array_join(X.dedupe(F.split("text", "\n")), "\n").alias("lines"))


@query("t12_fenced_json", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS value FROM events")
def whole_fenced(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's properties as a fenced reply; the object is found and its first key in order read."""
    reply = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone."))
    rows = table(spark, sf, "events").select("event_id", X.json_object(reply).alias("json"))
    parsed = F.from_json("json", "map<string,string>")
    return rows.select("event_id", F.get(F.map_values(parsed), F.lit(0)).alias("value"))


@query("t13_tags", "SELECT page_id, regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1)[1] AS title, len(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) AS paragraphs FROM pages")
def tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.get(X.tagged(F.col("html"), "title"), F.lit(0)).alias("title"), F.size(X.tagged(F.col("html"), "p")).cast("long").alias("paragraphs"))


@query("t14_options", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN c_mktsegment END AS choice FROM customer")
def options(spark: SparkSession, sf: str) -> DataFrame:
    reply = F.concat(F.lit("I think <option> "), "c_mktsegment", F.lit(" </option>."))
    return table(spark, sf, "customer").select("c_custkey", X.option(reply, ["AUTOMOBILE", "BUILDING"]).alias("choice"))


@query("t15_pico_lines", "SELECT s_suppkey, s_name AS p, 'rate ' || s_nationkey AS i, 'P - ' || s_name AS rendered FROM supplier")
def pico_lines(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("P - "), "s_name", F.lit("\nI – rate "), "s_nationkey", F.lit("\nP "), "s_name")
    p = X.pico_line(text, "P")
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(p, ";").alias("p"), F.array_join(X.pico_line(text, "I"), ";").alias("i"), X.render_pico("P", p).alias("rendered"))


@query("t18_w4_runs", """WITH r AS (SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS new FROM (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'user' ELSE role END AS role, text FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM r)
SELECT conv_id, run::BIGINT AS run, any_value(role) AS section, string_agg(text, ' ' ORDER BY turn) AS text FROM g GROUP BY conv_id, run""")
def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive turns of one side merged."""
    rows = table(spark, sf, "conversations").withColumn("role", F.when(F.col("role") == "system", "user").otherwise(F.col("role")))
    return segments.merge_runs(rows, ["conv_id"], "turn", "role", "text").withColumnRenamed("role", "section")


@query("t18_sections_without_references", """SELECT conv_id, count(*) AS turns FROM conversations WHERE role <> 'system' GROUP BY conv_id""")
def sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = segments.skip_sections(table(spark, sf, "conversations"), "role", ["system"])
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))


@query("w3_heading_groups", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
g AS (SELECT *, sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM l)
SELECT doc_id, grp::BIGINT AS section, min(line) FILTER (WHERE length(line) < 40) AS heading, coalesce(string_agg(line, ' ' ORDER BY pos) FILTER (WHERE length(line) >= 40), '') AS body FROM g WHERE grp > 0 GROUP BY doc_id, grp""")
def heading_groups(spark: SparkSession, sf: str) -> DataFrame:
    """A short line opens a section; the lines after it are its body."""
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return segments.sections(lines, ["doc_id"], "pos", "line", F.length("line") < 40)


@query("t19_chunks", """SELECT doc_id, unnest(range(greatest(1, ceil((length(text) - 400) / 1600.0)::BIGINT))) AS chunk, substring(text, unnest(range(greatest(1, ceil((length(text) - 400) / 1600.0)::BIGINT))) * 1600 + 1, 2000) AS piece FROM documents""")
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of 2000 characters that overlap by 400."""
    return segments.windows(_docs(spark, sf), "doc_id", "text", 2000, 400)


@query("t19_recursive_chunks")
def recursive_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of at most 2000 characters cut at paragraphs, lines, sentences, words, which overlap by up to 400."""
    return segments.recursive_chunks(_docs(spark, sf), "doc_id", "text")


@query("t24_chunks_by_lines", """WITH RECURSIVE x AS (SELECT 1) SELECT doc_id, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def line_totals(spark: SparkSession, sf: str) -> DataFrame:
    """What chunks by lines hold in all: no line and no character is lost."""
    got = segments.pack_lines(_docs(spark, sf), "doc_id", "text", 500)
    return got.groupBy("doc_id").agg(F.sum("lines").alias("lines"), F.sum(F.length("piece") - F.col("lines") + 1).alias("chars"))


@query("t24_chunk_by_title")
def title_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents, short ones as titles, in chunks of at most 500 characters."""
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return segments.chunk_by_title(lines, "doc_id", "pos", F.length("line") < 40, "line", 500)


_BLOCKS = """SELECT doc_id, i, i // 2 AS page, CASE (doc_id * 31 + i * 17) % 11 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'Questions:' ELSE 'questions' END WHEN 1 THEN 'Statements (imaging ' || i % 3 || ')' WHEN 2 THEN 'Discussion ' || line
  WHEN 3 THEN CASE WHEN i > 24 THEN 'Ready to submit ' || line ELSE line END WHEN 4 THEN CASE WHEN doc_id % 3 = 0 THEN 'References ' || line ELSE line END ELSE i || '. ' || line END AS text
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""


@query("t10_guideline_sections", f"""WITH b AS ({_BLOCKS}),
k AS (SELECT *, CASE WHEN text IN ('Questions:', 'questions') THEN 'Q' WHEN starts_with(text, 'Statements (') THEN 'S' WHEN starts_with(text, 'Discussion') THEN 'D' WHEN starts_with(text, 'References') THEN 'R' WHEN starts_with(text, 'Ready to submit') THEN 'E' ELSE 'T' END AS kind FROM b),
h AS (SELECT *, last_value(CASE WHEN kind IN ('Q', 'S') THEN i END IGNORE NULLS) OVER p AS head, last_value(CASE WHEN kind IN ('Q', 'S') THEN kind END IGNORE NULLS) OVER p AS under,
  max(CASE WHEN kind = 'D' THEN i END) OVER p AS said, count(*) FILTER (WHERE kind = 'Q') OVER (PARTITION BY doc_id ORDER BY i) - 1 AS section FROM k WINDOW p AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, under = 'S' AND coalesce(said, -1) < head AS open FROM h),
e AS (SELECT doc_id, min(i) AS stop FROM o WHERE kind IN ('R', 'E') AND open OR kind = 'R' AND page >= 15 AND under IS DISTINCT FROM 'Q' GROUP BY doc_id),
v AS (SELECT o.* FROM o LEFT JOIN e ON o.doc_id = e.doc_id WHERE stop IS NULL OR i < stop),
t AS (SELECT doc_id, head, string_agg(text, ' ' ORDER BY i) AS body FROM v WHERE kind NOT IN ('Q', 'S') AND (under = 'Q' OR open AND kind = 'T') GROUP BY doc_id, head)
SELECT v.doc_id, v.section, CASE v.kind WHEN 'Q' THEN 'questions' ELSE 'statement' END AS kind, CASE v.kind WHEN 'S' THEN v.text END AS title, coalesce(t.body, '') AS body, row_number() OVER (PARTITION BY v.doc_id ORDER BY v.i) AS part
FROM v LEFT JOIN t ON v.doc_id = t.doc_id AND v.i = t.head WHERE v.kind IN ('Q', 'S')""")
def guideline(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as blocks, some of them headings, read by the section parser."""
    return segments.guideline_sections(_blocks(spark, sf), "doc_id", "page", "i", "text")


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    what, i, line = (F.col("doc_id") * 31 + F.col("i") * 17) % 11, F.col("i"), F.col("line")
    text = (
        F.when(what == 0, F.when(F.col("doc_id") % 2 == 0, "Questions:").otherwise("questions"))
        .when(what == 1, F.concat(F.lit("Statements (imaging "), i % 3, F.lit(")")))
        .when(what == 2, F.concat(F.lit("Discussion "), line))
        .when((what == 3) & (i > 24), F.concat(F.lit("Ready to submit "), line))
        .when((what == 4) & (F.col("doc_id") % 3 == 0), F.concat(F.lit("References "), line))
        .when((what == 3) | (what == 4), line)
        .otherwise(F.concat(i, F.lit(". "), line))
    )
    return rows.select("doc_id", "i", F.floor(i / 2).cast("int").alias("page"), text.alias("text"))


@query("t8_recommendations", """SELECT p_partkey, 'Recommendation ' || p_size || '.1 Use ' || p_name || ' (early) [QoE: High]' || chr(10) || 'Recommendation ' || p_size || '.2 Avoid ' || p_type AS spans FROM part""")
def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of a guideline's text, broken lines and spaced brackets repaired, cut after the evidence or at a stop, once each."""
    k, n, t = F.col("p_size"), F.col("p_name"), F.col("p_type")
    twice = [F.lit("Recommendation "), k, F.lit(".2 Avoid\n"), t, F.lit(" Statement "), k, F.lit(".3 other ")]
    text = F.concat(F.lit("Lead. Recommendation "), k, F.lit(".1 Use\n"), n, F.lit(" ( early ) [QoE: High] rest. Comment: none "), *twice, *twice)
    return table(spark, sf, "part").select("p_partkey", F.array_join(segments.recommendation_spans(text), "\n").alias("spans"))


@query("t9_page_recommendations", """SELECT s_nationkey, number, number || CASE s_suppkey % 3 WHEN 0 THEN ' We recommend ' || s_name || ' #QoE low#' ELSE ' Preferred is ' || s_name || ' SoR' END AS text
FROM (SELECT *, (1 + s_suppkey % 7) || '.' || s_suppkey AS number FROM supplier) WHERE s_suppkey % 25 <= 19 AND s_suppkey % 3 < 2""")
def page_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered spans on the first pages; spans with a grade that recommend nothing are left out."""
    number = F.concat((F.col("s_suppkey") % 7 + 1).cast("string"), F.lit("."), "s_suppkey")
    kinds = [(0, " We recommend ", " #QoE low# and more"), (1, " Preferred is ", " SoR Discussion long"), (2, " Graded is ", " SoR")]
    text = F.coalesce(*[F.when(F.col("s_suppkey") % 3 == k, F.concat(number, F.lit(a), "s_name", F.lit(b))) for k, a, b in kinds])
    blocks = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") % 25).alias("page"), text.alias("text"))
    return segments.page_recommendations(blocks, "s_nationkey", "page", "s_suppkey", "text")


@query("t20_format_docs", """SELECT source, string_agg('[' || rn || '] ' || text, chr(10) ORDER BY rn) AS context FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3 GROUP BY source""")
def whole_format_docs(spark: SparkSession, sf: str) -> DataFrame:
    return _format(_docs(spark, sf))


def _format(docs: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window

    ranked = docs.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("rn <= 3")
    return segments.numbered_context(ranked, ["source"], "rn", "text").withColumnRenamed("text", "context")


@query("t21_normalize", "SELECT doc_id, trim(regexp_replace(lower(text), '[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) AS normal, regexp_matches(text, '[\\x{3400}-\\x{9FFF}]') AS cjk FROM documents")
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", X.normalize_spaces(F.col("text")).alias("normal"), X.has_cjk(F.col("text")).alias("cjk"))


@query("t22_default_bricks", """SELECT doc_id, trim(regexp_replace(regexp_replace(translate(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), chr(10), ' '), '[ ]+', ' ', 'g'), '[ ]+', ' ', 'g')) AS cleaned FROM documents""")
def bricks(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", X.apply_bricks(F.col("text")).alias("cleaned"))


@query("t23_extract", f"""SELECT doc_id, len(regexp_extract_all(text, '{X.EMAIL}')) AS emails, len(regexp_extract_all(text, '{X.IPV4}')) AS ips, len(regexp_extract_all(text, '{X.US_PHONE}')) AS phones FROM documents""")
def extract(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    return _docs(spark, sf).select("doc_id", *[F.size(X.extract_all(c, k)).cast("long").alias(n) for k, n in (("email", "emails"), ("ip_address", "ips"), ("us_phone", "phones"))])


@query("t23_header", """SELECT s_suppkey, 'H' || s_suppkey || '.DEF.local' AS ip_address_name, 'ba23::58b5:2236:45a2:88b2' AS ipv6_address, '32.88.' || s_suppkey || '.123' AS mapi_id, 'Fri, 26 Mar 2021 11:04:09 +1200' AS datetime FROM supplier""")
def header(spark: SparkSession, sf: str) -> DataFrame:
    """What a mail's header holds."""
    text = F.concat(F.lit("from H"), "s_suppkey", F.lit(".DEF.local ([ba23::58b5:2236:45a2:88b2]) with mapi id 32.88."), "s_suppkey", F.lit(".123; Fri, 26 Mar 2021 11:04:09 +1200"))
    kinds = ("ip_address_name", "ipv6_address", "mapi_id", "datetime")
    return table(spark, sf, "supplier").select("s_suppkey", *[F.array_join(X.extract_all(text, k), "|").alias(k) for k in kinds])


@query("t23_before_after", "SELECT page_id, rtrim(split_part(url, '://', 1)) AS scheme, ltrim(substring(url, instr(url, '://') + 3)) AS rest FROM pages")
def before_after(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.text_before(F.col("url"), "://").alias("scheme"), X.text_after(F.col("url"), "://").alias("rest"))


@query("t25_newlines", "SELECT doc_id, regexp_replace(text, '\\s*\\n\\s*', chr(10), 'g') AS collapsed FROM documents")
def newlines(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", X.collapse_newlines(F.col("text")).alias("collapsed"))


@query("t5_table_rows", "SELECT n_nationkey, 2 AS n_rows, n_name AS cell FROM nation")
def tables(spark: SparkSession, sf: str) -> DataFrame:
    html = F.concat(F.lit("<div><table><tr><th>key</th><th>name</th></tr><tr><td>1</td><td> "), "n_name", F.lit(" </td></tr></table><table><tr><td>no</td></tr></table>"))
    rows = X.table_rows(html)
    return table(spark, sf, "nation").select("n_nationkey", rows.alias("rows")).select("n_nationkey", F.size("rows").cast("long").alias("n_rows"), F.expr("rows[1][1]").alias("cell"))


@query("t27_keywords", "SELECT doc_id, regexp_matches(lower(text), 'idiot|worthless|pathetic|clown') AS hit FROM documents")
def keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Whether any keyword occurs."""
    words = F.array(*[F.lit(w) for w in ("idiot", "worthless", "pathetic", "clown")])
    return _docs(spark, sf).select("doc_id", F.exists(words, lambda w: F.contains(F.lower("text"), w)).alias("hit"))


@query("ids_paper_uid", "SELECT doc_id, substring(sha256(CASE WHEN doc_id % 3 = 0 THEN 'PM' || doc_id WHEN doc_id % 3 = 1 THEN '10.1/' || doc_id ELSE lang || text END), 1, 8) AS uid FROM documents")
def paper_uid(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    pmid = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("PM"), "doc_id"))
    doi = F.when(F.col("doc_id") % 3 < 2, F.concat(F.lit("10.1/"), "doc_id"))
    return d.select("doc_id", ids.paper_uid(pmid, doi, F.col("lang"), F.col("text")).alias("uid"))


@query("ids_keys", "SELECT n_nationkey, '_c' || substring(md5(n_name), 1, 6) AS postfix, substring(sha256(n_name || 'x' || n_regionkey), 1, 8) AS outcome, substring(sha256(n_name || 'set'), 1, 8) AS pico FROM nation")
def keys(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_name")
    return table(spark, sf, "nation").select("n_nationkey", ids.comparator_postfix(n).alias("postfix"), ids.outcome_uid(n, F.lit("x"), F.col("n_regionkey").cast("string")).alias("outcome"), ids.pico_idx(n, F.lit("set"), F.lit("auto")).alias("pico"))


@query("s6_paged_source", "SELECT doc_id, n_chars, source, c + (r - c) // 350 * 350 AS start FROM (SELECT *, r // 9900 * 9900 AS c FROM (SELECT *, row_number() OVER (ORDER BY doc_id, text, source) - 1 AS r FROM documents))")
def paged_source(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages of a service (files in the shared folder, a page each), read through the paged source."""
    docs = _docs(spark, sf)
    placed = records.numbered(docs, F.col("doc_id"), F.col("text"), F.col("source")).select("doc_id", "n_chars", "source", (F.col("n") - 1).alias("r"))
    chunk = F.expr("r div 9900 * 9900")
    pages = placed.withColumn("start", chunk + F.floor((F.col("r") - chunk) / 350) * 350)
    root = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    pages.repartition("start").withColumn("page", F.col("start")).drop("r").write.partitionBy("page").parquet(root)

    def fetch(start: int, size: int) -> pa.Table:
        files, path = pa.fs.FileSystem.from_uri(f"{root}/page={start}")
        return ds.dataset(path, filesystem=files, format="parquet", partitioning=None).to_table().select(["doc_id", "n_chars", "source", "start"])

    return paged(spark, fetch, docs.count(), pages.select("doc_id", "n_chars", "source", "start").schema)
