"""The queries of this subpackage: thin digests of the operators' results, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chats import collapse
from .common import documents
from .language_id import held_out, identify
from .line_dedup import dedup_lines
from .mixing import mix
from .neighbours import search
from .packing import pack
from .quality import RULES, STOP_WORDS, judge
from .sharding import shard
from .simhash import hex16, near_dedup
from .spelling import one_letter_lost, variants, vocabulary
from .topk import top_k
from .trie import prefix_trie
from .urls import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more lose every occurrence."""
    out = dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL["op1_line_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.r, k.doc_id
"""


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of 64-bit SimHash fingerprints within 2 bits. SQL has no XXH64; tests compare with brute force."""
    out = near_dedup(documents(spark, sf_dir))
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards of nearly equal bytes by sampled splitters; tests check the law on the result."""
    out = shard(documents(spark, sf_dir))
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to target weights of 5, 2, 1 by source; tests check targets, rates and rounding."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production threshold table."""
    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by a model learned outside the held-out fold."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query
def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url by the rules and the boosted trees."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


@query
def op7_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL["op7_chats"] = """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS place,
           count(*) OVER (PARTITION BY conv_id) AS n_turns FROM conversations),
p AS (SELECT conv_id, place, n_turns, string_agg(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n'), chr(2))
      OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS prefix FROM t),
own AS (SELECT min(conv_id) AS conv_id, n_turns, prefix FROM p WHERE place = n_turns GROUP BY n_turns, prefix),
kept AS (SELECT conv_id, n_turns FROM own WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.n_turns AND p.place = own.n_turns AND p.prefix = own.prefix))
SELECT kept.conv_id, kept.n_turns,
       string_agg('<|' || replace(replace(coalesce(role, ''), chr(92), chr(92) || chr(92)), '|', chr(92) || '|') || '|>' || chr(10)
                  || replace(replace(coalesce(text, ''), chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|') || chr(10) || '<|end|>' || chr(10), '' ORDER BY place) AS rendered
FROM kept JOIN t ON t.conv_id = kept.conv_id GROUP BY kept.conv_id, kept.n_turns
"""


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens along the curve; tests restore every document from its pieces."""
    return pack(documents(spark, sf_dir))


@query
def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every vector whose id is divisible by 100; tests measure recall against brute force."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0).drop("query_row")


_SPACE = "[ \\t\\n\\x0b\\f\\r]"
_PASSES = " AND ".join([f"{r.measure} >= {r.least}" for r in RULES if r.least is not None] + [f"{r.measure} <= {r.most}" for r in RULES if r.most is not None])
ORACLE_SQL["op9_quality"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) AS ls FROM d),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2])) AS x FROM w),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g')) AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
      len(list_filter(ws, lambda x: list_contains({STOP_WORDS!r}, translate(regexp_replace(x, '\\W+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS n_stop,
      len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
      len(list_filter(ls, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) AS n_bullets, len(list_filter(ls, lambda x: regexp_matches(rtrim(x, ' '), '(\\.\\.\\.|…)$'))) AS n_ellipses
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
m AS (SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_ratio,
      coalesce(n_stop / nullif(n_words, 0), 0) AS stop_word_ratio, coalesce(n_capitals / nullif(n_letters, 0), 0) AS capital_ratio,
      coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio, coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_word_ratio,
      coalesce(n_bullets / nullif(n_lines, 0), 0) AS bullet_line_ratio, coalesce(n_ellipses / nullif(n_lines, 0), 0) AS ellipsis_line_ratio,
      (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {_PASSES}) AS kept FROM m
"""


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of all words of 7 code points or more that occur twice."""
    words = vocabulary(documents(spark, sf_dir), change=one_letter_lost(31))
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


#: The table of CRC-32, and the checksum of a list of bytes.
_CRC_TABLE = "SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)"


def _crc(bytes_: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


_UTF8 = "flatten(list_transform(string_split(s, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))"
ORACLE_SQL["op11_spelling"] = f"""
WITH RECURSIVE crc AS MATERIALIZED ({_CRC_TABLE}),
raw AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{7,}}')) AS r FROM documents),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM raw GROUP BY 1, 2),
keyed AS (SELECT run, k, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM runs),
hashed AS (SELECT run, k, {_crc(_UTF8)} AS h FROM keyed, crc),
changed AS (SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed),
w AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT w.word, cut.word, cut.n FROM w JOIN cut ON w.word = cut.d UNION SELECT cut.word, w.word, w.n FROM w JOIN cut ON w.word = cut.d),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -near_n, near := near)) AS b FROM near GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 10 * w.n THEN b.near END AS form, CASE WHEN -b.less >= 10 * w.n THEN -b.less END AS form_n FROM w LEFT JOIN best ON w.word = best.word),
way AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT way.word, f.word, f.form FROM way JOIN f ON way.next = f.word)
SELECT f.word, f.form, way.at AS root, f.n, f.n_near, f.form_n FROM f JOIN way ON f.word = way.word AND way.next IS NULL
"""


@query
def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every vector whose id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0).drop("query_vector")


ORACLE_SQL["op12_topk"] = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.e AS query_vector, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND (c.vec_id <> q.vec_id OR c.e <> q.e))
SELECT query_id, row_number() OVER (PARTITION BY query_id, query_vector ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""


@query
def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), every=5, most=9)


_DIGITS = "list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
ORACLE_SQL["op13_trie"] = f"""
WITH crc AS MATERIALIZED ({_CRC_TABLE}),
t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, max(place) AS n, c - c % 5 AS base FROM t GROUP BY c),
h AS (SELECT c, n, base, {_crc(_DIGITS)} % 9 AS h FROM own, crc),
b AS (SELECT h.c, h.base, h.h, least(h.h, coalesce(o.n, 0)) AS held FROM h LEFT JOIN own o ON h.base = o.c),
re AS (SELECT b.c, place AS d, r, x FROM b JOIN t ON t.c = b.base AND place <= h UNION ALL
       SELECT b.c, place - h + held, r, x FROM b JOIN t ON t.c = b.c AND place > h UNION ALL SELECT c, 0, '', '' FROM b),
p AS MATERIALIZED (SELECT c, d, strlen(x) AS bytes, max(d) OVER (PARTITION BY c) AS n, md5(string_agg(r || chr(1) || x, chr(2)) OVER (PARTITION BY c ORDER BY d)) AS k FROM re),
node AS MATERIALIZED (SELECT d, k, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved, (max(n) = d)::BIGINT AS leaf, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d) AS own FROM p GROUP BY d, k),
under AS (SELECT p.d, p.k, sum(leaf) AS leaves, sum(saved) AS saved, count(*) FILTER (WHERE node.d = p.d + 1) AS children FROM node JOIN p ON p.c = node.c AND p.d <= node.d GROUP BY p.d, p.k)
SELECT node.c AS conv_id, node.d AS depth, up.c AS parent_conv_id, n_convs, children AS n_children, leaves::BIGINT AS n_leaves, under.saved::BIGINT AS saved_tokens, sha256(coalesce(own, '')) AS ends_sha256
FROM node JOIN under ON under.d = node.d AND under.k = node.k
LEFT JOIN (SELECT p.c AS member, p.d + 1 AS d, n.c FROM p JOIN node n ON n.d = p.d AND n.k = p.k) up ON up.member = node.c AND up.d = node.d
"""
