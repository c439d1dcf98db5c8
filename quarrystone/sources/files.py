"""Readers of the record files. Paths may lie in any store that Spark reads."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.functions.projection import normalize_pico
from quarrystone.functions.text import clean_text, collapse_newlines
from quarrystone.operators.records import newest_complete, violations

from . import schemas as S


def array_file(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Files that hold one JSON array of objects each."""
    return spark.read.schema(schema).json(path, multiLine=True)


def kb_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid records with an ordinal by question_id, rejected records with the rules they break)."""
    rows = array_file(spark, path, S.KB_RECORD)
    rules = {name: F.length(F.trim(name)) > 0 for name in ("question_id", "question", "search_text")} | {"answer": F.size("answer") > 0}
    bad = violations(rows, rules)
    fine = F.lit(True)
    for ok in rules.values():
        fine = fine & F.coalesce(ok, F.lit(False))
    return rows.where(fine), bad


def questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions with their frame normalised, rows without a question)."""
    rows = array_file(spark, path, S.QUESTION)
    good = F.length(F.trim(F.coalesce("question", F.lit("")))) > 0
    return rows.where(good).withColumn("pico", normalize_pico(F.coalesce("pico", F.lit("{}")))), rows.where(~good)


def pico(spark: SparkSession, path: str, index: str) -> DataFrame:
    """The frame of one index, which must be there: it is looked for at once, else ValueError. Outcomes may be lists or numbered text."""
    rows = array_file(spark, path, S.PICO).where(F.col("Index") == index)
    if rows.isEmpty():
        raise ValueError(f"no index {index} in {path}")
    listed = F.from_json("C", "array<string>")
    lists = F.from_json("O", "map<string,array<string>>", {"mode": "PERMISSIVE"})
    texts = F.from_json("O", "map<string,string>")
    from_text = F.transform_values(texts, lambda _, v: F.filter(F.transform(F.split(v, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\d+\.\s*", ""))), lambda x: x != ""))
    is_text = F.exists(F.map_values(texts), lambda v: ~F.startswith(F.trim(v), F.lit("[")))
    return rows.select("Index", "Question", "P", "I", F.coalesce(listed, F.array("C")).alias("C"), F.when(is_text, from_text).otherwise(lists).alias("O"))


_BLOCKS = T.ArrayType(T.StructType([T.StructField("page_idx", T.IntegerType()), T.StructField("index", T.IntegerType()), T.StructField("block_type", T.StringType()), T.StructField("text", T.StringType())]))


def _block_text(block: dict) -> Iterator[str]:
    for line in block.get("lines") or []:
        for span in line.get("spans") or []:
            yield from (str(span[k]) for k in ("content", "html") if span.get(k))
    for key in ("blocks", "sub_blocks"):
        for child in block.get(key) or []:
            yield from _block_text(child)


@F.pandas_udf(_BLOCKS)
def _blocks(text: pd.Series) -> pd.Series:
    def parse(t: str) -> list[dict]:
        out = []
        for page in json.loads(t).get("pdf_info") or []:
            for block in page.get("para_blocks") or []:
                joined = " ".join(_block_text(block))
                if joined.strip():
                    out.append({"page_idx": int(page.get("page_idx", -1)), "index": int(block.get("index", -1)), "block_type": str(block.get("type", "")), "text": joined})
        return out

    return text.map(parse)


def guideline_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, page_idx, index, block_type, text) of parsed guideline files: nested blocks joined, empty ones left out."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.explode(_blocks("value")).alias("b"))
    return files.select("file", "b.page_idx", "b.index", "b.block_type", clean_text(F.col("b.text")).alias("text"))


def screening_runs(spark: SparkSession, paths: str | list[str], pico_idx: str, runs: int) -> DataFrame:
    """The rows of the newest complete batch of ``{pico}_exp_{i}-{stamp}.csv`` files, with run and stamp."""
    rows = spark.read.csv(paths, schema=S.SCREENING, header=True, multiLine=True, escape='"', pathGlobFilter=f"{pico_idx}_exp_*.csv")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    rows = rows.withColumn("run", F.regexp_extract(name, r"_exp_(\d+)-", 1).cast("int")).withColumn("stamp", F.regexp_extract(name, r"_exp_\d+-(.+)\.csv$", 1))
    files = rows.select("stamp", "run").distinct()
    return rows.join(newest_complete(files, "stamp", "run", runs), ["stamp", "run"], "left_semi").where(F.col("run") < runs)


def literature(spark: SparkSession, path: str) -> DataFrame:
    """Literature records of a MEDLINE XML file; books have another row tag and are not read."""
    rows = spark.read.schema(S.MEDLINE).format("xml").option("rowTag", "PubmedArticle").option("valueTag", "_VALUE").load(path)
    a = "MedlineCitation.Article"
    parts = F.col(f"{a}.Abstract.AbstractText")
    labelled = F.filter(parts, lambda x: x["_Label"].isNotNull() & x["_VALUE"].isNotNull())
    plain = F.filter(F.transform(parts, lambda x: x["_VALUE"]), lambda x: x.isNotNull())
    abstract = F.when(F.size(labelled) > 0, F.array_join(F.transform(labelled, lambda x: F.concat(x["_Label"], F.lit(": "), x["_VALUE"])), "\n")).when(F.size(plain) > 0, F.array_join(plain, "\n"))
    dois = F.filter(F.col(f"{a}.ELocationID"), lambda x: x["_EIdType"] == "doi")
    date = F.concat_ws("-", *[F.coalesce(F.col(f"{a}.ArticleDate.{p}"), F.lit("")) for p in ("Year", "Month", "Day")])
    title = F.col(f"{a}.ArticleTitle._VALUE")
    types = F.filter(F.transform(F.col(f"{a}.PublicationTypeList.PublicationType"), lambda x: x["_VALUE"]), lambda x: x.isNotNull())
    return rows.select(
        F.col("MedlineCitation.PMID._VALUE").alias("Paper_Index"),
        F.when(title != "[Not Available].", title).alias("Title"),
        F.when(date != "--", date).alias("Published"),
        abstract.alias("Abstract"),
        F.when(F.size(dois) > 0, F.element_at(dois, -1)["_VALUE"]).alias("Digital Object Identifier"),
        F.coalesce(types, F.array().cast("array<string>")).alias("Publication Types"),
    )


def tei_sections(spark: SparkSession, path: str) -> DataFrame:
    """(file, section_title, para, text) of every sentence of TEI files."""
    rows = spark.read.schema(S.TEI).format("xml").option("rowTag", "div").option("valueTag", "_VALUE").load(path)
    paras = rows.select(F.col("_metadata.file_path").alias("file"), F.coalesce("head", F.lit("")).alias("section_title"), F.posexplode("p").alias("para", "p"))
    return paras.select("file", "section_title", "para", F.explode("p.s").alias("s")).select("file", "section_title", "para", F.col("s._VALUE").alias("text"), F.col("s._coords").alias("coords"))


def tables_only(elements: DataFrame, category: str = "category", description: str = "description") -> DataFrame:
    """Elements that are tables and whose description does not call them invalid."""
    return elements.where((F.col(category) == "Table") & ~F.contains(F.coalesce(description, F.lit("")), F.lit("Invalid Table")))


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, name, modified, length) of the files under a path, each once; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "modificationTime", "length")
    return files.select(F.col("path").alias("file"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("modificationTime").alias("modified"), "length").dropDuplicates(["file"])


def paired_outputs(files: DataFrame) -> DataFrame:
    """(postfix, paper_file, outcome_file): paperinfo and outcomeinfo files of the same postfix; files of papers that were assessed but not included are left out."""
    def kind(prefix: str, out: str) -> DataFrame:
        named = files.withColumn("postfix", F.regexp_extract("name", rf"^{prefix}_(.+)\.json$", 1))
        return named.where((F.col("postfix") != "") & ~F.endswith("postfix", F.lit("_full_text_assessed_but_not_included"))).select("postfix", F.col("file").alias(out))

    return kind("paperinfo", "paper_file").join(kind("outcomeinfo", "outcome_file"), "postfix")


def valid_json(files: DataFrame, content: str = "value", kind: str = "array") -> DataFrame:
    """Files whose text parses as JSON of the kind; others give null, never an error."""
    v = F.try_parse_json(content)
    fits = F.upper(F.schema_of_variant(v)).startswith(kind.upper()) if kind == "array" else F.upper(F.schema_of_variant(v)).startswith("OBJECT")
    return files.withColumn("json", F.when(fits, v))


def study_design(text: Column) -> Column:
    """A design by its name or value; null for anything else."""
    out = F.lit(None).cast("string")
    for name, value in S.STUDY_DESIGNS.items():
        out = F.when(F.lower(F.trim(text)).isin(name.lower(), value.lower()), value).otherwise(out)
    return out


def included_studies(spark: SparkSession, path: str) -> DataFrame:
    return array_file(spark, path, S.INCLUDED_STUDY)


def strategy_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, line) of numbered search strategies like ``3 1 or 2`` or ``#3 #1 AND #2``."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    number = F.regexp_extract("value", r"^\s*#?(\d+)[.\s]", 1)
    return lines.where(number != "").select("file", number.cast("int").alias("number"), F.trim(F.regexp_replace("value", r"^\s*#?\d+[.\s]+", "")).alias("line"))


def renumbered(lines: DataFrame, delta: int, extra: str | None = None, relation: str = "and") -> DataFrame:
    """Strategy lines with all their numbers moved by delta; ``extra`` is added as a last line and joined to the one before."""
    def moved(c: Column) -> Column:
        words = F.split(c, r"(?<=\W)(?=\d)|(?<=\d)(?=\D)|(?<=^)(?=\d)")
        is_reference = c.rlike(r"^(?:(?:or|and)/\d|#?\d+(?:-\d+)?(?:\s+(?:or|and|not)\s+#?\d+)+)")
        return F.when(is_reference | c.rlike(r"(?i)^(?:or|and)/"), F.array_join(F.transform(words, lambda w: F.coalesce((w.try_cast("int") + delta).cast("string"), w)), "")).otherwise(c)

    out = lines.select("file", (F.col("number") + delta).alias("number"), moved(F.col("line")).alias("line"))
    if extra is None:
        return out
    last = out.groupBy("file").agg(F.max("number").alias("n"))
    added = last.select("file", F.inline(F.array(F.struct((F.col("n") + 1).alias("number"), F.lit(extra).alias("line")), F.struct((F.col("n") + 2).alias("number"), F.concat(F.col("n").cast("string"), F.lit(f" {relation} "), (F.col("n") + 1).cast("string")).alias("line")))))
    return out.unionByName(added)


def page_plan(spark: SparkSession, total: int, chunk: int = 9900, batch: int = 350) -> DataFrame:
    """(chunk_start, start, size): requests that cover a paged result once. Offsets are absolute, so no chunk repeats another."""
    starts = spark.range(0, total, chunk).withColumnRenamed("id", "chunk_start")
    inside = F.sequence(F.col("chunk_start"), F.least(F.col("chunk_start") + chunk, F.lit(total)) - 1, F.lit(batch))
    out = starts.select("chunk_start", F.explode(inside).alias("start"))
    return out.withColumn("size", F.least(F.lit(batch), F.lit(total) - F.col("start"), F.col("chunk_start") + chunk - F.col("start")))


def search_feedback(text: Column) -> Column:
    """struct<count,query,warnings> of a search service's JSON."""
    v = F.try_parse_json(text)
    result = F.coalesce(F.try_variant_get(v, "$.esearchresult", "variant"), v)
    warnings = F.coalesce(F.try_variant_get(result, "$.warninglist.outputmessages", "array<string>"), F.array().cast("array<string>"))
    return F.struct(F.try_variant_get(result, "$.count", "string").try_cast("bigint").alias("count"), F.try_variant_get(result, "$.querytranslation", "string").alias("query"), warnings.alias("warnings"))


def union_databases(parts: dict[str, DataFrame]) -> DataFrame:
    """The records of several databases with the column ``database``."""
    out = None
    for name, part in parts.items():
        named = part.withColumn("database", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise ValueError("no database is given")
    return out


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    """The text of an HTML page without scripts and styles, one line a text node."""

    def text(h: str) -> str:
        p = _Text()
        p.feed(h or "")
        return "\n".join(p.parts)

    return html.map(text)


@F.pandas_udf(T.StringType())
def docx_text(content: pd.Series) -> pd.Series:
    """The paragraphs of a .docx file, one a line; null for other bytes."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def text(raw: bytes) -> str | None:
        try:
            with zipfile.ZipFile(BytesIO(raw)) as z:
                root = ElementTree.fromstring(z.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))

    return content.map(text)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, fingerprint, text) of .txt, .json, .html and .docx files; white space around line breaks collapses."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    kind = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    decoded = F.decode("content", "UTF-8")
    out = files.withColumn("kind", kind)
    simple = out.where(F.col("kind").isin("txt", "json")).select("path", "content", decoded.alias("text"))
    html = out.where(F.col("kind").isin("html", "htm")).select("path", "content", html_text(decoded).alias("text"))
    docx = out.where(F.col("kind") == "docx").select("path", "content", docx_text("content").alias("text"))
    return simple.unionByName(html).unionByName(docx).select(F.col("path").alias("file"), F.sha2("content", 256).alias("fingerprint"), F.btrim(collapse_newlines(F.col("text")), F.lit(" \t\n\r")).alias("text"))
