"""Segmentation: runs, sections, chunks and numbered contexts."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarrystone.functions.text import clean_text, dedupe, split_numbered


def merge_runs(rows: DataFrame, by: Sequence[str], order: str, section: str, text: str) -> DataFrame:
    """(by, run, section, text): consecutive rows of one section, texts joined by a space."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.when(F.lag(section).over(w).eqNullSafe(F.col(section)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ")
    return marked.groupBy(*by, "run", section).agg(texts.alias(text))


# Headings of reference lists.
REFERENCE_SECTIONS = ("REFERENCES", "REFERENCE", "Reference", "References")


def skip_sections(rows: DataFrame, section: str, skipped: Sequence[str] = REFERENCE_SECTIONS) -> DataFrame:
    """rows but those of the skipped sections; rows without a section stay."""
    return rows.where(~F.coalesce(F.col(section).isin(list(skipped)), F.lit(False)))


def sections(rows: DataFrame, by: Sequence[str], order: str, text: str, is_heading: Column) -> DataFrame:
    """(by, section, heading, body): a heading opens a section that holds the rows up to the next; rows before the first are dropped."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_heading", is_heading).withColumn("section", F.sum(F.when(F.col("_heading"), 1).otherwise(0)).over(w))
    body = F.transform(F.filter(F.array_sort(F.collect_list(F.struct(order, text, "_heading"))), lambda x: ~x["_heading"]), lambda x: x[text])
    return marked.where("section > 0").groupBy(*by, "section").agg(F.min(F.when(F.col("_heading"), F.col(text))).alias("heading"), F.array_join(body, " ").alias("body"))


# The headings of guideline sections and what ends a statement or the document.
_QUESTIONS, _STATEMENT = re.compile(r"Questions:?\s*$", re.I), re.compile(r"Statements?\s*\(", re.I)
_DISCUSSION, _REFERENCES, _SUBMIT = "Discussion", "References", "Ready to submit"


class _SectionParser:
    """Reads one document's blocks in order. It holds the texts of the section that is open, and hands a section on when a heading or the end closes it."""

    last_page = 15

    def __init__(self) -> None:
        self.by = self.kind = self.title = None
        self.section, self.part, self.ended = -1, 0, False
        self.texts: list[str] = []

    def _flush(self) -> Iterator[tuple]:
        if self.kind:
            self.part += 1
            yield self.by, self.part, self.opened, self.kind, self.title, " ".join(self.texts)
        self.kind, self.title, self.texts = None, None, []

    def _open(self, kind: str, title: str | None = None) -> None:
        self.kind, self.title, self.opened = kind, title, self.section

    def eval(self, row: Row) -> Iterator[tuple]:
        self.by, page, text = row[0], row[1], row[3]
        if self.ended or text is None:
            return
        asks, states = _QUESTIONS.match(text), _STATEMENT.match(text)
        if self.kind == "questions" and not asks and not states:
            self.texts.append(text)  # a list of questions ends at the next heading only
        elif page is not None and page >= self.last_page and text.startswith(_REFERENCES):
            self.ended = True
        elif asks:
            yield from self._flush()
            self.section += 1
            self._open("questions")
        elif states:
            yield from self._flush()
            self._open("statement", text)
        elif self.kind:
            if text.startswith(_DISCUSSION):
                yield from self._flush()
            elif text.startswith((_REFERENCES, _SUBMIT)):
                yield from self._flush()
                self.ended = True
            else:
                self.texts.append(text)

    def terminate(self) -> Iterator[tuple]:
        yield from self._flush()


def guideline_sections(blocks: DataFrame, by: str, page: str, order: str, text: str, last_page: int = 15) -> DataFrame:
    """(by, part, section, kind, title, body): lists of questions and statements of guidelines, with the blocks under each joined by a space.

    A table function reads a document's blocks, which Spark deals by document and sorts: state and memory are those of one open section.
    Sections are counted by their question lists, from 0 (-1 for a statement before any). A statement ends at the next heading or at a
    discussion; references, from last_page on or in a statement, and a mark of submission in a statement end the document. Null blocks are passed over.
    """
    schema = T.StructType([T.StructField(by, blocks.schema[by].dataType), *[T.StructField(n, k) for n, k in (("part", T.LongType()), ("section", T.LongType()), ("kind", T.StringType()), ("title", T.StringType()), ("body", T.StringType()))]])
    parser = F.udtf(type("SectionParser", (_SectionParser,), {"last_page": last_page}), returnType=schema)
    rows = blocks.select(by, F.col(page).cast("long").alias("_page"), order, F.col(text).alias("_text"))
    return parser(rows.asTable().partitionBy(by).orderBy(order))


def guideline_records(parts: DataFrame, by: str, asked: DataFrame) -> DataFrame:
    """(by, section, ordinal, question, answers) of guideline_sections' rows: questions that some statement answers, with its items, cleaned and once each, in order.

    asked: (section, key, ordinal), which questions, from 1, a statement of that name answers. The name is what stands in the brackets of its heading, in lower case.
    """
    cleaned = parts.withColumn("_body", clean_text(F.col("body"))).withColumn("_title", F.lower(clean_text(F.col("title"))))
    items = split_numbered(F.col("_body"), unescape=False)
    listed = F.transform(F.filter(items, lambda x: x.endswith("?")), lambda x: F.trim(F.regexp_replace(x, r"^\d+\.\s*", "")))
    questions = cleaned.where("kind = 'questions'").select(by, "section", F.posexplode(listed).alias("_at", "question")).withColumn("ordinal", F.col("_at") + 1)
    name = F.regexp_replace(F.regexp_replace("_title", r"^statements?\s*\(", ""), r"\)$", "")
    said = F.filter(items, lambda x: (x != "") & ~F.startswith(F.lower(x), F.lit("discussion")))
    answers = cleaned.where("kind = 'statement'").select(by, "section", name.alias("key"), "part", said.alias("_said")).join(asked, ["section", "key"])
    lists = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "_said"))), lambda x: x["_said"]))
    answers = answers.groupBy(by, "section", "ordinal").agg(dedupe(lists).alias("answers")).where(F.size("answers") > 0)
    return questions.join(answers, [by, "section", "ordinal"]).select(by, "section", "ordinal", "question", "answers")


def windows(rows: DataFrame, idx: str, text: str, size: int, overlap: int) -> DataFrame:
    """(idx, chunk, piece): windows of characters, each beginning size - overlap after the one before; the last holds the end."""
    step = size - overlap
    many = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step))
    out = rows.select(idx, text, F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("chunk"))
    return out.select(idx, "chunk", F.substr(F.col(text), (F.col("chunk") * step + 1).cast("int"), F.lit(size)).alias("piece"))


#: Documents that are Python objects at a time; the rest of a batch stays as it came.
AT_ONCE = 64


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of AT_ONCE rows."""
    return (b.slice(at, AT_ONCE) for b in batches for at in range(0, len(b), AT_ONCE))


SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def _atoms(text: str, size: int, separators: Sequence[str]) -> Iterator[str]:
    """Parts of at most size characters, each cut after the first separator that makes it fit; joined they are the text."""
    if len(text) <= size:
        yield text
        return
    mark, *rest = separators
    if not mark:
        yield from (text[k : k + size] for k in range(0, len(text), size))
        return
    parts = text.split(mark)
    for k, part in enumerate(parts):
        yield from _atoms(part + mark * (k < len(parts) - 1), size, rest)


def _pieces(text: str, size: int, overlap: int, separators: Sequence[str]) -> Iterator[tuple[int, str]]:
    """(start, piece): as many parts as fit; the next piece begins with the last ones of this, up to overlap characters."""
    held: deque[str] = deque()
    start = length = 0
    # Parts no longer than the overlap can be repeated; without an overlap they may fill a piece.
    for atom in _atoms(text, min(size, overlap) if overlap else size, separators):
        if held and length + len(atom) > size:
            yield start, "".join(held)
            while held and (length > overlap or length + len(atom) > size):
                start += len(held[0])
                length -= len(held.popleft())
        held.append(atom)
        length += len(atom)
    if length:
        yield start, "".join(held)


def recursive_chunks(rows: DataFrame, idx: str, text: str, size: int = 2000, overlap: int | None = None, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """(idx, chunk, start, piece): pieces of at most size characters, cut after the first separators that make them fit.

    Each begins with the end of the one before, up to overlap characters (a fifth of size unless given).
    """
    kind = rows.schema[idx].dataType
    again = size // 5 if overlap is None else overlap
    schema = T.StructType([T.StructField(idx, kind), T.StructField("chunk", T.LongType()), T.StructField("start", T.LongType()), T.StructField("piece", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _some(batches):
            out = [(i, k, at, p) for i, t in enumerate(part.column(1).to_pylist()) for k, (at, p) in enumerate(_pieces(t or "", size, again, separators))]
            own, chunk, start = (pa.array([o[c] for o in out], pa.int64()) for c in range(3))
            yield pa.RecordBatch.from_arrays([part.column(0).take(own), chunk, start, pa.array([o[3] for o in out], pa.string())], [idx, "chunk", "start", "piece"])

    return rows.select(idx, text).mapInArrow(cut, schema)


def pack_lines(rows: DataFrame, idx: str, text: str, most: int = 500) -> DataFrame:
    """(idx, chunk, lines, piece): whole lines put together while a chunk stays within most characters; a longer line is a chunk of its own."""
    lines = F.split(F.col(text), "\n")
    start = F.from_json(F.lit("[]"), "array<string>")
    grown = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + 1 + F.length(x) <= most),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.get(acc, F.size(acc) - 1), F.lit("\n"), x))),
    ).otherwise(F.concat(acc, F.array(x)))
    chunks = rows.select(idx, F.posexplode(F.aggregate(lines, start, grown)).alias("chunk", "piece"))
    return chunks.select(idx, "chunk", F.size(F.split("piece", "\n")).cast("long").alias("lines"), "piece")


def _cut(text: str, most: int) -> Iterator[str]:
    """Parts of at most so many characters, cut at the last blank that makes them fit, or without one anywhere."""
    while len(text) > most:
        at = text.rfind(" ", 1, most + 1)
        yield text[: at if at > 0 else most].rstrip()
        text = text[at if at > 0 else most :].lstrip()
    if text:
        yield text


def _title_chunks(elements: Iterable[tuple[bool, str]], most: int) -> Iterator[str]:
    """Sections as runs of elements that fit, joined by a blank line; neighbouring sections are put together while they fit."""
    sections: list[str] = []
    for title, text in elements:
        if sections and not title and len(sections[-1]) + 2 + len(text) <= most:
            sections[-1] += "\n\n" + text
        else:
            sections.append(text)
    held = ""
    for section in sections:
        if held and len(held) + 2 + len(section) <= most:
            held += "\n\n" + section
        else:
            yield from _cut(held, most)
            held = section
    yield from _cut(held, most)


def chunk_by_title(elements: DataFrame, by: str, order: str, is_title: Column, text: str, most: int = 500) -> DataFrame:
    """(by, chunk, piece): elements of a document in chunks of at most so many characters.

    A title begins a section. Elements of a section share a chunk while they fit, small sections are put together, an
    element that is too long is cut at blanks. Elements that are null or blank are left out, and documents without others.
    """
    kept = elements.where(F.trim(text) != "").select(by, order, F.coalesce(is_title, F.lit(False)).alias("_title"), F.col(text).alias("_text"))
    rows = kept.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "_title", "_text"))), lambda x: F.struct(x["_title"], x["_text"])).alias("_elements"))
    schema = T.StructType([T.StructField(by, elements.schema[by].dataType), T.StructField("chunk", T.LongType()), T.StructField("piece", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _some(batches):
            out = [(i, k, p) for i, es in enumerate(part.column(1).to_pylist()) for k, p in enumerate(_title_chunks([tuple(e.values()) for e in es], most))]
            own, chunk = (pa.array([o[c] for o in out], pa.int64()) for c in range(2))
            yield pa.RecordBatch.from_arrays([part.column(0).take(own), chunk, pa.array([o[2] for o in out], pa.string())], [by, "chunk", "piece"])

    return rows.mapInArrow(cut, schema)


def numbered_context(rows: DataFrame, by: Sequence[str], rank: str, text: str, empty: str = "No documents.") -> DataFrame:
    """(by, text): ``[rank] text`` lines in rank order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(rank, text))), lambda x: F.concat(F.lit("["), x[rank], F.lit("] "), x[text]))
    return rows.groupBy(*by).agg(F.when(F.count(F.lit(1)) > 0, F.array_join(lines, "\n")).otherwise(empty).alias(text))


# --- recommendation segmenters: spans found by patterns, inside one text, by an Arrow-batched function ---------------

_START = r"\bRecommendation\s+\d+(?:\.\d+){1,2}\.?\s+"
_STOPS = (r"\bStatement\s+\d+(?:\.\d+){1,2}", r"\bComment:", r"\bQ\.\d+\.\d+:")
# The words by which a span of the second kind recommends something.
_RECOMMENDS = r"(?i)\b(recommend(?:ed|s|ing)?|suggest(?:ed|s|ing)?|advised|preferred|should be considered|cannot suggest)\b"
# A block that begins so begins a span of keyword_sections in the joined text as well: no cleaning joins it to what stands before it.
_OPENS = r"^[1-7]\.\d+ +[A-Z]"
_EVIDENCE = r"\[[^\]]*(?:QoE|Strength of recommendation)[^\]]*\]"


def recommendation_spans(text: Column) -> Column:
    """Spans of the cleaned text that begin at ``Recommendation n.n``, end before the next one or a stop, and are trimmed after the evidence bracket; once each."""
    text = clean_text(text)
    stop = "|".join([_START, *_STOPS])
    spans = F.regexp_extract_all(text, F.lit(rf"(?is)({_START}.*?)(?={stop}|\z)"), F.lit(1))
    trimmed = F.transform(spans, lambda s: F.trim(F.coalesce(F.nullif(F.regexp_extract(s, rf"(?is)^(.*?{_EVIDENCE})", 1), F.lit("")), s)))
    none = F.regexp_extract(text, r"(?is)(\bStatement\s+\d+(?:\.\d+){1,2}.*?No recommendation\])", 1)
    return F.when(F.size(trimmed) > 0, F.array_distinct(trimmed)).when(none != "", F.array(none)).otherwise(F.array().cast("array<string>"))


def keyword_sections(text: Column, first: int = 900) -> Column:
    """map of number to text of ``n.n Capital`` spans of the cleaned text that recommend something near their start: cut after an evidence mark or before a discussion.

    What is left has to recommend something too; the first such span of a number wins. Entities stay: unescape before.
    """
    text = clean_text(text, unescape=False)
    head = r"\b[1-7]\.\d+\s+(?=[A-Z])"
    spans = F.regexp_extract_all(text, F.lit(rf"(?s)({head}.*?)(?={head}|\z)"), F.lit(1))
    said = r"(?i)\b(recommend(?:ed|s|ing)?|suggest(?:ed|s|ing)?|advised)\b|#QoE|SoR"
    kept = F.filter(spans, lambda s: F.substring(s, 1, first).rlike(said) & ~F.contains(F.substring(s, 1, 200), F.lit("References")))
    mark = lambda s: F.regexp_extract(s, r"(?is)^(.*?#QoE[^#]*#\.?)", 1)
    cut = F.transform(kept, lambda s: F.trim(F.when(mark(s) != "", mark(s)).otherwise(F.get(F.split(s, r"\bDiscussion\b"), F.lit(0)))))
    cut = F.filter(cut, lambda s: s.rlike(_RECOMMENDS))
    pairs = F.transform(cut, lambda s: F.struct(F.regexp_extract(s, r"^(\d\.\d+)", 1).alias("key"), s.alias("value")))
    first_of = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(first_of)


def page_recommendations(blocks: DataFrame, by: str, page: str, order: str, text: str, last_page: int = 19) -> DataFrame:
    """(by, number, text) of keyword_sections over the blocks of a document's first pages, in order, joined by a space.

    A block that begins with a heading ends the span before it, so the blocks are joined only up to the next such block, and the
    first span of a number is found by an aggregation: nothing holds a document whole, and no span is compared with all others.
    """
    kept = blocks.where(F.col(page) <= last_page).select(by, order, text)
    opens = F.coalesce(F.col(text).rlike(_OPENS), F.lit(False)).cast("int")
    run = F.sum(opens).over(Window.partitionBy(by).orderBy(order, text).rowsBetween(Window.unboundedPreceding, 0))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ")
    bodies = kept.withColumn("_run", run).groupBy(by, "_run").agg(body.alias("_body")).withColumn("_body", clean_text(F.col("_body")))
    spans = bodies.select(by, "_run", F.explode(keyword_sections(F.col("_body"))).alias("number", "_span"))
    return spans.groupBy(by, "number").agg(F.min_by("_span", "_run").alias("text"))
