"""Boolean search strategies: numbered lines of words, phrases, truncated and neighbouring words, and references to earlier lines.

A positional index is a table of (idx, field, term, at), sorted by term in each file. It is
made where the texts lie, without a shuffle. Patterns become ranges of terms, so the scan skips
row groups, and are joined with the few terms that match. Only those postings are brought
together by document (not even they, if the index is bucketed), and lines are evaluated as
columns of one row a document: AND, OR and NOT of lines are the sets' intersection, union and
difference. A line that others refer to is computed once.

What is read: ``and``, ``or``, ``not`` from left to right; ``adjN`` (at most N words on, either
way; ``adj`` is ``adj1``) between words, phrases and ``or`` of those; "phrases", and bare
words in a row; ``stem$`` and ``stem*``; ``?`` for one character or none; ``#3``, ``3`` in a line
of numbers only, ``or/1-3``; tags as ``.ti,ab.`` or ``[tiab]``; ``exp Heading/``, ``*Heading/`` as a
phrase in the field of the tag ``sh`` (narrower headings need a thesaurus and are not added).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.text import TOKEN, tokenize
from quarrystone.scratch import bucketed, written

#: Lines that may be evaluated in one call; a strategy is written by people.
MOST_LINES = 10_000
#: Lines evaluated in one pass over the index.
PASS = 200
#: Up to so many ranges of terms are pushed into the scan.
MOST_RANGES = 300


def _places(fields: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of documents' terms, a list a field, as rows of (idx, field, term, at); documents are taken together while they have about a million terms."""

    def parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(sum(b.column(f).value_lengths().fill_null(0).to_numpy() for f in fields))
        starts = [*np.flatnonzero(np.diff(ends >> 20, prepend=-1)).tolist(), len(b)]
        return (b.slice(at, end - at) for at, end in zip(starts, starts[1:], strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in parts(batch)):
            for field in fields:
                many = b.column(field).value_lengths().fill_null(0).to_numpy()
                terms = b.column(field).flatten().dictionary_encode()
                doc = np.repeat(np.arange(len(b)), many)
                place = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32)
                code = terms.indices.to_numpy()
                order = np.lexsort((code, doc))  # stable, so places stay in order
                doc, code = doc[order], code[order]
                first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1]))) if len(doc) else np.zeros(0, np.int64)
                at = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)), pa.int32()), pa.array(place[order]))
                yield pa.RecordBatch.from_arrays([b.column("idx").take(pa.array(doc[first])), pa.array([field] * len(first), pa.string()), terms.dictionary.take(pa.array(code[first])), at], ["idx", "field", "term", "at"])

    return run


def positional_index(docs: DataFrame, idx: str, fields: Mapping[str, str], buckets: int | None = None, table: str | None = None) -> DataFrame:
    """(idx, field, term, at): the places, from 0, of every term in the given columns by field name. Ids should be unique; null texts have no terms.

    With a number of buckets it is bucketed by document, which shuffles it once and spares each search the shuffle of what it finds.
    """
    terms = docs.select(F.col(idx).alias("idx"), *[tokenize(F.col(c)).alias(f) for f, c in fields.items()])
    kind = terms.schema["idx"].dataType.simpleString()
    placed = terms.mapInArrow(_places(list(fields)), f"idx {kind}, field string, term string, at array<int>")
    if buckets:
        return bucketed(placed, "positions", buckets, ["idx"], ["term", "field"], table)
    return written(placed.sortWithinPartitions("term", "field"), "positions")


# --- reading a line ----------------------------------------------------------------------------------------------

_TAG = r"\.[a-z]{2}(?:,[a-z]{2})*\."
_PART = re.compile(rf"\"[^\"]*\"|“[^”\"]*[”\"]|[()]|\[[^\]]*\]|{_TAG}|[^\s()\[\]\"“”]+?(?={_TAG}|[\s()\[\]\"“”]|$)")
_RANGE = re.compile(r"(or|and)/([\d,\-\s]+)$", re.I)
_HEADING = re.compile(r"(?:exp\s+)?\*?([^/()]+)/$", re.I)
_PATTERN = re.compile(r"[a-z0-9?]+(?:[-'][a-z0-9?]+)?[$*]?")


def _phrase(text: str, tags: tuple[str, ...] | None = None) -> tuple:
    words = tuple(_PATTERN.findall(text.lower()))
    if not words:
        raise ValueError(f"no word in {text!r}")
    return ("phrase", words, tags)


def _tagged(node: tuple, tags: tuple[str, ...]) -> tuple:
    if node[0] == "phrase":
        return (*node[:2], node[2] or tags)
    return tuple(_tagged(x, tags) if isinstance(x, tuple) else x for x in node)


def read_line(line: str) -> tuple:
    """The line as nested (kind, ...): phrase (words, tags), and/or/not (left, right), adj (distance, left, right), line (number)."""
    line = line.strip()
    if found := _RANGE.match(line):
        spans = [[int(x) for x in part.split("-")] for part in found[2].replace(" ", "").split(",")]
        numbers = [("line", n) for s in spans for n in range(s[0], s[-1] + 1)]
        return reduce(lambda a, b: (found[1].lower(), a, b), numbers)
    if found := _HEADING.match(line):
        return _phrase(found[1], ("sh",))
    only_numbers = not re.sub(r"#?\b\d+\b|\b(?:and|or|not)\b|[()\s]", "", line.lower())
    parts = _PART.findall(line)

    def near(k: int) -> str | None:
        return parts[k].lower() if k < len(parts) else None

    def operand(k: int) -> tuple[tuple, int]:
        if near(k) == "(":
            node, k = whole(k + 1)
            if near(k) != ")":
                raise ValueError(f"a bracket is open in {line!r}")
            k += 1
        else:
            words = []
            while (w := near(k)) and w not in ("(", ")", "and", "or", "not") and not re.fullmatch(r"adj\d*", w) and w[0] not in "[" and not re.fullmatch(_TAG, w):
                words.append(w)
                k += 1
            if not words:
                raise ValueError(f"an operand is missing in {line!r}")
            if len(words) == 1 and re.fullmatch(r"#\d+" if not only_numbers else r"#?\d+", words[0]):
                node = ("line", int(words[0].lstrip("#")))
            else:
                node = _phrase(" ".join(words))
        if (w := near(k)) and (w[0] == "[" or re.fullmatch(_TAG, w)):
            node, k = _tagged(node, tuple(re.findall(r"[a-z]+", w.split(":")[0]))), k + 1
        return node, k

    def close(k: int) -> tuple[tuple, int]:
        node, k = operand(k)
        while (w := near(k)) and (found := re.fullmatch(r"adj(\d*)", w)):
            other, k = operand(k + 1)
            node = ("adj", int(found[1] or 1), node, other)
        return node, k

    def whole(k: int) -> tuple[tuple, int]:
        node, k = close(k)
        while near(k) in ("and", "or", "not"):
            other, after = close(k + 1)
            node, k = (near(k), node, other), after
        return node, k

    node, end = whole(0)
    if end < len(parts):
        raise ValueError(f"{line!r} can't be read from {parts[end]!r} on")
    return node


def _walk(node: tuple) -> Iterator[tuple]:
    yield node
    for x in node[1:] if node[0] != "phrase" else ():
        if isinstance(x, tuple):
            yield from _walk(x)


# --- evaluating all lines at once --------------------------------------------------------------------------------


class _Slots:
    """A number for each (field, pattern) that some line asks for."""

    def __init__(self, tags: Mapping[str, Sequence[str]], fields: Sequence[str]) -> None:
        self.tags, self.all, self.numbers = tags, list(fields), {}

    def fields(self, tags: tuple[str, ...] | None) -> list[str]:
        if unknown := [t for t in tags or () if t not in self.tags]:
            raise ValueError(f"no field is given for the tag {unknown[0]}")
        return list(dict.fromkeys(f for t in tags for f in self.tags[t])) if tags else self.all

    def at(self, field: str, word: str) -> Column:
        number = self.numbers.setdefault((field, word), len(self.numbers))
        return F.coalesce(F.try_element_at("held", F.lit(number)), F.array().cast("array<int>"))

    def spans(self, node: tuple, field: str) -> tuple[Column, Column]:
        """First and last places of what the node matches in a field."""
        if node[0] == "or":
            (a, b), (c, d) = self.spans(node[1], field), self.spans(node[2], field)
            return F.concat(a, c), F.concat(b, d)
        if node[0] != "phrase":
            raise ValueError("adj stands between words, phrases and OR of those")
        if field not in self.fields(node[2]):
            return F.array().cast("array<int>"), F.array().cast("array<int>")

        def back(places: Column, k: int) -> Column:
            return F.transform(places, lambda p: p - k)

        first, *rest = [back(self.at(field, w), k) for k, w in enumerate(node[1])]
        starts = reduce(F.array_intersect, rest, first)
        return starts, F.transform(starts, lambda p: p + len(rest))

    def holds(self, node: tuple, line: Mapping[int, Column]) -> Column:
        if node[0] == "line":
            if node[1] not in line:
                raise ValueError(f"line {node[1]} is referred to before it is given")
            return line[node[1]]
        if node[0] == "phrase":
            return reduce(lambda a, b: a | b, [F.size(self.spans(node, f)[0]) > 0 for f in self.fields(node[2])])
        if node[0] == "adj":
            return reduce(lambda a, b: a | b, [self.close(node, f) for f in self.all])
        a, b = self.holds(node[1], line), self.holds(node[2], line)
        return {"and": a & b, "or": a | b, "not": a & ~b}[node[0]]

    def close(self, node: tuple, field: str) -> Column:
        (a, b), (c, d) = self.spans(node[2], field), self.spans(node[3], field)
        after = lambda ends: F.flatten(F.transform(ends, lambda e: F.sequence(e + 1, e + node[1])))
        return F.arrays_overlap(after(b), c) | F.arrays_overlap(after(d), a)


def _stem(word: str) -> str:
    return re.split(r"[$*?]", word)[0]


def _matches(index: DataFrame, slots: _Slots) -> DataFrame:
    """(idx, held): a map of slot to the sorted places of the terms that match it, one row a document."""
    spark = index.sparkSession
    rows = []
    for (field, word), number in slots.numbers.items():
        pattern = "^" + re.sub(r"[$*]", "[a-z0-9'-]*", re.escape(word).replace(r"\$", "$").replace(r"\*", "*").replace(r"\?", "[a-z0-9]?")) + "$" if re.search(r"[$*?]", word) else None
        rows.append((number, field, _stem(word), pattern is None, pattern))
    looked_up = F.broadcast(spark.createDataFrame(rows, "slot int, field string, key string, whole boolean, pattern string"))
    if len(rows) <= MOST_RANGES:
        wanted = [(F.col("term") == key) if whole else (F.col("term") >= key) & (F.col("term") < key + "\U0010ffff") for _, _, key, whole, _ in dict.fromkeys(rows)]
        index = index.where(reduce(lambda a, b: a | b, wanted))
    lengths = sorted({len(key) for _, _, key, whole, _ in rows if not whole})
    keys = F.array(F.struct(F.col("term").alias("key"), F.lit(True).alias("whole")), *[F.struct(F.left("term", F.lit(n)).alias("key"), F.lit(False).alias("whole")) for n in lengths])
    met = index.select("idx", "field", "term", "at", F.inline(keys)).join(looked_up, ["field", "key", "whole"])
    met = met.where(F.col("pattern").isNull() | F.regexp_like("term", F.col("pattern")))
    each = met.groupBy("idx", "slot").agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("at"))
    return each.groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("slot", "at"))).alias("held"))


def evaluate(index: DataFrame, lines: DataFrame | Iterable[tuple[str, int, str]], fields: Sequence[str], tags: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(strategy, number, idx): the documents that each line finds. lines: (strategy, number, line); tags: the fields that a tag stands for, untagged words are looked for in all."""
    if isinstance(lines, DataFrame):
        lines = [tuple(r) for r in lines.limit(MOST_LINES + 1).collect()]
    by_strategy: dict[str, dict[int, tuple]] = {}
    for strategy, number, line in sorted(lines, key=lambda x: (x[0], x[1])):
        by_strategy.setdefault(strategy, {})[number] = read_line(line)
    if sum(map(len, by_strategy.values())) > MOST_LINES:
        raise ValueError(f"more than {MOST_LINES} lines")
    passes: list[list[str]] = [[]]
    for strategy, own in by_strategy.items():
        if passes[-1] and sum(len(by_strategy[s]) for s in passes[-1]) + len(own) > PASS:
            passes.append([])
        passes[-1].append(strategy)
    return reduce(DataFrame.unionByName, [_pass(index, {s: by_strategy[s] for s in some}, fields, tags or {}) for some in passes])


def _pass(index: DataFrame, strategies: Mapping[str, Mapping[int, tuple]], fields: Sequence[str], tags: Mapping[str, Sequence[str]]) -> DataFrame:
    slots = _Slots(tags, fields)
    levels: list[dict[str, Column]] = []
    hits = []
    for k, (strategy, own) in enumerate(strategies.items()):
        depth: dict[int, int] = {}
        for number, node in own.items():
            told = {n: F.col(f"line_{k}_{n}") for n in depth}
            holds = slots.holds(node, told)
            depth[number] = 1 + max((depth[x[1]] for x in _walk(node) if x[0] == "line"), default=-1)
            levels += [{} for _ in range(depth[number] + 1 - len(levels))]
            levels[depth[number]][f"line_{k}_{number}"] = holds
            hits.append(F.struct(F.lit(strategy).alias("strategy"), F.lit(number).alias("number"), F.col(f"line_{k}_{number}").alias("hit")))
    rows = _matches(index, slots)
    for level in levels:
        rows = rows.withColumns(level)
    return rows.select("idx", F.inline(F.filter(F.array(*hits), lambda x: x["hit"]))).select("strategy", "number", "idx")
