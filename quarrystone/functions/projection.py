"""Projections on records: normalised question frames, payloads, prompts and compact forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import truncate

YES_NO = ("yes", "no")
#: Keys of a judge's dimensions.
DIMENSIONS = ("retrieval_match_strength", "candidate_answer_consistency", "pico_coverage")
# Other names under which replies give a field.
DECISION_KEYS = ("decision", "判断", "can_answer")
REASON_KEYS = ("reason", "理由")
ANSWER_KEYS = ("candidate_based_brief_answer", "answer_basis", "基于候选的简短答案")
RANK_KEYS = ("supporting_candidate_ranks", "best_candidate_ranks", "依据候选排名")


def _field(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def string_list(v: Column, path: str) -> Column:
    """A list of strings from a list or a single value, trimmed, without blanks; empty where missing."""
    many = _field(v, path, "array<string>")
    one = _field(v, path, "string")
    got = F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
    return F.filter(F.transform(got, lambda x: F.trim(x)), lambda x: x != "")


def outcome_map(v: Column, path: str = "$.O", keep_empty: bool = True) -> Column:
    """map<string,array<string>> from lists or single values; blank keys go, empty lists stay if asked."""
    raw = F.coalesce(_field(v, path, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    entries = F.filter(F.map_entries(raw), lambda e: F.trim(e["key"]) != "")
    lists = F.transform(entries, lambda e: F.struct(F.trim(e["key"]).alias("key"), string_list(e["value"], "$").alias("value")))
    if not keep_empty:
        lists = F.filter(lists, lambda e: F.size(e["value"]) > 0)
    return F.map_from_entries(lists)


def normalize_pico(text: Column, keep_empty: bool = True) -> Column:
    """struct<P,I,C,O> from JSON: a frame, one under ``pico``, or a list of either."""
    v = F.try_parse_json(text)
    v = F.coalesce(_field(v, "$[0].pico", "variant"), _field(v, "$[0]", "variant"), _field(v, "$.pico", "variant"), v)
    one = lambda k: F.trim(F.coalesce(_field(v, f"$.{k}", "string"), F.lit("")))
    return F.struct(one("P").alias("P"), one("I").alias("I"), string_list(v, "$.C").alias("C"), outcome_map(v, "$.O", keep_empty).alias("O"))


def _json_list(values: Column) -> Column:
    quoted = F.transform(values, _json_string)
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def _json_string(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))


def pico_json(pico: Column) -> Column:
    """JSON of a normalised frame with sorted keys and ", " and ": " between parts."""
    entries = F.array_sort(F.map_entries(pico["O"]), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    outcomes = F.array_join(F.transform(entries, lambda e: F.concat(_json_string(e["key"]), F.lit(": "), _json_list(e["value"]))), ", ")
    return F.concat(F.lit('{"C": '), _json_list(pico["C"]), F.lit(', "I": '), _json_string(pico["I"]), F.lit(', "O": {'), outcomes, F.lit('}, "P": '), _json_string(pico["P"]), F.lit("}"))


def query_text(question: Column, pico: Column) -> Column:
    return F.concat(F.lit("question: "), F.trim(question), F.lit("\npico: "), pico_json(pico))


def search_text(question: Column, disease: Column, topic: Column, pico_text: Column, synonyms_text: Column) -> Column:
    """The five labelled lines that a record is indexed under."""
    parts = (("question", question), ("disease", disease), ("topic", topic), ("pico", pico_text), ("synonyms", synonyms_text))
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), F.coalesce(c, F.lit(""))) for k, c in parts])


def format_answer(answer: Column) -> Column:
    return F.array_join(answer, " | ")


def optional_int(text: Column) -> Column:
    """An integer, or null for null, blank and anything else."""
    return F.expr("try_cast(nullif(trim(`{0}`), '') AS BIGINT)".format(text)) if isinstance(text, str) else text.try_cast("bigint")


def optional_float(text: Column) -> Column:
    return text.try_cast("double")


def judge(text: Column) -> Column:
    """struct<decision,reason,ranks,answer> from a judge's JSON reply under any of the field names; an answer only with yes."""
    v = F.try_parse_json(text)

    def first(keys: tuple[str, ...], kind: str) -> Column:
        return F.coalesce(*[_field(v, f"$['{k}']", kind) for k in keys])

    flag = first(DECISION_KEYS, "boolean")
    word = F.lower(F.trim(first(DECISION_KEYS, "string")))
    decision = F.when(flag.isNotNull(), F.when(flag, "yes").otherwise("no")).when(word.isin(*YES_NO), word).otherwise("no")
    ranks = F.filter(F.transform(F.coalesce(first(RANK_KEYS, "array<string>"), F.array().cast("array<string>")), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    answer = F.when(decision == "yes", F.trim(F.coalesce(first(ANSWER_KEYS, "string"), F.lit("")))).otherwise("")
    return F.struct(decision.alias("decision"), F.trim(F.coalesce(first(REASON_KEYS, "string"), F.lit(""))).alias("reason"), ranks.alias("ranks"), answer.alias("answer"))


def compact_list(values: Column, most: int) -> Column:
    """struct<items,omitted>: the first values and how many are left out; null stays null."""
    return F.when(values.isNotNull(), F.struct(F.slice(values, 1, most).alias("items"), F.greatest(F.size(values) - most, F.lit(0)).alias("omitted")))


def truncate_list(values: Column, most: int) -> Column:
    return F.transform(values, lambda x: truncate(x, most))


def suppress_answer(decision: Column, answer: Column) -> Column:
    return F.when(decision == "yes", answer).otherwise("")


def answer_from_candidates(brief: Column, ranks: Column, answers: Column) -> Column:
    """The brief answer, else the answer of the first supporting rank (from 1) that is in range."""
    inside = F.filter(ranks, lambda r: (r >= 1) & (r <= F.size(answers)))
    return F.when(F.trim(F.coalesce(brief, F.lit(""))) != "", brief).otherwise(F.when(F.size(inside) > 0, F.element_at(answers, F.get(inside, F.lit(0)))))


def flatten_values(values: Column) -> Column:
    """All strings of a map of lists in one text."""
    return F.array_join(F.flatten(F.map_values(values)), " ")


def publication_year(published: Column) -> Column:
    return F.split_part(published, F.lit("-"), F.lit(1))


def key_value_lines(values: Column, missing: str = "Not reported\n") -> Column:
    """``key: value`` lines of a map, sorted by key."""
    entries = F.array_sort(F.map_entries(values))
    lines = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n"))), "")
    return F.when(values.isNull() | (F.size(values) == 0), missing).otherwise(lines)


def drop_long_lists(values: Column, most: int = 128) -> Column:
    """Null for a list that is as long as an embedding: ``most`` values or more."""
    return F.when(F.size(values) < most, values)
