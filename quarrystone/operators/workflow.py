"""Steps that call a model, as plans around model_map: prompts are columns, replies are parsed by expressions, failures stay rows.

Whatever decides without a model (skip sets, cached replies, an answer found in the
abstract) runs before one is called, as a filter or an anti-join above the operator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.functions import projection as P
from quarrystone.functions import text as X

from quarrystone.scratch import written

from . import records, retrieval
from .model import Client, model_map, prompt_key

MakeClient = Callable[[], Client]
#: The ratings of a factor and their steps.
GRADE_STEPS = {"NOT_SERIOUS": 0, "SERIOUS": -1, "VERY_SERIOUS": -2}
FAILURE = "Insufficient evidence to draw a conclusion"


def setting(config: dict[str, Any], path: str, given: Any = None, default: Any = None) -> Any:
    """A given value, else the one at a dotted path of the configuration, else the default."""
    if given is not None:
        return given
    at: Any = config
    for key in path.split("."):
        if not isinstance(at, dict) or key not in at:
            return default
        at = at[key]
    return at


def retrieval_items(text: Column, method: str = "hybrid") -> Column:
    """The list of results in a reply, as array<variant>; null where there is none.

    An object's first key of method, method_results, hybrid and hybrid_results (where the method is hybrid or blank), results and retrieval_results
    that is there decides, whatever its value: one that holds no list gives null, a null one counts as not there. Without any, an object with
    a record, question or answer is the only result. A bare list is the results.
    """
    method = "hybrid" if method is None or method == "" else method.strip().lower()
    own = [method, f"{method}_results"] if method else []
    common = ["results", "retrieval_results"] if method not in ("", "hybrid") else ["hybrid", "hybrid_results", "results", "retrieval_results"]
    v = F.try_parse_json(text)
    keys = F.json_object_keys(text)
    alone = F.when(F.arrays_overlap(keys, F.array(*map(F.lit, ("record", "question", "answer")))), F.array(v))
    found = F.when(keys.isNull(), F.try_variant_get(v, "$", "array<variant>")).otherwise(alone)
    for name in reversed(list(dict.fromkeys(own + common))):
        at = F.try_variant_get(v, f"$['{name}']", "variant")
        found = F.when(F.array_contains(keys, name), F.when(F.is_variant_null(at), alone).otherwise(F.try_variant_get(at, "$", "array<variant>"))).otherwise(found)
    return found


def candidates(text: Column, method: str = "hybrid", most: int = 5) -> Column:
    """array<struct<rank,index,score,question_id>> of the first results."""
    items = F.slice(retrieval_items(text, method), 1, most)

    def field(x: Column, name: str) -> Column:
        return F.coalesce(F.try_variant_get(x, f"$.record.{name}", "string"), F.try_variant_get(x, f"$.{name}", "string"))

    return F.transform(items, lambda x, k: F.struct((k + 1).alias("rank"), F.try_variant_get(x, "$.index", "string").try_cast("int").alias("index"), F.try_variant_get(x, "$.score", "string").try_cast("double").alias("score"), field(x, "question_id").alias("question_id")))


#: Texts that an encoder sees at a time; other columns and the rest of a batch stay as they came.
ENCODED = 256


def embed(rows: DataFrame, text: str, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], dimension: int, out: str = "embedding") -> DataFrame:
    """rows with a vector of length 1 of the given dimension; an encoder is made once a partition and sees ENCODED texts at a time."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for b in (whole.slice(at, ENCODED) for whole in batches for at in range(0, len(whole), ENCODED)):
            vectors = encode([t or "" for t in b.column(text).to_pylist()])
            if any(len(v) != dimension for v in vectors):
                raise ValueError(f"the encoder gave vectors of another dimension than {dimension}")
            unit = [[x / size for x in v] if (size := sum(x * x for x in v) ** 0.5) else v for v in vectors]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(unit, pa.list_(pa.float32()))], [*b.schema.names, out])

    return rows.mapInArrow(run, schema)


def examples(vectors: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """The k nearest examples of each query, for prompts that show some."""
    return retrieval.dense_search(vectors, queries, k)


def rerank(found: DataFrame, prompt: str, client: MakeClient, k: int, by: str = "q", idx: str = "idx", **options: Any) -> DataFrame:
    """The k results that a relevance model scores best; its replies are numbers, others count as nothing."""
    scored = model_map(found.drop("score", "rank"), prompt, client, **options).withColumn("score", F.coalesce(F.col("response").try_cast("double"), F.lit(0.0)))
    return retrieval.top_k(scored.drop("response", "error"), k, by, "score", idx)


def decompose(questions: DataFrame, prompt: str, client: MakeClient, **options: Any) -> DataFrame:
    """questions with their frame, read from a JSON reply; without one it is empty."""
    out = model_map(questions, prompt, client, **options)
    return out.withColumn("pico", P.normalize_pico(F.coalesce(X.json_object(F.col("response")), F.lit("{}")))).drop("response")


def enrich(kb: DataFrame, prompt: str, client: MakeClient, ask: Callable[..., DataFrame] = model_map, **options: Any) -> DataFrame:
    """Records with frame (empty outcomes dropped) and synonyms; failed rows stay, with both empty and their error. ask=model_batches sends several prompts a call."""
    out = ask(kb, prompt, client, **options)
    reply = F.coalesce(X.json_object(F.col("response")), F.lit("{}"))
    synonyms = F.transform_values(P.outcome_map(F.try_parse_json(reply), "$.synonyms", False), lambda _, v: F.array_distinct(v))
    return out.withColumn("pico", P.normalize_pico(reply, keep_empty=False)).withColumn("synonyms", synonyms).drop("response")


def route(entries: DataFrame, prompt: str, client: MakeClient, **options: Any) -> DataFrame:
    """entries with a judge's decision: a row that cannot be read is a no with its error, and no other row is lost."""
    out = model_map(entries, prompt, client, **options)
    judged = out.withColumn("judge", P.judge(X.json_object(F.col("response"))))
    return judged.withColumn("error", F.when(X.json_object(F.col("response")).isNull(), F.coalesce("error", F.lit("no JSON object"))).otherwise(F.col("error"))).drop("response")


def screen(papers: DataFrame, key: str, prompt: Column, client: MakeClient, runs: int = 3, threshold: int = 2, judged_keys: DataFrame | None = None, **options: Any) -> DataFrame:
    """(key, included_num, runs) of papers that enough of the runs include. Each run asks anew; rows outside judged_keys are excluded without a call."""
    asked = papers if judged_keys is None else papers.join(judged_keys, key, "left_semi")
    each = asked.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs)))).withColumn("_prompt", F.concat(F.lit("run "), "run", F.lit("|"), prompt))
    replies = model_map(each, "_prompt", client, **options)
    verdict = F.when(F.coalesce(X.option(F.col("response"), ["Included", "Excluded"], "verdict"), F.lit("Excluded")) == "Included", "Included").otherwise("Excluded")
    return records.included_by_votes(replies.withColumn("verdict", verdict), [key], "verdict", threshold, runs)


def extract_first(papers: DataFrame, prompts: Sequence[str], client: MakeClient, failure: str = FAILURE, **options: Any) -> DataFrame:
    """papers with the answer of the first prompt column whose reply does not fail: only rows that are still open go to the next one."""
    todo, done = papers.withColumn("answer", F.lit(None).cast("string")), None
    for n, prompt in enumerate(prompts):
        out = model_map(todo.drop("answer"), prompt, client, **options)
        found = out.withColumn("answer", F.when(~F.contains(F.coalesce("response", F.lit(failure)), F.lit(failure)), F.col("response"))).drop("response", "error")
        last = n == len(prompts) - 1
        part = found if last else found.where("answer IS NOT NULL")
        done = part if done is None else done.unionByName(part)
        todo = found.where("answer IS NULL")
    return done if done is not None else todo


def merge_answers(rows: DataFrame, keys: Sequence[str], answers: str, order: str) -> DataFrame:
    """(keys, answers): the answers of all rows in order, each once."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct(order, answers))), lambda x: x[answers])
    return rows.groupBy(*keys).agg(F.aggregate(lists, F.array().cast("array<string>"), lambda acc, x: F.array_union(acc, x)).alias(answers))


def retrieve_and_ask(papers: DataFrame, key: str, question: str, client: MakeClient, retrieve: Callable[[DataFrame], DataFrame], writer: MakeClient, rounds: int = 3, failure: str = FAILURE, **options: Any) -> DataFrame:
    """(key, answers, round): questions answered from what is retrieved for them, in rounds; no answers and no round where all fail.

    papers: (key, question), one row a key. In the first round the question is the query. A reply without the failure phrase is an answer, and a row with one is
    closed; its answers are merged in the order of its queries, each once. Only open rows go on: writer is asked for new queries, one a
    line, and each of them retrieves and asks anew, but for prompts that have had a reply in an earlier round. retrieve adds the column ``context`` to (key, n, query, question) and keeps the rows.
    """
    todo = written(papers.select(key, F.col(question).alias("question")), "todo")
    asked, done, known = todo.select(key, F.lit(0).alias("n"), F.col("question").alias("query"), "question"), None, None
    for number in range(1, rounds + 1):
        prompts = retrieve(asked).withColumn("_prompt", F.concat(F.coalesce("context", F.lit("")), F.lit("\n"), "question"))
        replies = written(model_map(prompts, "_prompt", client, cache=known, **options), "replies")
        heard = replies.where("response IS NOT NULL").select(prompt_key("_prompt").alias("key"), "response")
        known = heard if known is None else known.unionByName(heard)
        good = replies.where(~F.contains(F.coalesce("response", F.lit(failure)), F.lit(failure))).select(key, "n", F.array("response").alias("answers"))
        answers = written(merge_answers(good, [key], "answers", "n").withColumn("round", F.lit(number)), "answers")
        done = answers if done is None else done.unionByName(answers)
        todo = written(todo.join(answers, key, "left_anti"), "todo")
        if number == rounds or todo.isEmpty():
            break
        lines = model_map(todo.withColumn("_prompt", F.concat(F.lit(f"{number}|"), "question")), "_prompt", writer, **options)
        queries = F.filter(F.transform(F.split(F.coalesce("response", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
        asked = lines.select(key, F.posexplode(F.array_distinct(queries)).alias("n", "query"), "question")
    return done.unionByName(todo.select(key, F.array().cast("array<string>").alias("answers"), F.lit(None).cast("int").alias("round")))


def grade_steps(rating: Column) -> Column:
    """0, -1 or -2 of a rating by name; null for anything else."""
    out = F.lit(None).cast("int")
    for name, step in GRADE_STEPS.items():
        out = F.when(F.upper(F.regexp_replace(F.trim(rating), r"[\s-]+", "_")) == name, step).otherwise(out)
    return out


def bias_prompts(papers: DataFrame, questions: dict[str, str], title: str) -> DataFrame:
    """A row for each paper and question of a risk-of-bias form, with the prompt."""
    asked = F.array(*[F.struct(F.lit(k).alias("domain"), F.lit(q).alias("question")) for k, q in questions.items()])
    rows = papers.withColumn("_q", F.explode(asked))
    return rows.select(*papers.columns, "_q.domain", F.concat(F.col(title), F.lit("\n"), F.col("_q.question")).alias("prompt"))


def _gathered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], line: Column) -> DataFrame:
    """(keys, _lines, failed): a group's lines in order; rows without a reply have none and count as failed. A group's texts are held at once, as one prompt has to hold them."""
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("response").isNotNull(), F.struct(*order, line.alias("_line"))))), lambda x: x["_line"])
    return rows.groupBy(*keys).agg(F.array_join(lines, "\n").alias("_lines"), F.count_if(F.col("response").isNull()).alias("failed"))


def bias_rating(papers: DataFrame, key: str, paper: str, title: str, questions: dict[str, str], client: MakeClient, judge: MakeClient, lead: str = "Rate the risk of bias.", ratings: Sequence[str] = ("Not serious", "Serious", "Very serious"), **options: Any) -> DataFrame:
    """(key, rating, steps, failed): the risk of bias of each key's papers together.

    Every paper is asked all questions of a form. The answers, by paper and question, go into one prompt a key, whose reply names a rating in an
    option tag; any other reply is no rating. steps is what the rating takes away, failed counts questions without an answer.
    """
    asked = bias_prompts(papers, questions, title)
    replies = model_map(asked, "prompt", client, **options).withColumn("_place", F.array_position(F.array(*map(F.lit, questions)), F.col("domain")))
    said = _gathered(replies, [key], [paper, "_place"], F.concat(F.col(paper).cast("string"), F.lit(" "), "domain", F.lit(": "), "response"))
    out = model_map(said.withColumn("_prompt", F.concat(F.lit(lead + "\n"), "_lines")), "_prompt", judge, **options)
    rating = X.option(F.col("response"), ratings)
    return out.select(key, rating.alias("rating"), grade_steps(rating).alias("steps"), "failed")


PARTICIPANTS = "How many participants are in the group of {group} that was assessed for {outcome}?"


def participants(pairs: DataFrame, key: str, paper: str, title: str, group: str, outcome: str, retrieve: Callable[[DataFrame], DataFrame], client: MakeClient, summary: MakeClient, rules: str = "", question: str = PARTICIPANTS, **options: Any) -> DataFrame:
    """(key, studies, participants, by_paper, failed, error): the participants of a group over all papers of an outcome.

    pairs: a row for each key and paper, with the paper's title and the names of group and outcome. retrieve adds ``context``, what the paper says to ``question``.
    Each pair is asked alone; the answers of a key, by paper, with the number of studies and further rules, go into one prompt, whose JSON reply holds
    the sum (participants) and a map of papers to numbers (by_paper). Numbers may be texts. A reply that is no such JSON leaves both null, with an error.
    """
    before, between, after = question.replace("{outcome}", "{group}").split("{group}")
    text = F.concat(F.lit(before), F.col(group), F.lit(between), F.col(outcome), F.lit(after))
    asked = retrieve(pairs.withColumn("question", text)).withColumn("_prompt", F.concat(F.coalesce("context", F.lit("")), F.lit("\nBased on the given content, "), "question"))
    replies = model_map(asked, "_prompt", client, **options).drop("error")
    studies = replies.groupBy(key).agg(F.count_distinct(paper).alias("studies"))
    said = _gathered(replies, [key], [paper], F.concat(F.col(paper).cast("string"), F.lit(" ("), F.col(title), F.lit("): "), "response")).join(studies, key)
    prompts = said.withColumn("_prompt", F.concat_ws("\n", F.concat(F.lit("Studies: "), "studies"), F.lit(rules or None), "_lines"))
    out = model_map(prompts, "_prompt", summary, **options)
    v = F.try_parse_json(X.json_object(F.col("response")))
    numbers = F.transform_values(F.try_variant_get(v, "$.by_paper", "map<string,string>"), lambda _, n: F.trim(n).try_cast("bigint"))
    total = F.trim(F.try_variant_get(v, "$.participants", "string")).try_cast("bigint")
    error = F.when(total.isNull(), F.coalesce("error", F.lit("no number of participants")))
    return out.select(key, "studies", total.alias("participants"), numbers.alias("by_paper"), "failed", error.alias("error"))


def cell_questions(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """A row for each table cell to extract: six for dichotomous and time-to-event data, four for continuous data, none for others. Columns intervention, comparator and outcome name the groups."""
    i, c, o = F.col("intervention"), F.col("comparator"), F.col("outcome")

    def cell(name: str, *parts: Column | str) -> Column:
        return F.struct(F.lit(name).alias("cell"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("question"))

    sizes = [cell(f"participants_{g}", "How many participants are in the group of ", x, "?") for g, x in (("intervention", i), ("comparator", c))]
    events = [cell(f"{w}_{g}", f"How many participants of ", x, f" {did} ", o, "?") for g, x in (("intervention", i), ("comparator", c)) for w, did in (("events", "had"), ("non_events", "did not have"))]
    means = [cell(f"mean_{g}", "What are the mean and standard deviation of ", o, " for ", x, "?") for g, x in (("intervention", i), ("comparator", c))]
    many = F.when(F.col(kind).isin("Dichotomous Data", "Time-to-event Data"), F.array(*sizes, *events)).when(F.col(kind) == "Continuous Data", F.array(*sizes, *means))
    return rows.select(*rows.columns, F.inline(many))


def variants(questions: DataFrame, question: str, prompt: str, client: MakeClient, **options: Any) -> DataFrame:
    """questions with a rephrasing; a reply that is blank or the same question counts as failed."""
    out = model_map(questions, prompt, client, **options)
    same = X.normalize_spaces(F.col("response")) == X.normalize_spaces(F.col(question))
    good = F.col("response").isNotNull() & (F.trim("response") != "") & ~same
    return out.withColumn("variant", F.when(good, F.trim("response"))).withColumn("error", F.when(~F.coalesce(good, F.lit(False)), F.coalesce("error", F.lit("no new wording")))).drop("response")


def single_change_error(old: Column, new: Column, component: Column, place: Column) -> Column:
    """Null if exactly the one element of a normalised frame has changed, else what is wrong. component: P, I or C; place: which comparator, from 0.

    A changed comparator takes its outcomes, unchanged, to its new name. Changes of case and white space are none.
    """

    def outcomes(x: Column) -> Column:
        return F.array_sort(F.map_entries(x["O"]))

    def at(x: Column, key: Column) -> Column:
        return F.try_element_at(x["O"], key)

    def text(name: str, others: Sequence[str]) -> Column:
        same = X.normalize_spaces(old[name]) == X.normalize_spaces(new[name])
        moved = reduce(lambda a, b: a | b, [~old[k].eqNullSafe(new[k]) for k in others])
        return F.when(same, f"{name} is not changed").when(moved, f"only {name} may change").when(outcomes(old) != outcomes(new), "O may not change")

    places = F.sequence(F.lit(0), F.size(old["C"]) - 1)
    differ = F.filter(places, lambda k: X.normalize_spaces(F.get(old["C"], k)) != X.normalize_spaces(F.get(new["C"], k)))
    kept = F.forall(places, lambda k: at(new, F.when(k == place, F.get(new["C"], k)).otherwise(F.get(old["C"], k))).eqNullSafe(at(old, F.get(old["C"], k))))
    comparator = (
        F.when(~old["P"].eqNullSafe(new["P"]) | ~old["I"].eqNullSafe(new["I"]), "only C may change")
        .when((F.size(old["C"]) != F.size(new["C"])) | (F.size(old["C"]) == 0), "the number of comparators may not change")
        .when(~differ.eqNullSafe(F.array(place)), "exactly one comparator has to change")
        .when(F.array_sort(F.array_distinct(new["C"])) != F.array_sort(F.map_keys(new["O"])), "outcomes have to be those of the comparators")
        .when(~kept, "a comparator's outcomes may not change")
    )
    return F.when(component == "P", text("P", ["I", "C"])).when(component == "I", text("I", ["P", "C"])).when(component == "C", comparator).otherwise("no such element")


def perturb(questions: DataFrame, key: str, pico: str, prompt: str, client: MakeClient, retry: int = 2, component: str = "component", place: str = "place", **options: Any) -> DataFrame:
    """(key, question, pico, error): questions reworded so that exactly the element named by component and place changes, as a model writes them.

    A reply is a JSON object with question and pico. One that changes anything else, or nothing, fails; only failed rows are asked again, up to retry times, and keep their last error.
    """
    todo, done = written(questions.select(key, F.col(pico).alias("_old"), F.col(prompt).alias("_asked"), F.col(component).alias("_component"), F.col(place).alias("_at")), "todo"), None
    for attempt in range(retry + 1):
        out = model_map(todo.withColumn("_prompt", F.concat(F.lit(f"{attempt}|"), "_asked")), "_prompt", client, **options)
        reply = X.json_object(F.col("response"))
        out = out.withColumn("pico", P.normalize_pico(F.coalesce(reply, F.lit("{}")))).withColumn("question", F.trim(F.try_variant_get(F.try_parse_json(reply), "$.question", "string")))
        wrong = F.when(reply.isNull(), F.coalesce("error", F.lit("no JSON object"))).when(F.coalesce("question", F.lit("")) == "", "no question").otherwise(single_change_error(F.col("_old"), F.col("pico"), F.col("_component"), F.col("_at")))
        out = written(out.withColumn("error", wrong), "perturbed")
        last = attempt == retry
        part = (out if last else out.where("error IS NULL")).select(key, F.when(F.col("error").isNull(), F.col("question")).alias("question"), F.when(F.col("error").isNull(), F.col("pico")).alias("pico"), "error")
        done = part if done is None else done.unionByName(part)
        todo = out.where("error IS NOT NULL").select(*todo.columns)
        if last or todo.isEmpty():
            break
    return done


def recommend(evidence: DataFrame, key: str, order: str, text: str, prompt: str, client: MakeClient, **options: Any) -> DataFrame:
    """(key, response, error): the interpretations of a key's outcomes, in order, put into one prompt and answered."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    joined = evidence.groupBy(key).agg(F.concat(F.lit(prompt), lines).alias("_prompt"))
    return model_map(joined, "_prompt", client, **options).drop("_prompt")


def recommendation_chain(outcomes: DataFrame, question: str, comparison: str, order: str, text: str, leads: Sequence[str], client: MakeClient, **options: Any) -> DataFrame:
    """(question, rationale, recommendation, failed) in four steps, each prompt after one of the four leads.

    Every outcome is interpreted, the interpretations of a comparison are summarised, the summaries of a question become a
    rationale, and that a recommendation. A call without a reply leaves no line in the next prompt and counts in ``failed``.
    """
    interpret, summarise, reason, conclude = leads

    def ask(rows: DataFrame, lead: str, said: str, out: str) -> DataFrame:
        replies = model_map(rows.withColumn("_prompt", F.concat(F.lit(lead), F.coalesce(F.col(said), F.lit("")))), "_prompt", client, **options)
        return replies.withColumn("failed", F.col("failed") + F.when(F.col("response").isNull(), 1).otherwise(0)).withColumnRenamed("response", out).drop("_prompt", "error")

    def gathered(rows: DataFrame, keys: Sequence[str], by: str, line: Column) -> DataFrame:
        lines = F.transform(F.array_sort(F.collect_list(F.struct(by, line.alias("_line")))), lambda x: x["_line"])
        return rows.groupBy(*keys).agg(F.array_join(lines, "\n").alias("_said"), F.sum("failed").alias("failed"))

    rows = outcomes.select(question, comparison, order, text, F.lit(0).cast("long").alias("failed"))
    interpreted = ask(rows, interpret, text, "_reply")
    summaries = ask(gathered(interpreted, [question, comparison], order, F.col("_reply")), summarise, "_said", "_reply")
    rationales = ask(gathered(summaries, [question], comparison, F.concat(F.col(comparison), F.lit(": "), "_reply")), reason, "_said", "rationale")
    return ask(rationales, conclude, "rationale", "recommendation").select(question, "rationale", "recommendation", "failed")


def search_rounds(terms: DataFrame, prompt: str, client: MakeClient, feedback: Callable[[DataFrame], DataFrame], rounds: int = 3, done: str = "SEARCH_COMPLETE", **options: Any) -> DataFrame:
    """terms with a strategy that is revised until the reply says it is complete, at most so many times; feedback adds the column ``feedback`` to a table with ``strategy``. Complete rows are not asked again."""
    now = model_map(terms, prompt, client, **options).withColumnRenamed("response", "strategy").drop("error")
    finished = None
    for _ in range(rounds):
        seen = feedback(now)
        asked = seen.withColumn("_prompt", F.concat("strategy", F.lit("\n"), F.coalesce("feedback", F.lit("")))).drop("feedback")
        out = model_map(asked, "_prompt", client, **options)
        complete = F.contains(F.coalesce("response", F.lit(done)), F.lit(done))
        part = out.where(complete).drop("_prompt", "response", "error")
        finished = part if finished is None else finished.unionByName(part)
        now = out.where(~complete).withColumn("strategy", F.col("response")).drop("_prompt", "response", "error")
    return now if finished is None else finished.unionByName(now)
