"""Evidence grouping: papers by outcome and design, assessed scores, lookups and stage tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.operators.records import numbered
from quarrystone.scratch import written

# Keys whose presence makes an outcome assessed.
ASSESSED_KEYS = ("Risk of bias", "No of participants", "Effect", "Certainty", "result_interpretation")


def papers_of_outcomes(outcomes: DataFrame, papers: DataFrame, uids: str = "related_paper_list", uid: str = "paper_uid") -> DataFrame:
    """A row for each outcome and related paper."""
    return outcomes.withColumn(uid, F.explode(uids)).join(papers, uid)


def group_papers(papers: DataFrame, keys: Sequence[str], uid: str) -> DataFrame:
    """(keys, papers): sorted distinct uids of each group."""
    return papers.groupBy(*keys).agg(F.sort_array(F.collect_set(uid)).alias("papers"))


def grade_score(keys: Column) -> Column:
    """Of the array of an outcome's assessment keys: their number, and 100 more if one of ASSESSED_KEYS is there."""
    some = F.arrays_overlap(keys, F.array(*[F.lit(k) for k in ASSESSED_KEYS]))
    return F.size(keys) + F.when(some, 100).otherwise(0)


def assessed(outcomes: DataFrame, by: str, keys: str) -> DataFrame:
    """(by, score) of groups whose total score is 100 or more."""
    return outcomes.groupBy(by).agg(F.sum(grade_score(F.col(keys))).alias("score")).where("score >= 100")


def lookup(rows: DataFrame, mapping: dict[str, str], column: str, out: str) -> DataFrame:
    """rows with the mapped value; rows without one are dropped. The mapping is a constant of the program: the planner broadcasts it by its size."""
    m = rows.sparkSession.createDataFrame(sorted(mapping.items()), f"`{column}` string, `{out}` string")
    return rows.join(m, column)


def natural_key(code: Column) -> Column:
    """(major, minor) of the first n.m of a code, (999, 999) without one: sorts codes as people do."""
    major = F.regexp_extract(code, r"(\d+)\.(\d+)", 1)
    minor = F.regexp_extract(code, r"(\d+)\.(\d+)", 2)
    return F.struct(F.when(major != "", major.cast("int")).otherwise(999).alias("major"), F.when(minor != "", minor.cast("int")).otherwise(999).alias("minor"))


def latest(rows: DataFrame, keys: Sequence[str], order: str, valid: Column | None = None) -> DataFrame:
    """The newest valid row of each key."""
    fields = [c for c in rows.columns if c not in keys]
    kept = rows if valid is None else rows.where(valid)
    return kept.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("_row")).select(*keys, "_row.*")


def valid_stages(artifacts: DataFrame, order: Sequence[str]) -> DataFrame:
    """(pico_idx, stage, valid) from artifacts (pico_idx, stage, input_hash, output_hash, ts): the newest artifact of a stage counts, and is valid if its input is the newest output of the stage before and that is valid."""
    names = F.array(*[F.lit(s) for s in order])
    now = latest(artifacts, ["pico_idx", "stage"], "ts").withColumn("_at", F.array_position(names, F.col("stage")))
    w = Window.partitionBy("pico_idx").orderBy("_at")
    fits = (F.col("_at") == 1) | ((F.lag("_at").over(w) == F.col("_at") - 1) & (F.lag("output_hash").over(w) == F.col("input_hash")))
    marked = now.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    return marked.select("pico_idx", "stage", F.min("_fits").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("valid"))


def current_stage(artifacts: DataFrame, order: Sequence[str]) -> DataFrame:
    """(pico_idx, stage): the last valid stage."""
    names = F.array(*[F.lit(s) for s in order])
    done = valid_stages(artifacts, order).where("valid").withColumn("_at", F.array_position(names, F.col("stage")))
    return done.groupBy("pico_idx").agg(F.max_by("stage", "_at").alias("stage"))


def cascade(events: DataFrame, stages: Sequence[Sequence[str]], by: str = "entity", order: str = "seq", key: str = "key", value: str = "value") -> DataFrame:
    """events with ``effective``, a column ``now_<key>`` for every output and ``stage``: the state after each event of updates to stages' outputs.

    stages lists each stage's output keys. An update to an equal value does nothing; another one sets the value and clears the outputs of all
    later stages. stage is the number of stages, from the first on, whose outputs are all there. Keys of no stage change nothing.

    A stage's outputs are cleared by effective updates of earlier stages only. So stages are taken in order: within an entity an update is
    effective unless it equals the one before it of its key and nothing was cleared in between, which is a count of earlier stages' effective updates.
    """
    told = Window.partitionBy(by).orderBy(order)
    upto = told.rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumn("_hits", F.lit(0).cast("long")).withColumn("_real", F.lit(False))
    seen: list[Column] = []
    for k, keys in enumerate(stages):
        mine = F.col(key).isin(list(keys))
        before = F.lag(F.struct(F.col(value).alias("v"), F.col("_hits").alias("c"))).over(Window.partitionBy(by, key).orderBy(order))
        out = out.withColumn("_before", before)
        held = F.when(F.col("_before.c") == F.col("_hits"), F.col("_before.v"))
        out = out.withColumn("_real", F.when(mine, ~held.eqNullSafe(F.col(value))).otherwise(F.col("_real")))
        for name in keys:
            out = out.withColumn(f"_last_{k}_{name}", F.last(F.when(F.col(key) == name, F.struct(F.col(value).alias("v"), F.col("_hits").alias("c"))), ignorenulls=True).over(upto))
        now = [F.when(F.col(f"_last_{k}_{name}.c") == F.col("_hits"), F.col(f"_last_{k}_{name}.v")).alias(f"now_{name}") for name in keys]
        out = out.select("*", *now).withColumn("_hits", F.sum(F.when(F.col("_real"), 1).otherwise(0)).over(upto))
        whole = reduce(lambda a, b: a & b, [F.col(f"now_{name}").isNotNull() for name in keys])
        seen.append(seen[-1] & whole if seen else whole)
    done = reduce(lambda a, b: a + b, [F.when(x, 1).otherwise(0) for x in seen])
    names = [f"now_{name}" for keys in stages for name in keys]
    return out.select(*events.columns, F.col("_real").alias("effective"), *names, done.alias("stage"))


# --- graphs as edge tables ----------------------------------------------------------------------------------------


def delete_triplets(edges: DataFrame, nodes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges without the given (subj, rel, obj), and nodes without endpoints of removed edges that have no edge left."""
    rest = edges.join(gone, ["subj", "rel", "obj"], "left_anti")
    touched = gone.select(F.explode(F.array("subj", "obj")).alias("id")).distinct()
    linked = rest.select(F.explode(F.array("subj", "obj")).alias("id")).distinct()
    return rest, nodes.join(touched.join(linked, "id", "left_anti"), "id", "left_anti")


def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level): the longest path from a node without a parent, for acyclic tables of (parent, child); a cycle raises ValueError.

    Level by level, every edge is removed once, so neither depth nor the number of paths is bounded; two written tables a level.
    """
    left = written(edges.select("parent", "child").distinct(), "edges")
    done, level = None, 0
    while not left.isEmpty():
        now = written(left.select("parent").distinct().join(left.select(F.col("child").alias("parent")), "parent", "left_anti"), "level")
        if now.isEmpty():
            raise ValueError("the edges have a cycle")
        rest = written(left.join(now, "parent", "left_anti"), "edges")
        ends = left.join(now, "parent", "left_semi").select(F.col("child").alias("node")).distinct()
        ends = ends.join(rest.select(F.explode(F.array("parent", "child")).alias("node")), "node", "left_anti")
        found = now.select(F.col("parent").alias("node"), F.lit(level).alias("level")).unionByName(ends.withColumn("level", F.lit(level + 1)))
        done = found if done is None else done.unionByName(found)
        left, level = rest, level + 1
    if done is None:
        return edges.select(F.col("parent").alias("node"), F.lit(0).alias("level")).where("false")
    return done


def post_order(nodes: DataFrame, node: str = "node", parent: str = "parent", order: str = "place") -> DataFrame:
    """(node, position): the place from 1 of every node of a forest when children, by order, come before their parent. Roots have no parent.

    An Euler tour passes every node on the way down and on the way up. Nodes are numbered by (parent, order), so the next sibling
    is the next number; each step of the tour knows the next one, and pointers are doubled until every step knows how many ways up
    follow it: a logarithm of the nodes in rounds, each a join and a written table, however deep or wide the forest is. Two
    parents of a node, a parent that is not there and a ring raise ValueError.
    """
    rows = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(order).alias("place"))
    num = written(numbered(rows, F.col("parent"), F.col("place"), F.col("node")), "numbered")
    total = num.count()
    if num.select("node").distinct().count() < total:
        raise ValueError("a node is there twice")
    ids = num.select(F.col("node").alias("parent"), F.col("n").alias("pn"))
    if not num.where("parent IS NOT NULL").join(ids, "parent", "left_anti").isEmpty():
        raise ValueError("a parent is not among the nodes")
    first = num.where("parent IS NOT NULL").groupBy("parent").agg(F.min("n").alias("kid")).withColumnRenamed("parent", "node")
    after = num.select((F.col("n") - 1).alias("n"), F.struct(F.col("parent")).alias("theirs"), F.lit(True).alias("more"))
    links = num.join(ids, "parent", "left").join(first, "node", "left").join(after, "n", "left")
    sibling = F.col("more") & (F.struct(F.col("parent")) == F.col("theirs"))
    down = F.struct((2 * F.col("n")).alias("step"), F.coalesce(2 * F.col("kid"), 2 * F.col("n") + 1).alias("next"), F.lit(0).cast("long").alias("ups"))
    up = F.struct((2 * F.col("n") + 1).alias("step"), F.when(sibling, 2 * F.col("n") + 2).otherwise(2 * F.col("pn") + 1).alias("next"), F.lit(1).cast("long").alias("ups"))
    tour = written(links.select(F.inline(F.array(down, up))), "tour")
    for _ in range((2 * total).bit_length() + 1):
        if tour.where("next IS NOT NULL").isEmpty():
            break
        then = tour.select(F.col("step").alias("next"), F.col("next").alias("later"), F.col("ups").alias("more"))
        on = tour.where("next IS NOT NULL").join(then, "next").select("step", F.col("later").alias("next"), (F.col("ups") + F.col("more")).alias("ups"))
        tour = written(on.unionByName(tour.where("next IS NULL")), "tour")  # steps that are done are not joined: with a null key they would all meet in one task
    else:
        raise ValueError("the parents form a ring")
    ups = tour.where("step % 2 = 1").select(F.expr("step div 2").alias("n"), (F.lit(total + 1) - F.col("ups")).alias("position"))
    return num.join(ups, "n").select("node", "position")


def graph_elements(text: Column) -> Column:
    """struct<nodes,links> of ``Node(id='a', type='T')`` and ``Relationship(subj=Node(id='a', …), obj=Node(id='b', …), type='R')`` strings; links need both nodes."""
    nodes = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^Node\(id='(.*?)', type='(?:.*?)'\)"), F.lit(1)))
    raw = F.regexp_extract_all(text, F.lit(r"(?m)^Relationship\((.*)\)$"), F.lit(1))
    ends = F.transform(raw, lambda r: F.struct(F.regexp_extract(r, r"subj=Node\(id='(.*?)'", 1).alias("subj"), F.regexp_extract(r, r"obj=Node\(id='(.*?)'", 1).alias("obj"), F.regexp_extract(r, r".*type='(.*?)'", 1).alias("type")))
    return F.struct(nodes.alias("nodes"), F.filter(ends, lambda e: F.array_contains(nodes, e["subj"]) & F.array_contains(nodes, e["obj"])).alias("links"))
