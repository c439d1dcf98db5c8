"""Literature records: validity, deduplication, screening votes and matching with what is already there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.scratch import written


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def numbered(rows: DataFrame, *order: Column, name: str = "n") -> DataFrame:
    """rows with their place from 1 in the whole order, which should be total.

    Rows are dealt by ranges of the order and written, so that a place is one within a range plus the rows of the ranges before it: only one count a range comes together.
    """
    keys = [f"_order_{k}" for k in range(len(order))]
    dealt = rows.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*[F.col(k) for k in keys])
    dealt = written(dealt.withColumn("_range", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) + F.col("_start")
    return dealt.join(starts, "_range").withColumn(name, place).select(*rows.columns, name)


def searchable(records: DataFrame, index: str, abstract: str, types: str, invalid: Sequence[str], *order: str) -> DataFrame:
    """Records with an abstract (it may be empty), the first of each index, without an invalid publication type.

    The order counts: a first copy of an invalid type takes its later copies with it.
    """
    first = first_rows(records.where(F.col(abstract).isNotNull()), [index], order)
    bad = F.array(*[F.lit(t) for t in invalid]).cast("array<string>")
    return first.where(~F.coalesce(F.arrays_overlap(F.coalesce(F.col(types), F.array().cast("array<string>")), bad), F.lit(False)))


def votes(runs: DataFrame, keys: Sequence[str], verdict: str, included: str = "Included") -> DataFrame:
    """(keys, included_num, runs): rows with a null key do not count."""
    return runs.dropna(subset=list(keys)).groupBy(*keys).agg(F.count_if(F.col(verdict) == included).alias("included_num"), F.count(F.lit(1)).alias("runs"))


def included_by_votes(runs: DataFrame, keys: Sequence[str], verdict: str, threshold: int, run_count: int) -> DataFrame:
    if threshold > run_count:
        raise ValueError("the threshold is above the number of runs")
    return votes(runs, keys, verdict).where(F.col("included_num") >= threshold)


def split_skipped(rows: DataFrame, keys: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Rows to judge and rows to skip, before any model is called."""
    return rows.join(keys, on, "left_semi"), rows.join(keys, on, "left_anti")


def override(universe: DataFrame, known: DataFrame, on: str, columns: Sequence[str], order: str) -> DataFrame:
    """universe with columns replaced where known has the key; of several known rows the last wins."""
    last = known.groupBy(on).agg(*[F.max_by(c, order).alias(f"_{c}") for c in columns])
    joined = universe.join(last, on, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else c for c in universe.columns])


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table without the keys of new, and new."""
    return table.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def transfer(source: DataFrame, target: DataFrame, key: str, assessed: Column) -> DataFrame:
    """target with the keys of source put in unless the target's row is assessed already."""
    done = target.where(assessed)
    return done.unionByName(source.join(done, key, "left_anti"), allowMissingColumns=True)


def newest_complete(files: DataFrame, stamp: str, run: str, run_count: int) -> DataFrame:
    """The files of the newest stamp that has every run from 0, in order of run."""
    whole = files.where(F.col(run) < run_count).groupBy(stamp).agg(F.count_distinct(run).alias("_n")).where(F.col("_n") == run_count).agg(F.max(stamp).alias(stamp))
    return files.join(whole, stamp, "left_semi").orderBy(run)


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with an array of the names of the rules that they break, and only rows that break one."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("violations", broken).where(F.size("violations") > 0)


def match_uploads(uploads: DataFrame, missing: DataFrame, by: str = "task", upload: str = "upload", file_name: str = "file_name", target: str = "target_uid", ordinal: str = "ordinal", uid: str = "paper_uid", path: str = "path") -> DataFrame:
    """(by, upload, path): the place of each upload among its task's missing papers, null where none fits.

    The first paper, by ordinal, fits whose uid is the upload's target, or is held, in lower case, by the file's stem; if none does, a task's only missing paper.
    """
    from quarrystone.operators.retrieval import substring_join

    name = F.regexp_extract(file_name, r"([^/]*)/*$", 1)
    stem = F.lower(F.coalesce(F.nullif(F.regexp_extract(name, r"(?s)^(.+)\.[^.]+$", 1), F.lit("")), name))
    asked = uploads.select(by, upload, F.col(target).alias("_target"), stem.alias("_stem"))
    wanted = missing.select(by, F.col(ordinal).alias("_ordinal"), F.col(uid).alias("_uid"), F.lower(uid).alias("_low"), F.col(path).alias("_path"))
    columns = [by, upload, "_ordinal", "_path"]
    held = substring_join(asked.where(F.col("_stem") != ""), wanted, "_stem", "_low", on=[by]).select(*columns)
    exact = asked.where(F.col("_target") != "").join(wanted.withColumn("_target", F.col("_uid")), [by, "_target"])
    first = held.unionByName(exact.select(*columns)).groupBy(by, upload).agg(F.min_by("_path", "_ordinal").alias("_found"))
    only = wanted.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.min("_path").alias("_sole")).where("_n = 1")
    return asked.select(by, upload).join(first, [by, upload], "left").join(only, by, "left").select(by, upload, F.coalesce("_found", "_sole").alias(path))


def refresh_manifest(missing: DataFrame, existing: DataFrame, files: DataFrame, by: str = "task", ordinal: str = "ordinal", path: str = "path") -> DataFrame:
    """(by, ordinal, path, status): a manifest of papers after a look at what files there are now.

    Papers that existed stay; missing ones whose file is there join them, the first of each path and none whose path exists already; the others stay missing.
    """
    there = files.select(F.col(path).alias("_file")).distinct()
    found = missing.join(there, F.col(path) == F.col("_file"), "left_semi")
    first = found.groupBy(by, path).agg(F.min(ordinal).alias(ordinal)).join(existing.select(by, path), [by, path], "left_anti")
    still = missing.join(there, F.col(path) == F.col("_file"), "left_anti")
    columns = [by, ordinal, path]
    now = existing.select(*columns).unionByName(first.select(*columns)).withColumn("status", F.lit("existing"))
    return now.unionByName(still.select(*columns).withColumn("status", F.lit("missing")))


def manifest_counts(manifest: DataFrame, by: str = "task") -> DataFrame:
    """(by, existing, missing, total) of refresh_manifest's rows."""
    return manifest.groupBy(by).agg(F.count_if(F.col("status") == "existing").alias("existing"), F.count_if(F.col("status") == "missing").alias("missing"), F.count(F.lit(1)).alias("total"))


def split_rejects(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, rejected rows with the names of the rules they break as ``violations``)."""
    fine = F.lit(True)
    for ok in rules.values():
        fine = fine & F.coalesce(ok, F.lit(False))
    return rows.where(fine), violations(rows, rules)


def screening_summary(rows: DataFrame, by: str, order: str, verdict: str, sample: dict[str, Column], most: int = 3, included: str = "Included", excluded: str = "Excluded") -> DataFrame:
    """(by, total_screened, total_included, total_excluded, sample_included): the counts of each group, and its first included rows as structs of the given columns."""
    told = rows.withColumn("_verdict", F.trim(F.coalesce(verdict, F.lit(""))))
    counts = told.groupBy(by).agg(F.count(F.lit(1)).alias("total_screened"), F.count_if(F.col("_verdict") == included).alias("total_included"), F.count_if(F.col("_verdict") == excluded).alias("total_excluded"))
    first = told.where(F.col("_verdict") == included).withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= most)
    one = F.struct(F.col("_n"), F.struct(*[c.alias(k) for k, c in sample.items()]).alias("row"))
    shown = first.groupBy(F.col(by).alias("_by")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["row"]).alias("sample_included"))
    out = counts.join(shown, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    return out.withColumn("sample_included", F.coalesce("sample_included", F.filter(F.array(F.lit(None).cast(out.schema["sample_included"].dataType.elementType)), lambda x: F.lit(False))))


def input_postfixes(comparisons: DataFrame, files: DataFrame, done: DataFrame, candidates: Sequence[str], by: str = "task", comparator: str = "comparator", postfix: str = "postfix") -> DataFrame:
    """(by, comparator, postfix): for every comparison that is not done, the first of its candidate postfixes, by the order of the columns given, of which there are files; null if of none.

    A task with a single comparison also takes, after its own candidates, the plain name (an empty postfix) and then any postfix that has files, the first in order. Null candidates are passed over.
    """
    open_ = comparisons.join(done.select(by, comparator), [by, comparator], "left_anti")
    alone = comparisons.groupBy(by).agg((F.count(F.lit(1)) == 1).alias("_alone"))
    there = files.select(by, F.coalesce(postfix, F.lit("")).alias("_there")).distinct()
    own = open_.select(by, comparator, F.posexplode(F.array(*candidates)).alias("_place", "_there")).where("_there IS NOT NULL")
    single = open_.join(alone.where("_alone"), by).select(by, comparator)
    plain = single.select(by, comparator, F.lit(len(candidates)).alias("_place"), F.lit("").alias("_there"))
    found = own.unionByName(plain).join(there, [by, "_there"]).select(by, comparator, "_place", "_there")
    found = found.unionByName(single.join(there, by).select(by, comparator, F.lit(len(candidates) + 1).alias("_place"), "_there"))
    first = found.groupBy(by, comparator).agg(F.min(F.struct("_place", "_there"))["_there"].alias(postfix))
    return open_.select(by, comparator).join(first, [by, comparator], "left")
