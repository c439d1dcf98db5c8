"""How a module of this package declares its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
Queries = dict[str, tuple[Query, str]]


def declare(queries: Queries) -> Callable[[str, str], Callable[[Query], Query]]:
    """A decorator @query(name, sql); an empty sql declares a query that SQL cannot express."""

    def query(name: str, sql: str = "") -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            queries[name] = (f, sql)
            return f

        return add

    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table with ``_place``, which rises with the file's path and the row in the file: where an order leaves a tie, the SQL of this package takes the row that was stored first.

    Only one row a file comes together to number the files.
    """
    rows = table(spark, sf_dir, name).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = rows.select("_file").distinct().select("_file", (F.row_number().over(Window.orderBy("_file")) - 1).cast("long").alias("_rank"))
    return rows.join(F.broadcast(files), "_file").withColumn("_place", F.shiftleft("_rank", 40) + F.col("_row")).drop("_file", "_row", "_rank")
