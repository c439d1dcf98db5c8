"""What the operators share: the shared folder for intermediate tables, and text expressions."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: A word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or in local mode a temporary one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarrystone-")
        spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """A run's own folder in the shared folder; it goes when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def keep(self, df: DataFrame, name: str, compression: str = "uncompressed") -> DataFrame:
        """Writes df as Parquet and reads it again: a cut in the lineage that survives lost executors, with real sizes for the planner.

        Hashes do not compress, and codecs hold buffers outside the heap for every open file; tables of text or tokens name a codec.
        """
        df.write.mode("overwrite").option("compression", compression).parquet(f"{self.path}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")


#: A table of keys with at most so many rows is sent to the rows of a text table; beyond it both sides are shuffled.
BESIDE_ROWS = 1 << 20


def beside(keys: DataFrame, most: int = BESIDE_ROWS) -> DataFrame:
    """A written table of keys, marked for broadcasting if it is counted to hold at most so many rows."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys.hint("merge")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_count(text: Column) -> Column:
    """Number of words as long; null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def as_column(value: Column) -> Column:
    """The same value, but computed once where it stands: the optimizer moves no filter below it and puts its definition into no lambda, where it would run for every element."""
    return F.when(F.spark_partition_id() >= 0, value)
