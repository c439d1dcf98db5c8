"""Services that hand out results page by page, as a source of Spark's Python Data Source API."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

Fetch = Callable[[int, int], pa.Table]


class Page(InputPartition):
    def __init__(self, start: int, size: int) -> None:
        self.start, self.size = start, size


class _Reader(DataSourceReader):
    def __init__(self, fetch: Fetch, pages: list[tuple[int, int]], retries: int, pause: float) -> None:
        self.fetch, self.pages, self.retries, self.pause = fetch, pages, retries, pause

    def partitions(self) -> list[InputPartition]:
        return [Page(*p) for p in self.pages]

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        for attempt in range(self.retries):
            try:
                found = self.fetch(page.start, page.size)
                if len(found) != page.size:
                    raise ValueError(f"the page from {page.start} has {len(found)} of {page.size} rows")
                break
            except Exception:
                if attempt == self.retries - 1:
                    raise  # the task fails, and Spark runs this page's task again
                time.sleep(self.pause * 2**attempt)
        yield from found.to_batches()


def plan(total: int, chunk: int = 9900, batch: int = 350) -> list[tuple[int, int]]:
    """(start, size) of the requests that cover a result once: chunks as large as a service serves, each in batches. Offsets are absolute."""
    return [(at, min(batch, end - at)) for start in range(0, total, chunk) for end in [min(start + chunk, total)] for at in range(start, end, batch)]


def paged(spark: SparkSession, fetch: Fetch, total: int, schema: StructType, chunk: int = 9900, batch: int = 350, retries: int = 3, pause: float = 1.0) -> DataFrame:
    """The rows of a paged result: one input partition a page, so pages are fetched in parallel by the executors and a page that fails is fetched again alone.

    fetch(start, size) runs on executors and returns the page as an Arrow table of the schema; a page with another number of rows counts as failed. The driver holds the plan, a pair of numbers a page.
    """
    name, pages = f"paged_{uuid.uuid4().hex}", plan(total, chunk, batch)

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(fetch, pages, retries, pause)

    spark.dataSource.register(Paged)
    return spark.read.format(name).load()
