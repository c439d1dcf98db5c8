"""Model calls as one partition-level operator.

Prompts are deduplicated by hash, answered from a response table where it has them,
and the rest go to a client made once a partition, with retries. Failures are a column,
not an exception. The number of partitions is the cap on concurrent clients.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.scratch import written_in_turn


class Client(Protocol):
    def __call__(self, prompt: str) -> str: ...


class EchoLength:
    """A stand-in client: the length of what follows the first bar; refuses prompts whose number before it divides by 7."""

    def __call__(self, prompt: str) -> str:
        number, _, text = prompt.partition("|")
        if int(number) % 7 == 0:
            raise ValueError("refused")
        return str(len(text))


def prompt_key(prompt: str | Column) -> Column:
    return F.sha2(F.col(prompt) if isinstance(prompt, str) else prompt, 256)


#: What ends a worker and is never a row's error.
_ENDS = (KeyboardInterrupt, SystemExit, GeneratorExit)
Call = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


#: A task is given about so many bytes of prompts; beyond that the prompts are asked in several jobs, one after another, so that the cap on clients stands.
TASK_BYTES = 1 << 28


def _answered(rows: DataFrame, prompt: str, call: Call, cache: DataFrame | None, concurrency: int) -> DataFrame:
    """rows with response and error: each distinct prompt outside the cache goes through call once, and the answers are written before this returns."""
    keyed = rows.withColumn("_key", prompt_key(prompt))
    asked = keyed.select("_key", F.col(prompt).alias("_prompt")).dropDuplicates(["_key"])
    if cache is not None:
        known = cache.select(F.col("key").alias("_key"), "response", F.lit(None).cast("string").alias("error"))
        asked = asked.join(known, "_key", "left_anti")
    size = rows.agg(F.sum(F.octet_length(prompt))).first()[0] or 0  # repeats and cached prompts included, so a bound
    turns = [asked]
    if size > concurrency * TASK_BYTES:
        n = -(-size // (concurrency * TASK_BYTES))
        asked = written_in_turn([asked.withColumn("_turn", F.pmod(F.xxhash64("_key"), F.lit(n)))], "asked", ["_turn"])
        turns = [asked.where(F.col("_turn") == k).drop("_turn") for k in range(n)]
    answers = written_in_turn([t.repartition(concurrency, "_key").mapInPandas(call, "_key string, response string, error string") for t in turns], "answers")
    if cache is not None:
        answers = answers.unionByName(known.dropDuplicates(["_key"]))
    return keyed.join(answers, "_key", "left").drop("_key")


def model_map(rows: DataFrame, prompt: str, client: Callable[[], Client], cache: DataFrame | None = None, concurrency: int = 4, retries: int = 3, pause: float = 0.0) -> DataFrame:
    """rows with response and error. cache has (key, response); each distinct prompt outside it is asked once.

    The answers are written to the shared folder before this returns, so nothing that reads the result asks again.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for batch in batches:
            out = []
            for key, text in zip(batch["_key"], batch["_prompt"], strict=True):
                answer, error = None, None
                for attempt in range(retries):
                    try:
                        answer, error = ask(text), None
                        break
                    except _ENDS:
                        raise
                    except BaseException as e:  # noqa: BLE001  a client may raise anything, a native one a panic that is no Exception; it becomes the row's error
                        error = str(e)
                        if pause:
                            time.sleep(pause * 2**attempt)
                out.append((key, answer, error))
            yield pd.DataFrame(out, columns=["_key", "response", "error"])

    return _answered(rows, prompt, call, cache, concurrency)


class BatchClient(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


def model_batches(rows: DataFrame, prompt: str, client: Callable[[], BatchClient], cache: DataFrame | None = None, concurrency: int = 4, size: int = 16, in_flight: int = 2, retries: int = 1) -> DataFrame:
    """model_map for clients that answer lists of prompts, in their order: size prompts a call, at most in_flight calls of a partition at a time.

    A call that fails, or gives another number of replies, is tried again and then split into halves, so that a prompt that no call can
    answer costs only its own row, which gets the error, and a bounded number of calls.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()

        def answers(part: pd.DataFrame) -> list[tuple]:
            for _ in range(retries):
                try:
                    replies = ask(part["_prompt"].tolist())
                    if len(replies) != len(part):
                        raise ValueError(f"{len(replies)} replies to {len(part)} prompts")
                    return [(k, r, None) for k, r in zip(part["_key"], replies, strict=True)]
                except _ENDS:
                    raise
                except BaseException as e:  # noqa: BLE001  as above
                    error = str(e)
            half = len(part) // 2
            return answers(part.iloc[:half]) + answers(part.iloc[half:]) if half else [(part["_key"].iloc[0], None, error)]

        with ThreadPoolExecutor(in_flight) as pool:
            waiting: deque = deque()
            for batch in batches:
                for at in range(0, len(batch), size):
                    if len(waiting) == in_flight:
                        yield pd.DataFrame(waiting.popleft().result(), columns=["_key", "response", "error"])
                    waiting.append(pool.submit(answers, batch.iloc[at : at + size]))
            while waiting:
                yield pd.DataFrame(waiting.popleft().result(), columns=["_key", "response", "error"])

    return _answered(rows, prompt, call, cache, concurrency)
