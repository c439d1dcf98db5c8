"""Walks through nested JSON values: what depth a value has is not known before, so each text is parsed and walked in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "...[truncated]"


def _walker(walk: Callable[[Any], Any], plain: bool = False) -> Callable[[Column], Column]:
    """A function of JSON columns; null and text that is no JSON give null. plain: the result is text, else JSON again."""

    def one(text: str) -> str | None:
        try:
            out = walk(json.loads(text))
        except (ValueError, RecursionError):
            return None
        return out if plain else None if out is None else json.dumps(out, ensure_ascii=False, separators=(",", ":"))

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return F.pandas_udf(run, T.StringType())


def truncate_nested(value: Column, most: int) -> Column:
    """JSON whose texts, at any depth, have at most so many characters and a mark; 0 or less leaves all alone."""

    def walk(x: Any) -> Any:
        if isinstance(x, str):
            return x[:most].rstrip() + MARK if 0 < most < len(x) else x
        if isinstance(x, list):
            return [walk(y) for y in x]
        return {k: walk(y) for k, y in x.items()} if isinstance(x, dict) else x

    return _walker(walk)(value)


def drop_long_lists_nested(value: Column, most: int = 128) -> Column:
    """JSON without lists that are as long as an embedding (``most`` values or more), at any depth: their keys go, and so do items of lists that are such lists or null. Null for one that is all there is."""

    def walk(x: Any) -> Any:
        if isinstance(x, dict):
            kept = {k: walk(y) if isinstance(y, dict | list) else y for k, y in x.items()}
            return {k: y for k, y in kept.items() if y is not None or not isinstance(x[k], dict | list)}
        if isinstance(x, list):
            return [y for y in map(walk, x) if y is not None] if len(x) < most else None
        return x

    return _walker(walk)(value)


def nested_text(value: Column) -> Column:
    """All texts and numbers in a JSON value, in order, joined by blanks, each list or object without blanks at its ends; keys are left out, and nulls are empty texts."""

    def walk(x: Any) -> str:
        if isinstance(x, dict | list):
            return " ".join(map(walk, x.values() if isinstance(x, dict) else x)).strip()
        return "" if x is None else str(x)

    return _walker(walk, plain=True)(value)
