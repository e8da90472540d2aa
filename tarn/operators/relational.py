"""Selection, joins, ordering and paging over DataFrames, with one set of defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.operators.errors import BlobPredicateError

JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "cross": "cross"}


def _without_blobs(found: DataFrame, *inputs: DataFrame) -> DataFrame:
    """found, whose condition must not read a binary column of its inputs."""
    if any(isinstance(f.dataType, T.BinaryType) for df in inputs for f in df.schema.fields):
        read = found._jdf.queryExecution().analyzed().references().toSeq()
        if blobs := [read.apply(i).name() for i in range(read.size()) if read.apply(i).dataType().typeName() == "binary"]:
            raise BlobPredicateError(f"conditions can't use the columns {blobs}")
    return found


def where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true; binary columns can't be part of it."""
    return _without_blobs(df.where(condition), df)


def join(left: DataFrame, right: DataFrame, on: Column | Sequence[str] | None = None, how: str = "inner") -> DataFrame:
    """Inner and outer joins need a condition, which can't read binary columns; only a cross join has none."""
    if how not in JOINS:
        raise ValueError(f"unknown join: {how}")
    if how == "cross":
        if on is not None:
            raise ValueError("a cross join takes no condition")
        return left.crossJoin(right)
    if on is None:
        raise ValueError(f"{how} join requires a condition")
    if isinstance(on, Column):
        return _without_blobs(left.join(right, on, JOINS[how]), left, right)
    if blobs := [f.name for df in (left, right) for f in df.schema.fields if f.name in on and isinstance(f.dataType, T.BinaryType)]:
        raise BlobPredicateError(f"conditions can't use the columns {blobs}")
    return left.join(right, list(on), JOINS[how])


def sort(df: DataFrame, *keys: str | tuple[str, str] | tuple[str, str, str]) -> DataFrame:
    """Order by names, or (name, "asc" | "desc"[, "first" | "last"]); nulls come last either way unless said."""
    order = []
    for key in keys:
        name, way, nulls = (key, "asc", "last") if isinstance(key, str) else (*key, "last")[:3]
        order.append(getattr(F.col(name), f"{way}_nulls_{nulls}")())
    return df.orderBy(*order)


def limit(df: DataFrame, n: int | None = None, offset: int = 0) -> DataFrame:
    """OFFSET, then LIMIT."""
    df = df.offset(offset) if offset else df
    return df if n is None else df.limit(n)


def page(df: DataFrame, keys: Sequence, number: int, size: int = 50) -> DataFrame:
    """Page `number`, from 1, of df in the order of keys; past the end it is empty."""
    return limit(sort(df, *keys), size, (max(1, number) - 1) * size)


def page_count(df: DataFrame, size: int = 50) -> int:
    return -(-df.count() // size)
