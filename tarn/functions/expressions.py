"""Scalar expressions where plain SQL meaning and Spark's defaults differ, and three-valued logic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def like(value: Column, pattern: str, negated: bool = False) -> Column:
    """LIKE with % and _ and no escape character: a backslash is an ordinary character."""
    found = value.like(pattern.replace("\\", "\\\\"))
    return ~found if negated else found


def in_list(value: Column, items: list, negated: bool = False) -> Column:
    """[NOT] IN over a list that may hold None: a match decides, else a null makes the answer null."""
    found = value.isin(*items)
    return ~found if negated else found


def between(value: Column, low: Column, high: Column, negated: bool = False) -> Column:
    found = (value >= low) & (value <= high)
    return ~found if negated else found


def concat(*parts: Column) -> Column:
    """||: null if any part is null; numbers and booleans as text."""
    return F.concat(*(p.cast("string") for p in parts))


def exact_sum(value: Column) -> Column:
    """The sum of numbers to six decimals, the same in any order of rows, as a double."""
    return F.sum(value.cast("decimal(28,6)")).cast("double")
