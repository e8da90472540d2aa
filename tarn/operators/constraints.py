"""NOT NULL, UNIQUE and PRIMARY KEY, checked over whole DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.errors import ConstraintViolation


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, and how many have them; keys with a null are never equal."""
    known = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return known.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check(df: DataFrame, not_null: Sequence[str] = (), unique: Sequence[Sequence[str]] = (), primary_key: Sequence[str] = ()) -> DataFrame:
    """df itself, or ConstraintViolation. One pass for all nulls, and one shuffle on each key."""
    not_null = list(dict.fromkeys([*not_null, *primary_key]))
    if not_null:
        found = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in not_null)).first()
        broken = [c for c in not_null if found[c]]
        if broken:
            raise ConstraintViolation(f"null in {', '.join(broken)}")
    for keys in [*unique, *([primary_key] if primary_key else [])]:
        if row := duplicates(df, keys).first():
            raise ConstraintViolation(f"duplicate key ({', '.join(keys)}) = {tuple(row)[:-1]}")
    return df
