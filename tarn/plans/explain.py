"""What Spark will do for a DataFrame, as text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan: mode as in DataFrame.explain."""
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def pushed_filters(df: DataFrame) -> list[str]:
    """The filters that reach each file scan."""
    return [line.partition("PushedFilters:")[2].strip() for line in explain(df).splitlines() if "PushedFilters:" in line]


def read_columns(df: DataFrame) -> list[str]:
    """The columns that each file scan reads."""
    return [line.partition("ReadSchema:")[2].strip() for line in explain(df).splitlines() if "ReadSchema:" in line]
