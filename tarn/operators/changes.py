"""INSERT, UPDATE, DELETE and column changes as DataFrames of the table's next version.

A table is a DataFrame; each change returns the changed one and leaves the old as it was, so a
statement, or several, take effect together when the caller writes or registers the result, and
not at all when the caller drops it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.operators.errors import ColumnExists, ConstraintViolation, NoSuchColumn, WrongArity
from tarn.sources.tables import materialised, values


def insert(table: DataFrame, rows: Sequence[Sequence] | DataFrame, columns: Sequence[str] | None = None, defaults: Mapping[str, Column] | None = None, auto: str | None = None, not_null: Sequence[str] = ()) -> DataFrame:
    """table with rows appended, which give values for `columns` in order.

    Other columns get their default, else null. auto: a column whose missing or null values are numbered
    on from the table's largest and from explicit ones among the rows.
    """
    spark, columns, defaults = table.sparkSession, list(columns or table.columns), defaults or {}
    kinds = {f.name: f.dataType for f in table.schema.fields}
    if len(set(columns)) < len(columns):
        raise ColumnExists("a column is named twice")
    if unknown := [c for c in columns if c not in kinds]:
        raise NoSuchColumn(f"no such column: {', '.join(unknown)}")
    if isinstance(rows, DataFrame):
        if len(rows.columns) != len(columns):
            raise WrongArity(f"each row needs {len(columns)} values")
        given = rows.toDF(*columns)
    else:
        if any(len(r) != len(columns) for r in rows):
            raise WrongArity(f"each row needs {len(columns)} values")
        given = values(spark, rows, T.StructType([T.StructField(c, kinds[c]) for c in columns]))
    full = given.select(*((F.col(c) if c in columns else defaults.get(c, F.lit(None))).cast(k).alias(c) for c, k in kinds.items()))
    if auto:
        full = _numbered(full, auto, table.agg(F.max(auto)).first()[0] or 0)
    if missing := [c for c in not_null if c != auto]:
        found = full.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in missing)).first()
        if broken := [c for c in missing if found[c]]:
            raise ConstraintViolation(f"null in {', '.join(broken)}")
    return table.unionByName(full)


def _numbered(rows: DataFrame, column: str, last: int) -> DataFrame:
    # written once, in their order: rows are read twice, and both readings have to agree
    fixed = materialised(rows.withColumn("_order", F.monotonically_increasing_id()))
    given = fixed.agg(F.max(column)).first()[0]
    made = number(fixed.where(F.col(column).isNull()), column, max(last, given or 0), by=["_order"])
    return made.unionByName(fixed.where(F.col(column).isNotNull())).drop("_order")


def number(df: DataFrame, column: str, last: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """df with `column` set to last + 1, last + 2, ... in the order of `by`.

    Rows are numbered where they stand: partitions are counted, and each starts where the one before it ends.
    """
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df
    fixed = materialised(placed.withColumn("_at", F.monotonically_increasing_id()))
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(tuple(r) for r in fixed.groupBy(part.alias("part")).count().collect())  # a row for each partition
    before, starts = last, {}
    for p, n in counts:
        starts[p], before = before, before + n
    offsets = df.sparkSession.createDataFrame(list(starts.items()), "_part long, _start long")
    kind = df.schema[column].dataType if column in df.columns else T.LongType()
    return fixed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(column, (F.col("_start") + at + 1).cast(kind)).select(*dict.fromkeys([*df.columns, column]))


def update(table: DataFrame, changes: Mapping[str, Column], condition: Column | None = None) -> DataFrame:
    """table with columns set where the condition is true; every right-hand side sees the old row."""
    if unknown := [c for c in changes if c not in table.columns]:
        raise NoSuchColumn(f"no such column: {', '.join(unknown)}")
    hit = F.lit(True) if condition is None else condition
    return table.select(*(F.when(hit, changes[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in changes else F.col(f.name) for f in table.schema.fields))


def delete(table: DataFrame, condition: Column | None = None) -> DataFrame:
    """table without the rows for which the condition is true; those where it is null stay."""
    return table.where(F.lit(False) if condition is None else ~F.coalesce(condition, F.lit(False)))


def affected(table: DataFrame, condition: Column | None = None) -> int:
    """How many rows an update or delete with this condition touches."""
    return (table if condition is None else table.where(condition)).count()


def add_column(table: DataFrame, name: str, kind: T.DataType) -> DataFrame:
    """A new nullable column at the end; rows that are there have null in it."""
    if name.lower() in map(str.lower, table.columns):
        raise ColumnExists(f"column {name} exists")
    return table.withColumn(name, F.lit(None).cast(kind))


def drop_column(table: DataFrame, name: str, primary_key: Sequence[str] = ()) -> DataFrame:
    if name.lower() not in map(str.lower, table.columns):
        raise NoSuchColumn(f"no such column: {name}")
    if name.lower() in map(str.lower, primary_key):
        raise ConstraintViolation(f"{name} is part of the primary key")
    return table.drop(name)


def rename_column(table: DataFrame, old: str, new: str) -> DataFrame:
    if old.lower() not in map(str.lower, table.columns):
        raise NoSuchColumn(f"no such column: {old}")
    if new.lower() in (c.lower() for c in table.columns if c.lower() != old.lower()):
        raise ColumnExists(f"column {new} exists")
    return table.withColumnRenamed(old, new)


def describe(table: DataFrame) -> DataFrame:
    """Column, type and nullability, a row for each."""
    return values(table.sparkSession, [(f.name, f.dataType.simpleString(), f.nullable) for f in table.schema.fields], "column_name string, data_type string, nullable boolean")
