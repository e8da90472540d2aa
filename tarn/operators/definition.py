"""A table's columns and constraints as one thing, which every change of the table goes by."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.types import sql_type
from tarn.operators import changes
from tarn.operators.constraints import check
from tarn.operators.errors import ColumnExists, NoSuchColumn, TableError, WrongType
from tarn.sources.tables import values


@dataclass(frozen=True)
class ColumnDefinition:
    """kind: a SQL type name. default: a value or expression for rows that don't give one. auto: numbered on from the largest."""

    name: str
    kind: str
    not_null: bool = False
    unique: bool = False
    primary_key: bool = False
    default: object = None
    auto: bool = False


@dataclass(frozen=True)
class TableDefinition:
    """columns in order; primary_key and unique: keys of several columns, beside those that columns declare themselves."""

    columns: Sequence[ColumnDefinition]
    primary_key: Sequence[str] = ()
    unique: Sequence[Sequence[str]] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        names = [c.name.lower() for c in self.columns]
        if len(set(names)) < len(names):
            raise ColumnExists("a column is defined twice")
        if self.primary_key and any(c.primary_key for c in self.columns):
            raise TableError("the primary key is defined twice")
        kinds = {c.name: sql_type(c.kind) for c in self.columns}
        for key in [self.key, *self.uniques]:
            if unknown := [c for c in key if c not in kinds]:
                raise NoSuchColumn(f"no such column: {', '.join(unknown)}")
            if blobs := [c for c in key if isinstance(kinds[c], T.BinaryType)]:
                raise WrongType(f"binary columns can't be keys: {', '.join(blobs)}")
        autos = [c for c in self.columns if c.auto]
        if len(autos) > 1 or any(not isinstance(kinds[c.name], T.IntegralType) for c in autos):
            raise WrongType("one integer column can be numbered")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, sql_type(c.kind)) for c in self.columns])

    @property
    def key(self) -> list[str]:
        return list(self.primary_key) or [c.name for c in self.columns if c.primary_key]

    @property
    def uniques(self) -> list[list[str]]:
        return [*([c.name] for c in self.columns if c.unique), *map(list, self.unique)]

    @property
    def not_null(self) -> list[str]:
        return [c.name for c in self.columns if c.not_null or c.name in self.key]

    def empty(self, spark: SparkSession) -> DataFrame:
        return values(spark, [], self.schema)

    def checked(self, table: DataFrame) -> DataFrame:
        """table itself, or ConstraintViolation."""
        return check(table, self.not_null, self.uniques, self.key)

    def insert(self, table: DataFrame, rows: Sequence[Sequence] | DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """table with rows appended, with defaults and numbers filled in; the outcome as a whole meets the constraints."""
        defaults = {c.name: c.default if isinstance(c.default, Column) else F.lit(c.default) for c in self.columns if c.default is not None}
        auto = next((c.name for c in self.columns if c.auto), None)
        return self.checked(changes.insert(table, rows, columns, defaults, auto))

    def update(self, table: DataFrame, to: Mapping[str, Column], condition: Column | None = None) -> DataFrame:
        """table with columns set where the condition is true; keys are looked at in the outcome, so values can change places."""
        return self.checked(changes.update(table, to, condition))

    def drop_column(self, table: DataFrame, name: str) -> DataFrame:
        return changes.drop_column(table, name, self.key)
