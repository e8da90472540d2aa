"""Column types by their SQL names, and casts between them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.operators.errors import WrongType

#: The accepted type names and what they mean here.
SQL_TYPES: dict[str, T.DataType] = {
    "INT": T.IntegerType(),
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "REAL": T.DoubleType(),
    "FLOAT": T.DoubleType(),
    "DOUBLE": T.DoubleType(),
    "VARCHAR": T.StringType(),
    "TEXT": T.StringType(),
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
    "BLOB": T.BinaryType(),
    "BYTES": T.BinaryType(),
    "BYTEA": T.BinaryType(),
}


def sql_type(name: str) -> T.DataType:
    """The Spark type of a SQL type name; a length in brackets is accepted and has no effect."""
    found = SQL_TYPES.get(re.sub(r"\s*\(.*\)$", "", name.strip()).upper())
    if found is None:
        raise WrongType(f"no such type: {name}")
    return found


def cast(value: Column, to: str) -> Column:
    """CAST under ANSI rules: null stays null, a text that doesn't parse is an error.

    Text becomes true or false from those two words only, in any case, blanks around them aside.
    """
    kind = sql_type(to)
    if isinstance(kind, T.BinaryType):
        raise WrongType("BLOB values can't be cast")
    if isinstance(kind, T.BooleanType):
        return F.when(F.typeof(value) == "string", text_to_boolean(value.cast("string"))).otherwise(value.cast(kind))
    return value.cast(kind)


def text_to_boolean(value: Column) -> Column:
    word = F.lower(F.trim(value))
    return F.when(word == "true", F.lit(True)).when(word == "false", F.lit(False)).when(word.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), value)).cast("boolean"))
