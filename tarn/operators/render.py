"""Results as text for people and as typed JSON cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How many rows a text table shows, and the wording of its last lines.
SHOWN, COUNTED, HIDDEN = 100, "({n} row{s})", "... ({n} rows hidden)"


def text_table(df: DataFrame, shown: int = SHOWN) -> str:
    """A box of the first rows, the number of all rows and that of hidden ones."""
    cells = [[_cell(v) for v in r] for r in df.limit(shown).collect()]
    widths = [max(map(len, [c, *(r[i] for r in cells)])) for i, c in enumerate(df.columns)]
    line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    out = [line, *("|" + "|".join(f" {v:<{w}} " for v, w in zip(r, widths, strict=True)) + "|" for r in [df.columns, *cells]), line]
    out.insert(2, line)
    total = df.count() if len(cells) == shown else len(cells)
    out.append(COUNTED.format(n=total, s="s" * (total != 1)))
    if total > len(cells):
        out.append(HIDDEN.format(n=total - len(cells)))
    return "\n".join(out)


def _cell(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (bytes, bytearray)):
        return f"<{len(value)} bytes: {bytes(value[:8]).hex()}{'..' * (len(value) > 8)}>"
    return str(value)


def json_cells(df: DataFrame) -> DataFrame:
    """Each row as a JSON array of {"type", "value"} cells, made where the rows are."""
    return df.select(F.concat(F.lit("["), F.concat_ws(",", *(_json(f) for f in df.schema.fields)), F.lit("]")).alias("cells"))


def _json(field: T.StructField) -> Column:
    value, kind = F.col(field.name), field.dataType
    name = "int" if isinstance(kind, (T.IntegralType, T.TimestampType)) else "float" if isinstance(kind, T.FractionalType) else "bool" if isinstance(kind, T.BooleanType) else "blob" if isinstance(kind, T.BinaryType) else "text"
    if isinstance(kind, T.TimestampType):
        value = value.cast("long")
    if name == "blob":
        value = F.hex(value)
    return F.when(value.isNull(), F.lit('{"type":"Null"}')).otherwise(F.to_json(F.struct(F.lit(name).alias("type"), value.alias("value"))))
