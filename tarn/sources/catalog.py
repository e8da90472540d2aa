"""Tables by name, in Spark's own catalog: registered DataFrames (temporary views) and stored tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.operators.errors import NoSuchTable, TableExists


def list_tables(spark: SparkSession) -> list[str]:
    """Names in order."""
    return sorted({t.name for t in spark.catalog.listTables()})


def _temporary(spark: SparkSession, name: str) -> bool:
    return any(t.isTemporary and t.name.lower() == name.lower() for t in spark.catalog.listTables())


def register(table: DataFrame, name: str) -> None:
    """Give a DataFrame a name for this session."""
    if table.sparkSession.catalog.tableExists(name):
        raise TableExists(f"table {name} exists")
    table.createTempView(name)


def drop_table(spark: SparkSession, name: str, if_exists: bool = False) -> bool:
    """Whether there was one to drop."""
    if not spark.catalog.tableExists(name):
        if if_exists:
            return False
        raise NoSuchTable(f"no such table: {name}")
    if _temporary(spark, name):
        spark.catalog.dropTempView(name)
    else:
        spark.sql("DROP TABLE IDENTIFIER(:name)", {"name": name})
    return True


def rename_table(spark: SparkSession, old: str, new: str) -> None:
    if not spark.catalog.tableExists(old):
        raise NoSuchTable(f"no such table: {old}")
    if spark.catalog.tableExists(new):
        raise TableExists(f"table {new} exists")
    if _temporary(spark, old):
        spark.table(old).createTempView(new)
        spark.catalog.dropTempView(old)
    else:
        spark.sql(f"ALTER TABLE `{old}` RENAME TO `{new}`")
