"""Tables as DataFrames: Parquet folders, literal rows, and a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table. Filters and column choices made on it later reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """A literal VALUES list with a declared schema."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def one_row(spark: SparkSession) -> DataFrame:
    """What SELECT without FROM reads."""
    return spark.range(1).select()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of this machine's, in local mode alone."""
    context = spark.sparkContext
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tarn-"))
    return context._jsc.sc().getCheckpointDir().get()


def materialised(df: DataFrame) -> DataFrame:
    """df written out once as Parquet and read back, so that what follows sees fixed rows and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
