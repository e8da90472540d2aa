"""A corpus pipeline of the operators in tarn.llm: what each stage keeps is the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import exact_dedup, mixing, near_dedup, pieces, toxicity
from tarn.llm.common import dropped, saved, table

#: SQL can't express the first stage's classifier, so the stages are tested against brute force.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't find toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.without_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (80 percent or more of their runs of five words in common), the document with the least id."""
    return near_dedup.without_near_copies(docs, least=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as their rates have it: junk goes down to three hundredths of the tokens, clean documents stay.

    The total is set by the clean domain, whose share is what it is now, so no clean text has to go; rates a little
    over 1 count as 1, so the share of junk comes out near three hundredths, not at it (mixing.realised states it).
    """
    labelled = mixing.labels_as_domains(table(spark, sf_dir, "labels"), toxic=False)
    return mixing.mixed(docs, labelled, {"clean": 0.97, "junk": 0.03}, "clean")


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the ids of each text; the text itself can be decoded from them."""
    return pieces.encode(docs, pieces.default_path()).select("doc_id", "lang", "source", "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read back."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return docs
