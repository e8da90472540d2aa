"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.llm.chat import OP5_SQL, op5_chat_format
from tarn.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from tarn.llm.lm import op8_lm_scores
from tarn.llm.mixing import op10_mixing
from tarn.llm.near_dedup import OP3_SQL, op3_near_dedup
from tarn.llm.pieces import op2_sentencepiece
from tarn.llm.quality import op1_quality_rules
from tarn.llm.token_files import op9_token_ids
from tarn.llm.toxicity import op4_toxicity
from tarn.llm.warc import OP7_SQL, op7_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_near_dedup": op3_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_chat_format": op5_chat_format,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_warc": op7_warc,
    "op8_lm_scores": op8_lm_scores,
    "op9_token_ids": op9_token_ids,
    "op10_mixing": op10_mixing,
}
SQL: dict[str, str] = {
    "op3_near_dedup": OP3_SQL,
    "op5_chat_format": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op7_warc": OP7_SQL,
}
