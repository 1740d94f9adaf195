"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from amberline.llm.byte_pairs import op10_byte_pairs
from amberline.llm.chat import op6_chat_format
from amberline.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from amberline.llm.jpeg import op1_jpeg
from amberline.llm.language_id import op8_language_id
from amberline.llm.mixing import OP2_SQL, op2_mixing
from amberline.llm.ngram_join import op3_ngram_jaccard
from amberline.llm.quality import op5_quality
from amberline.llm.secrets import op9_secrets
from amberline.llm.token_counts import op4_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jpeg": op1_jpeg,
    "op2_mixing": op2_mixing,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_token_counts": op4_token_counts,
    "op5_quality": op5_quality,
    "op6_chat_format": op6_chat_format,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language_id": op8_language_id,
    "op9_secrets": op9_secrets,
    "op10_byte_pairs": op10_byte_pairs,
}

ORACLE_SQL: dict[str, str] = {"op2_mixing": OP2_SQL, "op7_exact_dedup": OP7_SQL}
