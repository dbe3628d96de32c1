"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recollex.llm import ann, mixing, neardup, quality, urls
from recollex.llm.ann import op4_nearest
from recollex.llm.bpe import op1_bpe
from recollex.llm.mixing import op2_mixing
from recollex.llm.neardup import op6_near_duplicates
from recollex.llm.pii import op9_pii
from recollex.llm.quality import op8_quality
from recollex.llm.spans import op10_substring_dedup
from recollex.llm.tokencount import op5_token_counts
from recollex.llm.toxicity import op7_toxicity
from recollex.llm.urls import op3_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_url_filter": op3_url_filter,
    "op4_nearest": op4_nearest,
    "op5_token_counts": op5_token_counts,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_pii": op9_pii,
    "op10_substring_dedup": op10_substring_dedup,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.SQL, "op3_url_filter": urls.sql(), "op4_nearest": ann.SQL, "op6_near_duplicates": neardup.SQL, "op8_quality": quality.sql()}
