"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES = {
    "op1_topk_search": "search",
    "op2_language_id": "language",
    "op3_html_extraction": "html",
    "op4_ngram_jaccard": "jaccard",
    "op5_quality_rules": "quality",
    "op6_byte_bpe": "bpe",
    "op7_token_counts": "tokencount",
    "op8_suffix_dedup": "suffixes",
    "op9_toxicity": "toxicity",
    "op10_source_mixing": "mixing",
    "op11_weighted_shards": "sharding",
    "op12_spelling_variants": "spelling",
    "op13_periodic_runs": "periodic",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL can express exact search; the other queries are tested against brute force instead."""
    from .search import OP1_SQL

    return {"op1_topk_search": OP1_SQL}
