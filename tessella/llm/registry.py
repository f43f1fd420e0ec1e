"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op01_sharding, op02_jaccard_join, op03_token_ids, op04_decontamination, op05_warc, op06_substring_dedup, op07_exact_dedup, op08_language_id, op09_mixing, op10_suffix_array

MODULES = (op01_sharding, op02_jaccard_join, op03_token_ids, op04_decontamination, op05_warc, op06_substring_dedup, op07_exact_dedup, op08_language_id, op09_mixing, op10_suffix_array)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "SQL", {}).items()}
