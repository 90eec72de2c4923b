"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, exact_dedup, fill_in_middle, jaccard_join, line_dedup, mixing, packing, pii, prefix_trie, quality, sharding, substring_dedup, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_pii": pii.op2_pii,
    "op3_url_filters": url_filters.op3_url_filters,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_minimax_sharding": sharding.op6_minimax_sharding,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_benchmark_decontamination": decontamination.op10_benchmark_decontamination,
    "op11_mixing": mixing.op11_mixing,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op3_url_filters": url_filters.OP3_SQL,
    "op5_jaccard_join": jaccard_join.OP5_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op10_benchmark_decontamination": decontamination.OP10_SQL,
    "op11_mixing": mixing.OP11_SQL,
    "op12_fill_in_middle": fill_in_middle.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
