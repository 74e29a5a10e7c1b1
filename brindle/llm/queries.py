"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_tree, chat_format, fingerprints, lm_scoring, near_duplicates, packing, quality_rules, suffix_dedup, token_counts, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixture_packing": packing.op1,
    "op2_token_counts": token_counts.op2,
    "op3_warc_boundary_chain": warc.op3,
    "op4_repeated_passages": suffix_dedup.op4,
    "op5_bpe_tree": bpe_tree.op5,
    "op6_multiset_fingerprints": fingerprints.op6,
    "op7_deleted_interpolation": lm_scoring.op7,
    "op8_chat_format": chat_format.op8,
    "op9_minmax_near_dup": near_duplicates.op9,
    "op10_quality_rules": quality_rules.op10,
}
ORACLE_SQL: dict[str, str] = {"op8_chat_format": chat_format.OP8_SQL, "op10_quality_rules": quality_rules.OP10_SQL}
