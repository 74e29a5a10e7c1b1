"""From documents to packed sequences: quality rules, near-duplicates, repeated passages, packing.

Defined results. Null, empty and short texts fail the quality rules and go. Repeated rows, and rows of a null doc_id with
near texts, leave one of them; other texts under one doc_id stay. Ties: the smallest doc_id stays, a null one last. Documents of
which the repeats stage leaves nothing stay, as an end token. Very long texts pass whole through all stages. Columns
besides doc_id, text, source and n_chars pass through under any names until packing, which gives its own. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import stored
from brindle.llm.near_duplicates import drop_near_duplicates
from brindle.llm.packing import pack_documents
from brindle.llm.quality_rules import filter_documents
from brindle.llm.suffix_dedup import drop_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules."""
    return filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of 5-word shingles are linked by a similarity of 0.8 or more."""
    return drop_near_duplicates(docs, width=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages of 200 bytes or more that occur elsewhere too."""
    return drop_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, sources mixed in every sequence by what they hold."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Shingle similarity through hash bands and the tokenizer's ids have no SQL form: tests compare with brute force.
ORACLE_SQL = None
