"""The corpus pipeline: stages over documents, each written and read again by its successor.

Stages take documents with any further columns and return the same columns, the last one
apart. Null ids and texts, blank texts, repeated rows, ties and empty tables have
the results that each stage states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratolab.llm import bpe, decontaminate, line_dedup, near_copies, quality
from stratolab.llm.common import stored, table
from stratolab.llm.queries import vocabulary_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    Every row is scored by its text alone: null is as empty, and repeated rows share their
    fate. Without any label all score one half and stay.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without chunks of lines that an earlier document still holds whole.

    Order is that of ids, null before all, and of a hash of the text among equal ids. Null texts stay
    null; repeated rows are one document and stay alike; a text all of whose lines go is empty.
    """
    return line_dedup.deduped(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, Jaccard similarity 0.8 or more.

    The smallest id stays, of texts with that id the one with the smaller hash. Null, empty and blank texts are
    one group. Repeated rows leave one. Rows without an id stay only where no row of their group has one.
    """
    return near_copies.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window.

    Null and empty texts have no window and stay, as do all rows where the benchmark is
    empty; repeated rows share their fate.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row doc_id, n_tokens, ids_sha256, decoded_sha256; null is as empty, null ids stay null."""
    return bpe.report(docs, vocabulary_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", token_stage),
]

ORACLE_SQL = None  # a learned classifier and a merge list are beyond SQL; tests hold stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
