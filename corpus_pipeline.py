"""From raw documents to packed training sequences, five stages of tidewire.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
stage's rows as Parquet in the shared folder and reads them again for the next.
All stages but the last return the columns of documents.

In every stage a null text is an empty one, an empty table gives an empty one,
other columns go with their rows under any name, and texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import decontam, linedup, packing, quality, simhash
from tidewire.llm.storage import stage, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labels of documents in ``docs``.

    Equal texts are judged alike, a score at the threshold is accepted, and without labels of both classes all stay.
    """
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are similar to an earlier one.

    All documents stay, emptied ones too; lines are in order of doc_id (null first) and place, and rows that repeat are one document.
    """
    return linedup.dedupe_lines(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id.

    Repeated rows become one, different texts under one doc_id are told apart, and rows without doc_id stay.
    """
    return simhash.dedupe(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item; rows are judged by their text, so repeated ones go together."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their sequence and place; repeated rows are packed as often as they come."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("decontaminate", decontaminate_stage),
    ("pack", pack_stage),
]

#: Line similarity, SimHash components and packing are not for SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
