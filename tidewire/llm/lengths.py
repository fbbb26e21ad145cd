"""Token counts: the exact histogram of encoded lengths and its suffix sums.

Documents are aggregated by encoded length; for each length that occurs the
table then says how many documents and tokens are at least as long.  That answers
totals, quantiles and the tokens left by truncating at any limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .packing import _tokenizer_path, _word_ids
from .storage import stage, table
from .textnum import slices, tidy

#: Lengths that one partition of the suffix sums holds.
SPREAD = 1024


def _counter(path: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _word_ids(path).counts
        for batch in batches:
            for at, to in slices(batch.column(1)):
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(part.column(1)), pa.int64())], ["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of each row, repeated and null ids too; null and empty texts have 0, other columns are ignored."""
    return docs.select("doc_id", "text").mapInArrow(_counter(path or _tokenizer_path()), "doc_id long, n_tokens long")


def histogram(counts: DataFrame) -> DataFrame:
    """A row for each length in ``counts`` (n_tokens): everything a limit or quantile needs.

    docs_from and tokens_from are over documents of at least this length;
    truncated_total are the tokens that remain if every document is cut to it;
    quantile is the share of documents no longer than it.  An empty table gives
    no rows.
    """
    # staged, as it is read twice and texts should be encoded once
    h = stage(counts.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs")), "lengths")
    h = h.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / SPREAD))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # blocks: one row for SPREAD lengths, so as many as the longest text allows
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = blocks.select(
        F.col("block").alias("b"),
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("d").over(everything).alias("total_docs"), F.sum("t").over(everything).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.join(blocks, h["block"] == blocks["b"])
    h = h.withColumn("docs_from", F.col("d_above") + F.sum("n_docs").over(inside)).withColumn("tokens_from", F.col("t_above") + F.sum("tokens").over(inside))
    return h.select(
        "length", "n_docs", "tokens", "docs_from", "tokens_from", "total_docs", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_total"),
        ((F.col("total_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
    )


def truncated_total(hist: DataFrame, limit: int) -> int:
    """Tokens left if each document is cut to ``limit``, from the one row that decides it."""
    row = hist.filter(F.col("length") >= limit).orderBy("length").first()
    if row is None:
        last = hist.orderBy("length").first()
        return last.total_tokens if last else 0
    return row.total_tokens - row.tokens_from + limit * row.docs_from


def length_at(hist: DataFrame, share: float) -> int | None:
    """The smallest length that at least ``share`` of the documents do not exceed."""
    row = hist.filter(F.col("quantile") >= share).orderBy("length").first()
    return row.length if row else None


def op5_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(token_counts(table(spark, sf_dir, "documents")))
