"""Exact token counts: a histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.common import text_of
from strandweave.llm.subwords import WordEncoder, chunks, vocabulary_path
from strandweave.session import save_scratch, ship_package

#: Lengths that share one row of the coarse sums.
SPAN = 1024


def encoded_lengths(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(length, n_docs)`` summed per task: how many documents have so many subword ids.

    Whole texts are encoded; null and empty ones have length 0. ``vocabulary`` is the path of a
    ``tokenizers`` file on the workers (the installed public one by default).
    """
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(vocabulary or vocabulary_path())
        held: dict[int, int] = {}
        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                _, starts = encoder.encode(texts)
                lengths, n = np.unique(np.diff(starts), return_counts=True)
                for length, more in zip(lengths.tolist(), n.tolist(), strict=True):
                    held[length] = held.get(length, 0) + more
        yield pa.RecordBatch.from_pydict(
            {"length": pa.array(list(held), pa.int64()), "n_docs": pa.array(list(held.values()), pa.int64())}
        )

    texts = docs.select(text_of(text_col).alias("text"))
    return texts.mapInArrow(count, "length long, n_docs long")


def length_histogram(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(length, n_docs)`` of all documents, one row per length that occurs."""
    per_task = encoded_lengths(docs, text_col, vocabulary)
    return per_task.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """What every context limit gives, from a saved histogram ``(length, n_docs)``.

    One row per length L that occurs: ``n_docs`` of exactly L; ``docs_within`` and ``tokens_within``,
    documents of at most L and their ids; ``docs_over``, longer ones; ``tokens_truncated``, ids left when
    every document is cut at L; ``quantile``, the share of documents of at most L; ``total_tokens``. A
    limit between two rows keeps ``tokens_truncated(L) + (limit - L) * docs_over(L)``.

    Sums over spans of lengths come first, so no task ever orders all lengths of a corpus. An
    empty table gives no row.
    """
    cells = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"))
    cells = cells.withColumn("span", F.expr(f"length div {SPAN}"))
    spans = cells.groupBy("span").agg(F.sum("n_docs").alias("span_docs"), F.sum("tokens").alias("span_tokens"))
    longer = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    spans = spans.select(
        "span",
        F.coalesce(F.sum("span_docs").over(longer), F.lit(0)).alias("docs_beyond"),
        F.coalesce(F.sum("span_tokens").over(longer), F.lit(0)).alias("tokens_beyond"),
        F.sum("span_docs").over(everything).alias("all_docs"),
        F.sum("span_tokens").over(everything).alias("total_tokens"),
    )
    within_span = Window.partitionBy("span").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    rows = cells.join(spans, "span")
    docs_over = F.col("docs_beyond") + F.coalesce(F.sum("n_docs").over(within_span), F.lit(0))
    tokens_over = F.col("tokens_beyond") + F.coalesce(F.sum("tokens").over(within_span), F.lit(0))
    rows = rows.withColumn("docs_over", docs_over).withColumn("tokens_over", tokens_over)
    return rows.select(
        "length",
        "n_docs",
        (F.col("all_docs") - F.col("docs_over")).alias("docs_within"),
        (F.col("total_tokens") - F.col("tokens_over")).alias("tokens_within"),
        "docs_over",
        (F.col("total_tokens") - F.col("tokens_over") + F.col("length") * F.col("docs_over")).alias("tokens_truncated"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"),
        "total_tokens",
    )


def token_counts(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The context table of the documents. Rows equal in all columns count each."""
    return context_table(save_scratch(length_histogram(docs, text_col, vocabulary)))
