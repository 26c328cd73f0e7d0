"""Operators on ``reads(read_id, seq, ...)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import dna


def drop_no_calls(reads: DataFrame) -> DataFrame:
    """Keep the reads made of ACGT only."""
    return reads.filter(~dna.has_no_call(F.col("seq")))


def encode_reads(reads: DataFrame, drop_with_n: bool = True) -> DataFrame:
    """``(read_id, codes, len)`` with one small integer per base."""
    kept = drop_no_calls(reads) if drop_with_n else reads
    return kept.select(
        "read_id", dna.encode(F.col("seq")).alias("codes"), F.length("seq").alias("len")
    )


def decode_reads(encoded: DataFrame) -> DataFrame:
    return encoded.select("read_id", dna.decode(F.col("codes")).alias("seq"))


def read_stats(reads: DataFrame) -> DataFrame:
    """One row: reads kept, reads dropped for a no-call, bases kept, longest kept read."""
    bad = dna.has_no_call(F.col("seq"))
    kept_len = F.when(~bad, F.length("seq"))
    return reads.agg(
        F.count_if(~bad).alias("n_reads"),
        F.count_if(bad).alias("n_dropped"),
        F.coalesce(F.sum(kept_len), F.lit(0)).cast("bigint").alias("n_bases"),
        F.coalesce(F.max(kept_len), F.lit(0)).alias("max_len"),
    )


def length_histogram(reads: DataFrame) -> DataFrame:
    return reads.groupBy(F.length("seq").alias("len")).agg(F.count("*").alias("n_reads"))
