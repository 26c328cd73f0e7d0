"""K-mer extraction and counting."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import dna, kernels
from strandweave.operators import kmer_chains, super_kmers
from strandweave.session import drop_scratch, save_scratch


def extract_kmers(reads: DataFrame, k: int = 31, id_col: str | None = "read_id", seq_col: str = "seq") -> DataFrame:
    """Canonical packed k-mer of every window without a no-call.

    ``(id_col, pos, kmer)`` with a 1-based position, or just ``kmer`` when ``id_col`` is None.
    The windows are built per Arrow batch, so text leaves the JVM once per read and no string
    k-mer is ever made.
    """
    dna.check_k(k)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernels.text_bytes(batch.column(batch.num_columns - 1))
            for lo, hi in kernels.slices(offsets):
                base = offsets[lo]
                row, pos, kmer = kernels.canonical_windows(
                    data[base : offsets[hi]], offsets[lo : hi + 1] - base, k
                )
                if id_col is None:
                    yield pa.RecordBatch.from_arrays([pa.array(kmer)], ["kmer"])
                else:
                    ids = batch.column(0).take(pa.array(row + lo))
                    at = pa.array((pos + 1).astype("int32"))
                    yield pa.RecordBatch.from_arrays([ids, at, pa.array(kmer)], [id_col, "pos", "kmer"])

    seq = F.coalesce(F.col(seq_col), F.lit("")).alias("seq")
    if id_col is None:
        return reads.select(seq).mapInArrow(windows, "kmer bigint")
    id_type = reads.schema[id_col].dataType.simpleString()
    return reads.select(id_col, seq).mapInArrow(windows, f"{id_col} {id_type}, pos int, kmer bigint")


def count_kmers(kmers: DataFrame, min_count: int = 2, max_count: int | None = None) -> DataFrame:
    """``(kmer, cnt)`` of the k-mers seen at least ``min_count`` times.

    Counts are combined on the map side, so a k-mer that fills a third of the input still
    reaches its reducer as one row per task. ``max_count`` caps the reported count.
    """
    counted = kmers.groupBy("kmer").agg(F.count("*").alias("cnt"))
    return _finish(counted, min_count, max_count)


def merge_counts(*parts: DataFrame, min_count: int = 1, max_count: int | None = None) -> DataFrame:
    """Add up ``(kmer, cnt)`` tables counted separately.

    Tables of :func:`count_reads` that hold all counts of one ``k`` are merged bucket by bucket, where each of
    them is counted, so that a k-mer is a row only with its total. Other tables are grouped by k-mer.
    """
    sources = [getattr(part, "_counted_runs", None) for part in parts]
    if all(sources) and len({k for _, k in sources}) == 1:
        runs = [part.select("grp", "bucket", "n_bases", "sizes", "bases", "times", F.lit(i).alias("part")) for i, (part, _) in enumerate(sources)]
        union = runs[0]
        for part in runs[1:]:
            union = union.unionByName(part)
        return _finish(super_kmers.count_runs(union, sources[0][1], min_count), 1, max_count)
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return _finish(union.groupBy("kmer").agg(F.sum("cnt").alias("cnt")), min_count, max_count)


def _finish(counted: DataFrame, min_count: int, max_count: int | None) -> DataFrame:
    kept = counted.filter(F.col("cnt") >= min_count) if min_count > 1 else counted
    if max_count is None:
        return kept
    return kept.withColumn("cnt", F.least("cnt", F.lit(max_count).cast("bigint")))


def count_reads(reads: DataFrame, k: int = 31, min_count: int = 2, max_count: int | None = None) -> DataFrame:
    """K-mer counts straight from reads; windows with a no-call are left out.

    Reads travel as packed runs of windows, see :mod:`strandweave.operators.super_kmers`, and a k-mer becomes a row
    once it is counted. K-mers of a short ``k`` are counted where the reads are.
    """
    if k <= super_kmers.DENSE_K:
        return _finish(super_kmers.count_dense(reads, k, min_count), 1, max_count)
    runs = save_scratch(super_kmers.cut_runs(reads, k))
    counts = _finish(super_kmers.count_runs(runs, k, min_count), 1, max_count)
    if min_count <= 1 and max_count is None:
        # Where merge_counts finds what was counted.
        counts._counted_runs = (runs, k)
    return counts


def saved_counts(reads: DataFrame, k: int = 31, min_count: int = 2, max_count: int | None = None) -> DataFrame:
    """The table of :func:`count_reads` saved as chains of k-mers, without the runs it was counted from."""
    runs = save_scratch(super_kmers.cut_runs(reads, k))
    if max_count is None:
        counts = super_kmers.count_chained(runs, k, min_count)
    else:
        counts = kmer_chains.chained(_finish(super_kmers.count_runs(runs, k, min_count), 1, max_count), k)
    counts = save_scratch(counts)
    drop_scratch(runs)
    return kmer_chains.unchained(counts, k)


def save_chained(counts: DataFrame, k: int) -> DataFrame:
    """``(kmer, cnt)`` saved as chains of k-mers."""
    return kmer_chains.unchained(save_scratch(kmer_chains.chained(counts, k)), k)


def warn_if_capped(counts: DataFrame, max_count: int) -> bool:
    """Warn when a count reached the cap, as coverage is then understated."""
    top = counts.agg(F.max("cnt")).first()[0]
    if top is not None and top >= max_count:
        warnings.warn(f"some k-mer counts reached max_count={max_count}", stacklevel=2)
        return True
    return False


def spectrum(counts: DataFrame) -> DataFrame:
    """How many k-mers have each count."""
    return counts.groupBy("cnt").agg(F.count("*").alias("n_kmers"))


def top_kmers(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.desc("cnt"), F.asc("kmer")).limit(n)
