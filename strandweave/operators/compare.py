"""Checks of contigs against known sequences and against each other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from strandweave.functions import dna
from strandweave.operators.kmers import extract_kmers
from strandweave.operators.mapping import SHARED_KMERS, in_task
from strandweave.session import save_scratch


def known_kmers(kmers: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows of ``kmers`` whose k-mer is in ``truth``."""
    return kmers.join(truth.select("kmer").distinct(), "kmer", "left_semi")


def unknown_kmers(kmers: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows of ``kmers`` whose k-mer is not in ``truth``."""
    return kmers.join(truth.select("kmer").distinct(), "kmer", "left_anti")


def contained_in(contigs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``(contig_id, text_id)`` for contigs that occur in a text on either strand.

    A contig that occurs in a text shares its first k-mer with it, so candidates come from an
    equi-join on that k-mer and only those are compared base by base. Contigs shorter than k take
    part with all of their bases; an empty one is in every text and is left out.
    """
    width = F.least(F.length("sequence"), F.lit(k)).alias("width")
    sized = contigs.filter(F.length("sequence") > 0).select("contig_id", "sequence", width)
    # No more than k widths.
    widths = sorted(row.width for row in sized.select("width").distinct().collect())
    candidates = None
    for n in widths:
        first = F.substring("sequence", 1, n)
        seeds = sized.filter(F.col("width") == n)
        if n == 1:
            seeds = seeds.select("contig_id", dna.canonical(first).alias("kmer"))
            bases = F.array_distinct(F.split("sequence", ""))
            at = texts.select("text_id", F.explode(F.transform(bases, dna.canonical)).alias("kmer")).distinct()
        else:
            seeds = seeds.select("contig_id", dna.canonical_kmer(first, n).alias("kmer"))
            seeds = save_scratch(seeds)
            at = _seed_windows(texts, seeds.select("kmer").distinct(), n).distinct()
        found = seeds.join(at, "kmer").select("contig_id", "text_id")
        candidates = found if candidates is None else candidates.unionByName(found)
    if candidates is None:
        return contigs.select("contig_id").join(texts.select("text_id").limit(0), F.lit(False))
    whole = candidates.join(contigs.select("contig_id", "sequence"), "contig_id").join(
        texts.select("text_id", F.col("sequence").alias("text")), "text_id"
    )
    found = F.contains("text", F.col("sequence")) | F.contains("text", dna.revcomp(F.col("sequence")))
    return whole.filter(found).select("contig_id", "text_id")


def _seed_windows(texts: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """``(text_id, kmer)`` of the windows that are one of ``seeds(kmer)``.

    Few seeds go to the texts, so that no other window leaves its task; many are joined.
    """
    if seeds.count() <= SHARED_KMERS and isinstance(texts.schema["text_id"].dataType, LongType):
        known = np.sort(seeds.toArrow()["kmer"].to_numpy())
        shared = texts.sparkSession.sparkContext.broadcast((known, known))

        def found(ids: pa.Array, row: np.ndarray, pos: np.ndarray, kmer: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(kmer)], ["text_id", "kmer"])

        named = texts.select(F.col("text_id").alias("read_id"), F.col("sequence").alias("seq"))
        return in_task(named, shared, n, "text_id bigint, kmer bigint", found)
    every = extract_kmers(texts, n, id_col="text_id", seq_col="sequence").select("text_id", "kmer")
    return every.join(seeds, "kmer", "left_semi").select("text_id", "kmer")


def repeated_contigs(contigs: DataFrame, min_length: int = 0) -> DataFrame:
    """``(strand, n)`` for sequences that several contigs share, on either strand."""
    kept = contigs.filter(F.length("sequence") >= min_length)
    counted = kept.groupBy(dna.canonical(F.col("sequence")).alias("strand")).agg(F.count("*").alias("n"))
    return counted.filter("n > 1")
