"""FASTA, TSV and FASTQ outputs as folders of text files whose parts follow each other in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.sources import block_gzip

# The table's columns and the width of sequence lines.
TSV_COLUMNS = ("contig_id", "length", "raw_count", "rpkm", "tpm", "mean_coverage")
FASTA_WIDTH = 70


def decimal_text(value: Column, digits: int) -> Column:
    """Number rounded half to even, without exponent or superfluous zeros (``15.0``, ``3.14``)."""
    rounded = F.bround(value, digits)
    text = rounded.cast(f"decimal(38,{digits})").cast("string")
    return F.regexp_replace(text, "(\\.[0-9]+?)0+$", "$1")


def fasta_records(contigs: DataFrame, min_length: int = 0, width: int = FASTA_WIDTH) -> DataFrame:
    """``(contig_id, value)`` with the text of each record."""
    header = F.concat(
        F.lit(">contig_"),
        F.col("contig_id").cast("string"),
        F.lit(" length="),
        F.length("sequence").cast("string"),
        F.lit(" coverage="),
        decimal_text(F.col("mean_coverage"), 2),
    )
    wrapped = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    kept = contigs.filter(F.length("sequence") >= min_length)
    return kept.select("contig_id", F.concat(header, F.lit("\n"), wrapped).alias("value"))


def tsv_rows(abundance: DataFrame, min_length: int = 0) -> DataFrame:
    """``(contig_id, value)`` with the text of each row."""
    kept = abundance.filter(F.col("contig_length") >= min_length)
    value = F.concat_ws(
        "\t",
        F.concat(F.lit("contig_"), F.col("contig_id").cast("string")),
        F.col("contig_length").cast("string"),
        F.col("raw_count").cast("string"),
        decimal_text(F.col("rpkm"), 4),
        decimal_text(F.col("tpm"), 4),
        decimal_text(F.col("mean_coverage"), 2),
    )
    return kept.select("contig_id", value.alias("value"))


def write_contigs_fasta(contigs: DataFrame, path: str, min_length: int = 0, width: int = FASTA_WIDTH) -> None:
    records = fasta_records(contigs, min_length, width)
    records.orderBy("contig_id").select("value").write.mode("overwrite").text(path)


def write_abundance_tsv(abundance: DataFrame, path: str, min_length: int = 0) -> None:
    """Rows in order of contigs; the header is the first line of the first part only."""
    header = abundance.sparkSession.createDataFrame([(-1, "\t".join(TSV_COLUMNS))], "contig_id bigint, value string")
    rows = header.unionByName(tsv_rows(abundance, min_length))
    rows.orderBy("contig_id").select("value").write.mode("overwrite").text(path)


def fastq_records(reads: DataFrame) -> DataFrame:
    """``value`` with the text of each record of ``reads(name, seq, qual)``."""
    return reads.select(
        F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")
    )


def write_fastq(reads: DataFrame, path: str, compression: str = "none") -> None:
    """``compression="gzip"`` writes ``.txt.gz`` parts, ``"block_gzip"`` parts that can be read in ranges."""
    if compression == "block_gzip":
        block_gzip.write_lines(fastq_records(reads), path)
        return
    fastq_records(reads).write.mode("overwrite").option("compression", compression).text(path)
