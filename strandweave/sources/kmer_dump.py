"""K-mer count dumps: one ``kmer<TAB>count`` line per k-mer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import dna


def parse_dump(lines: DataFrame, k: int, column: str = "value") -> DataFrame:
    """``(kmer, cnt)`` of the well-formed lines; others are skipped and equal k-mers added up.

    A count too large for a 64-bit number ends the job with an error.
    """
    fields = F.split(F.col(column), "\t")
    parsed = lines.filter(F.col(column).rlike(f"^[{dna.BASES}]{{{k}}}\t[0-9]+$")).select(
        dna.parse_kmer(fields[0], k).alias("kmer"),
        F.coalesce(
            fields[1].try_cast("bigint"), F.raise_error(F.concat(F.lit("count too large in k-mer dump: "), fields[1]))
        ).alias("cnt"),
    )
    return parsed.groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


def read_dump(spark: SparkSession, path: str, k: int) -> DataFrame:
    return parse_dump(spark.read.text(path), k)


def dump_lines(counts: DataFrame, k: int) -> DataFrame:
    """``(kmer, value)`` where ``value`` is the dump line."""
    return counts.select(
        "kmer", F.concat_ws("\t", dna.unpack(F.col("kmer"), k), F.col("cnt").cast("string")).alias("value")
    )


def write_dump(counts: DataFrame, k: int, path: str) -> None:
    """Dump in order of k-mers as a folder of text files."""
    dump_lines(counts, k).orderBy("kmer").select("value").write.text(path)
