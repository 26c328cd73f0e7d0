"""Paired reads simulated from random transcripts, with the truth they come from."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import dna


@dataclass
class Truth:
    transcripts: list[str]
    coverages: tuple[int, ...]
    n_pairs: int
    read_len: int

    @property
    def n_reads(self) -> int:
        return 2 * self.n_pairs


def _uniform(seed: int, *parts: Column | str) -> Column:
    """Number in (0, 1) that depends on the seed and the parts only, not on partitioning."""
    steps = 1 << 52
    cell = F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(steps))
    return (cell + F.lit(0.5)) / F.lit(float(steps))


def _with_errors(seq: Column, rate: float, seed: int, mate: int) -> Column:
    """Replace bases by another one at the given rate."""

    def base(letter: Column, at: Column) -> Column:
        other = F.floor(_uniform(seed, F.lit(mate), "pair", at, F.lit("other")) * 3) + 1
        digit = F.instr(F.lit(dna.BASES), letter) - 1
        swapped = F.substring(F.lit(dna.BASES), ((digit + other) % 4 + 1).cast("int"), F.lit(1))
        return F.when(_uniform(seed, F.lit(mate), "pair", at, F.lit("hit")) < rate, swapped).otherwise(letter)

    letters = F.filter(F.split(seq, ""), lambda x: x != "")
    return F.array_join(F.transform(letters, base), "")


def simulate_pairs(
    spark: SparkSession,
    seed: int = 42,
    transcript_len: int = 500,
    coverages: tuple[int, ...] = (10, 50, 200),
    read_len: int = 151,
    insert_mean: int = 300,
    insert_sd: int = 50,
    error_rate: float = 0.01,
) -> tuple[DataFrame, DataFrame, Truth]:
    """``(mate 1, mate 2, truth)``; a mate table is ``(name, seq, qual)`` in shuffled order.

    Inserts are normally distributed and kept between two read lengths and the transcript. Mate 2
    is the reverse complement of the insert's far end.
    """
    if transcript_len < 2 * read_len:
        raise ValueError("a transcript must be at least two reads long")
    rng = random.Random(seed)
    transcripts = ["".join(rng.choices(dna.BASES, k=transcript_len)) for _ in coverages]
    per_transcript = [-(-transcript_len * cov // (2 * read_len)) for cov in coverages]
    total = sum(per_transcript)

    number, below = F.lit(len(coverages)), total
    for i in range(len(coverages) - 1, 0, -1):
        below -= per_transcript[i]
        number = F.when(F.col("pair") < below, F.lit(i)).otherwise(number)
    texts = F.array(*[F.lit(t) for t in transcripts])
    normal = F.sqrt(-2 * F.log(_uniform(seed, "pair", F.lit("r")))) * F.cos(
        F.lit(6.283185307179586) * _uniform(seed, "pair", F.lit("angle"))
    )
    insert = F.round(insert_mean + insert_sd * normal).cast("int")
    insert = F.least(F.greatest(insert, F.lit(2 * read_len)), F.lit(transcript_len))
    pairs = (
        spark.range(total)
        .select(F.col("id").alias("pair"))
        .withColumns({"tx": number, "insert": insert})
        .withColumn("text", F.element_at(texts, F.col("tx")))
    )
    room = F.lit(transcript_len) - F.col("insert") + 1
    pairs = pairs.withColumn("start", F.floor(_uniform(seed, "pair", F.lit("start")) * room).cast("int") + 1)
    near = F.substring("text", F.col("start"), F.lit(read_len))
    far = dna.revcomp(F.substring("text", F.col("start") + F.col("insert") - read_len, F.lit(read_len)))

    def mate(number: int, seq: Column) -> DataFrame:
        name = F.format_string(f"read_%d_tx%d/{number}", F.col("pair") + 1, F.col("tx"))
        return pairs.select(
            name.alias("name"),
            _with_errors(seq, error_rate, seed, number).alias("seq"),
            F.lit("I" * read_len).alias("qual"),
            _uniform(seed, "pair", F.lit("order")).alias("order"),
        ).orderBy("order").drop("order")

    truth = Truth(transcripts, tuple(coverages), total, read_len)
    return mate(1, near), mate(2, far), truth
