"""Mapping of reads that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandweave.functions import dna
from strandweave.operators.mapping import ReadMapper, assign_in_task
from strandweave.operators.reads import drop_no_calls

# Rows of the count table that are not contigs.
UNMAPPED = 0
DROPPED = -1

#: Largest index that running_counts sends to every executor.
BROADCAST_KMERS = 16_000_000


def _batch_counts(batch: DataFrame, mapper: ReadMapper) -> DataFrame:
    """``(contig_id, n)`` of a micro-batch, reads with a no-call as ``DROPPED``.

    One pass: such a read goes through the mapper without its bases, with a mark in place of its id.
    """
    bad = dna.has_no_call(F.col("seq"))
    marked = batch.filter(F.col("seq").isNotNull()).select(
        bad.cast("bigint").alias("read_id"), F.when(bad, "").otherwise(F.col("seq")).alias("seq")
    )
    contig = F.when(F.col("read_id") == 1, F.lit(DROPPED).cast("bigint")).otherwise(F.col("contig_id"))
    found = mapper.assign(marked, drop_with_n=False)
    return found.groupBy(contig.alias("contig_id")).agg(F.count("*").alias("n"))


def count_stream(
    reads: DataFrame, mapper: ReadMapper, out_path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Map each micro-batch and keep its counts per contig under ``out_path``.

    A batch writes its own folder and overwrites it when it is run again after a failure, so
    every read counts once. ``trigger`` is passed on, e.g. ``availableNow=True``.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        # The row of dropped reads is there even if none was.
        none = batch.sparkSession.createDataFrame([(DROPPED, 0)], "contig_id bigint, n bigint")
        _batch_counts(batch, mapper).unionByName(none).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    writer = reads.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def stream_totals(spark: SparkSession, out_path: str) -> DataFrame:
    """``(contig_id, n)`` over all batches so far."""
    table = spark.read.schema("contig_id bigint, n bigint, batch bigint").parquet(out_path)
    return table.groupBy("contig_id").agg(F.sum("n").alias("n"))


def stream_raw_counts(totals: DataFrame) -> DataFrame:
    """``(contig_id, raw_count)`` of the contigs that got a read."""
    return totals.filter(F.col("contig_id") > 0).select("contig_id", F.col("n").alias("raw_count"))


def stream_summary(totals: DataFrame) -> DataFrame:
    """One row ``(n_reads, n_dropped, n_mapped)``."""

    def total(condition) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")

    contig = F.col("contig_id")
    return totals.agg(
        total(contig >= UNMAPPED).alias("n_reads"),
        total(contig == DROPPED).alias("n_dropped"),
        total(contig > UNMAPPED).alias("n_mapped"),
    )


def keep_totals(
    reads: DataFrame, mapper: ReadMapper, out_path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Keep the counts of all reads so far, with a contig index of any size.

    Each micro-batch adds its counts to the version the batch before it wrote and writes a version of its
    own: ``(contig_id, n, changed)``, ``changed`` telling the contigs this batch added to. A batch that is run again
    after a failure starts from the same version and overwrites its own, so every read counts once.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        both = _batch_counts(batch, mapper).withColumn("changed", F.lit(True))
        if batch_id:
            before = _version(batch.sparkSession, out_path, batch_id - 1)
            both = both.unionByName(before.withColumn("changed", F.lit(False)))
        summed = both.groupBy("contig_id").agg(F.sum("n").alias("n"), F.max("changed").alias("changed"))
        summed.write.mode("overwrite").parquet(f"{out_path}/version={batch_id}")

    writer = reads.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def _version(spark: SparkSession, out_path: str, version: int) -> DataFrame:
    path = f"{out_path}/version={version}"
    return spark.read.schema("contig_id bigint, n bigint, changed boolean").parquet(path).select("contig_id", "n")


def updates(spark: SparkSession, out_path: str) -> DataFrame:
    """``(version, contig_id, n)``: what update mode would have emitted, the new count of each contig a batch added to."""
    schema = "contig_id bigint, n bigint, changed boolean, version bigint"
    return spark.read.schema(schema).parquet(out_path).filter("changed").select("version", "contig_id", "n")


def complete(spark: SparkSession, out_path: str) -> DataFrame:
    """``(contig_id, n)`` of the last version, as complete mode would have emitted it."""
    last = updates(spark, out_path).groupBy("contig_id").agg(F.max_by("n", "version").alias("n"))
    return last.select("contig_id", "n")


def running_counts(reads: DataFrame, mapper: ReadMapper) -> DataFrame:
    """Streaming ``(contig_id, raw_count)`` for complete or update mode of Spark's own.

    Needs an index small enough to broadcast, as a stream allows no second grouping by read; ``keep_totals``
    takes any index.
    """
    shared = mapper.shared or mapper.share(BROADCAST_KMERS)
    if shared is None:
        raise ValueError("the contig index is too large to broadcast; use keep_totals")
    assigned = assign_in_task(drop_no_calls(reads), shared, mapper.k, mapper.min_hits)
    mapped = assigned.filter(F.col("contig_id") > 0)
    return mapped.groupBy("contig_id").agg(F.count("*").alias("raw_count"))
