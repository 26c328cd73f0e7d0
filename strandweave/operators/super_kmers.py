"""K-mers that travel as super-k-mers: runs of windows that share a minimizer, two bits a base.

Windows next to each other mostly share their smallest m-mer, so a run of them is one piece of sequence
that is hardly longer than one window. Reads are cut into such runs, the runs of a bucket (a hash of the
minimizer) are packed into one value for each few megabytes of reads, and only these values are shuffled.
Both strands of a k-mer have the same minimizer, so all its occurrences meet in one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import dna, kernels
from strandweave.functions.batches import byte_planes, joined, joined_planes, tables_of, whole_groups
from strandweave.operators import kmer_chains
from strandweave.session import save_scratch

#: Buckets of minimizers. More of them only make the packed values smaller.
BUCKETS = 1024
#: A bucket of more bases than this is dealt over several tasks.
HOT_BASES = 32_000_000
#: Bases a task unpacks, about.
TASK_BASES = 256_000_000
#: Bytes of reads cut into runs at one time.
READ_BYTES = 4 << 20
#: Windows counted and chained at one time, as that takes many times their space.
CHAIN_WINDOWS = 2_000_000
#: Up to this k a task counts in an array of 4^k places.
DENSE_K = 8

_RUNS = "grp long, bucket int, n_bases long, sizes binary, bases binary, times binary, owners binary, starts binary"


minimizer_length = kmer_chains.minimizer_length


def cut_runs(
    reads: DataFrame, k: int, id_col: str | None = None, seq_col: str = "seq", buckets: int = BUCKETS, grouped: bool = False
) -> DataFrame:
    """``(grp, bucket, n_bases, sizes, bases, times, owners, starts)``: the packed runs of a bucket in some of the reads.

    Without ``id_col`` equal runs of these reads travel once, with the ``times`` they occur. With ``id_col`` (a number) ``owners`` and ``starts`` say for each run whose it is and where in it the run begins,
    from 0. If ``grouped``, owners are places in a list of ids that the group (``grp``) gives in a row of its
    own, with bucket -1; save the result then, as group numbers hold for one run of the job only.
    """
    dna.check_k(k)
    m = minimizer_length(k)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        n_groups = 0
        for table in tables_of(batches, READ_BYTES):
            column = table.column(table.num_columns - 1).combine_chunks()
            ids = table.column(0).to_numpy() if id_col else None
            data, offsets = kernels.text_bytes(column)
            for lo, hi in kernels.slices(offsets):
                codes, row, first, size, own = kernels.runs_by_slices(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k, m)
                bucket = ((own >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, row, first, size = bucket[order], row[order], first[order], size[order]
                packed, ends = kernels.pack_runs(codes, first, size)
                times = None
                if ids is None:
                    packed, ends, size, bucket, times = kernels.distinct_runs(packed, ends, size, bucket)
                edges = np.flatnonzero(np.diff(bucket, prepend=-1))
                stops = np.append(edges[1:], len(bucket))[: len(edges)]
                whole = base + n_groups
                n_groups += 1
                rows: dict[str, list] = {name: [] for name in _ARROW_RUNS.names}
                owners = starts = None
                if ids is not None:
                    starts = first - (offsets[row + lo] - offsets[lo])
                    owners = row if grouped else ids[row + lo]
                # A run is unpacked for every three times.
                unpacked = size if times is None else size * -(-times // ((1 << kernels.WEIGHT_BITS) - 1))
                for a, b in zip(edges.tolist(), stops.tolist(), strict=True):
                    rows["grp"].append(whole)
                    rows["bucket"].append(int(bucket[a]))
                    rows["n_bases"].append(int(unpacked[a:b].sum()))
                    rows["sizes"].append(byte_planes(size[a:b], "<u4"))
                    rows["bases"].append(packed[int(ends[a - 1]) if a else 0 : int(ends[b - 1])].tobytes())
                    rows["times"].append(None if times is None else byte_planes(times[a:b], "<u4"))
                    rows["owners"].append(None if owners is None else owners[a:b].astype("<i8").tobytes())
                    rows["starts"].append(None if owners is None else starts[a:b].astype("<u4").tobytes())
                if grouped:
                    for name, value in zip(rows, (whole, -1, 0, None, None, None, ids[lo:hi].astype("<i8").tobytes(), None), strict=True):
                        rows[name].append(value)
                yield pa.RecordBatch.from_pydict(rows, schema=_ARROW_RUNS)

    seq = F.coalesce(F.col(seq_col), F.lit("")).alias("seq")
    chosen = reads.select(seq) if id_col is None else reads.select(F.col(id_col).cast("long").alias("id"), seq)
    return chosen.mapInArrow(cut, _RUNS)


_ARROW_RUNS = pa.schema(
    [("grp", pa.int64()), ("bucket", pa.int32()), ("n_bases", pa.int64())]
    + [(name, pa.binary()) for name in ("sizes", "bases", "times", "owners", "starts")]
)


def dealt(runs: DataFrame, buckets: int = BUCKETS, hot_bases: int = HOT_BASES) -> tuple[DataFrame, DataFrame, int]:
    """Saved runs with ``place``: their bucket, or one of several places for a bucket of very many bases.

    Also ``(bucket, n_places)`` of those buckets, and into how many tasks the places should go.
    """
    sizes = save_scratch(runs.groupBy("bucket").agg(F.sum("n_bases").alias("n_bases")))
    total = sizes.agg(F.coalesce(F.sum("n_bases"), F.lit(0))).first()[0]
    usual = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_places = F.ceil(F.col("n_bases") / hot_bases).cast("long")
    # One row a bucket at most.
    hot = F.broadcast(sizes.filter(F.col("n_bases") > hot_bases).select("bucket", n_places.alias("n_places")))
    turn = F.pmod(F.xxhash64("grp", "bases"), F.coalesce("n_places", F.lit(1)))
    placed = runs.join(hot, "bucket", "left").withColumn("place", turn * buckets + F.col("bucket"))
    return placed, hot, max(-(-total // TASK_BASES), usual)


def count_runs(runs: DataFrame, k: int, min_count: int = 1, buckets: int = BUCKETS, hot_bases: int = HOT_BASES) -> DataFrame:
    """``(kmer, cnt)`` of the windows of saved runs, of k-mers that occur at least ``min_count`` times.

    A bucket is counted where it arrives, so a k-mer is a row only once it is counted. Only the k-mers of
    buckets dealt over several tasks are shuffled again, as partial counts. Runs with a ``part`` are counted
    part by part, and a bucket's counts of all parts merged there.
    """
    together, hot = _at_places(runs, buckets, hot_bases)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, found in _counts_at_places(batches, k, min_count):
            for kmer, cnt in found:
                flags = pa.array(np.full(len(kmer), whole))
                yield pa.RecordBatch.from_arrays([pa.array(kmer), pa.array(cnt), flags], ["kmer", "cnt", "whole"])

    partial = together.mapInArrow(count, "kmer long, cnt long, whole boolean")
    if hot.isEmpty():
        return partial.select("kmer", "cnt")
    partial = save_scratch(partial)
    return partial.filter("whole").select("kmer", "cnt").unionByName(_merged(partial, min_count))


def count_chained(runs: DataFrame, k: int, min_count: int = 1, buckets: int = BUCKETS, hot_bases: int = HOT_BASES) -> DataFrame:
    """The same counts as chains of k-mers, see :mod:`strandweave.operators.kmer_chains`."""
    together, hot = _at_places(runs, buckets, hot_bases)
    if not hot.isEmpty():
        return kmer_chains.chained(count_runs(runs, k, min_count, buckets, hot_bases), k)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "place", READ_BYTES):
            for bases, sizes, times in _by_minimizer(*_arrays(table), k):
                oriented, n_of, cnt = kernels.counted_chains(bases, sizes, times, k, min_count)
                if len(cnt):
                    yield kmer_chains.packed_row(oriented, n_of, cnt, k)

    return together.mapInArrow(count, kmer_chains.CHAINS)


def _at_places(runs: DataFrame, buckets: int, hot_bases: int) -> tuple[DataFrame, DataFrame]:
    """Runs in the task of their place, sorted by it, and the buckets that have several."""
    parts = ["part"] if "part" in runs.columns else []
    placed, hot, n_tasks = dealt(runs, buckets, hot_bases)
    slim = placed.select("place", F.col("n_places").isNotNull().alias("hot"), *parts, "sizes", "bases", "times")
    return slim.repartition(n_tasks, "place").sortWithinPartitions("place"), hot


def _counts_at_places(batches: Iterator[pa.RecordBatch], k: int, min_count: int) -> Iterator[tuple[bool, Iterator]]:
    """Of some places at a time, whether all their runs are here, and their ``(kmer, cnt)`` in parts."""
    for table in whole_groups(batches, "place", READ_BYTES):
        tables = [table]
        if "part" in table.column_names:
            tables = [table.filter(pc.equal(table["part"], part)) for part in pc.unique(table["part"]).to_pylist()]
        windows = [kernels.weighted_windows(*_arrays(own), k) for own in tables]
        # With a bucket among them that other tasks count too, all of these are partial counts.
        whole = not table["hot"].to_numpy().any()
        least = min_count if whole else 1
        bits = kernels.WEIGHT_BITS
        found = kernels.counted_apart(windows, bits=bits) if len(windows) > 1 else kernels.counted(windows[0], bits=bits)
        yield whole, ((kmer[cnt >= least], cnt[cnt >= least]) for kmer, cnt in found)


def _arrays(runs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bases, size and times of packed runs."""
    sizes = joined_planes(runs["sizes"], "<u4").astype(np.int64)
    times = runs["times"]
    often = np.ones(len(sizes), np.int64) if times.null_count else joined_planes(times, "<u4").astype(np.int64)
    return joined(runs["bases"], "u1"), sizes, often


def _by_minimizer(
    bases: np.ndarray, sizes: np.ndarray, times: np.ndarray, k: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Packed runs in parts of about :data:`CHAIN_WINDOWS` windows, those of one minimizer together."""
    parts = -(-int((sizes - k + 1).sum()) // CHAIN_WINDOWS)
    if parts <= 1:
        yield bases, sizes, times
        return
    low = np.minimum(*kernels.end_minimizers(kernels.first_windows(bases, sizes, k), k, minimizer_length(k)))
    part = kernels.hashed_bucket(kernels.scattered(low, 0), parts)
    for i in range(parts):
        own = np.flatnonzero(part == i)
        yield kernels.taken_runs(bases, sizes, own)[0], sizes[own], times[own]


def _merged(partial: DataFrame, min_count: int) -> DataFrame:
    counts = partial.filter("not whole").groupBy("kmer").agg(F.sum("cnt").alias("cnt"))
    return counts.filter(F.col("cnt") >= min_count)


def count_dense(reads: DataFrame, k: int, min_count: int = 1, seq_col: str = "seq") -> DataFrame:
    """``(kmer, cnt)`` for a short ``k``, whose k-mers each task counts in an array, so that few rows are shuffled."""
    dna.check_k(k)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(4**k, np.int64)
        for batch in batches:
            data, offsets = kernels.text_bytes(batch.column(0))
            for lo, hi in kernels.slices(offsets, kernels.MAX_BASES // 8):
                at = offsets[lo : hi + 1] - offsets[lo]
                _, _, kmer = kernels.canonical_windows(data[offsets[lo] : offsets[hi]], at, k)
                found += np.bincount(kmer, minlength=4**k)
        kmer = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(kmer), pa.array(found[kmer])], ["kmer", "cnt"])

    partial = reads.select(F.coalesce(F.col(seq_col), F.lit("")).alias("seq")).mapInArrow(count, "kmer long, cnt long")
    return partial.groupBy("kmer").agg(F.sum("cnt").alias("cnt")).filter(F.col("cnt") >= min_count)
