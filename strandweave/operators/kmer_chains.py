"""Counts kept as chains of k-mers, two bits a base.

K-mers of a bucket mostly overlap each other, so in chains a k-mer takes little more than a base instead of eight
bytes. A chain is no statement about the graph, only a way to store its k-mers; each is stored once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import kernels
from strandweave.functions.batches import byte_planes, from_planes, tables_of

#: Number of k-mers, bases of each chain, bases, and a count of ``wide`` bytes for each k-mer.
CHAINS = "n bigint, sizes binary, bases binary, wide int, cnts binary"
_ARROW_CHAINS = pa.schema(
    [("n", pa.int64()), ("sizes", pa.binary()), ("bases", pa.binary()), ("wide", pa.int32()), ("cnts", pa.binary())]
)
#: K-mers chained at one time, as that takes many times their space.
CHAIN_KMERS = 1_000_000
#: Bytes of ``(kmer, cnt)`` chained at one time.
PACK_BYTES = 16 << 20


def minimizer_length(k: int) -> int:
    return max(1, min(11, (k + 1) // 2))


def chain_batches(kmer: np.ndarray, cnt: np.ndarray, k: int, most: int = CHAIN_KMERS) -> Iterator[pa.RecordBatch]:
    """Rows of :data:`CHAINS` that hold some counts; of more than ``most``, those with one minimizer stay together."""
    parts = -(-len(kmer) // most)
    if parts > 1:
        m = minimizer_length(k)
        part = np.empty(len(kmer), np.int64)
        for at in range(0, len(kmer), most):
            ends = kernels.end_minimizers(kmer[at : at + most], k, m)
            part[at : at + most] = kernels.hashed_bucket(kernels.scattered(np.minimum(*ends), 0), parts)
    for i in range(parts):
        own, own_cnt = (kmer[part == i], cnt[part == i]) if parts > 1 else (kmer, cnt)
        if not len(own):
            continue
        order, oriented, n_of = kernels.kmer_chains(own, k)
        yield packed_row(oriented, n_of, own_cnt[order], k)


def packed_row(oriented: np.ndarray, n_of: np.ndarray, cnt: np.ndarray, k: int) -> pa.RecordBatch:
    """A row of :data:`CHAINS`."""
    packed, size = kernels.pack_chains(oriented, n_of, k)
    wide = count_width(cnt)
    row = [len(cnt), byte_planes(size, "<u4"), packed.tobytes(), wide, cnt.astype(f"<u{wide}").tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ARROW_CHAINS, strict=True)], schema=_ARROW_CHAINS)


def count_width(cnt: np.ndarray) -> int:
    """Bytes that hold each of the counts."""
    return next(n for n in (1, 2, 4, 8) if n == 8 or not len(cnt) or int(cnt.max()) < 1 << 8 * n)


def chained(counts: DataFrame, k: int) -> DataFrame:
    """Rows of :data:`CHAINS` from ``(kmer, cnt)``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables_of(batches, PACK_BYTES):
            yield from chain_batches(table["kmer"].to_numpy(), table["cnt"].to_numpy(), k)

    return counts.select("kmer", "cnt").mapInArrow(pack, CHAINS)


def chains_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Packed bases, bases of each chain and counts, row by row."""
    for batch in batches:
        for row in batch.to_pylist():
            size = from_planes(row["sizes"], "<u4").astype(np.int64)
            yield np.frombuffer(row["bases"], np.uint8), size, np.frombuffer(row["cnts"], f"<u{row['wide']}").astype(np.int64)


def unchained(saved: DataFrame, k: int) -> DataFrame:
    """``(kmer, cnt)`` of saved chains; operators that meet k-mers at nodes take the chains themselves."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packed, size, cnt in chains_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(kernels.run_windows(packed, size, k)), pa.array(cnt)], ["kmer", "cnt"])

    counts = saved.mapInArrow(unpack, "kmer bigint, cnt bigint")
    counts._chains = saved, k
    counts._scratch_folder = saved._scratch_folder
    return counts


def n_kmers(counts: DataFrame) -> int:
    """How many k-mers there are."""
    if hasattr(counts, "_chains"):
        return counts._chains[0].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts.count()
