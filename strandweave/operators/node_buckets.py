"""K-mers brought together at their nodes, so that a task sees every edge of the nodes it owns.

A node belongs to the bucket of its minimizer, and a k-mer goes to the buckets of its two ends, which are mostly
the same one. K-mers travel as chains, cut where the minimizer of their nodes changes, two bits a base and a count for
each k-mer. At a node all its out-edges are known, those of the other strand too, which are its in-edges turned around;
no edge is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandweave.functions import dna, kernels
from strandweave.functions.batches import byte_planes, joined, joined_planes, whole_groups
from strandweave.operators import kmer_chains

#: K-mers in a bucket, about.
BUCKET_KMERS = 100_000
#: Bytes of packed values handled at one time.
READ_BYTES = 1 << 20

_PACKED = pa.schema([("bucket", pa.int32()), ("n", pa.int64())] + [(name, pa.binary()) for name in ("sizes", "bases", "marks")] + [("wide", pa.int32()), ("cnts", pa.binary())])
_PACKED_SQL = "bucket int, n bigint, sizes binary, bases binary, marks binary, wide int, cnts binary"
#: Marks of a run: its first node (before the first k-mer) or its last one is owned elsewhere.
LEFT, RIGHT = 1, 2


def packed_at_nodes(counts: DataFrame, k: int, buckets: int) -> DataFrame:
    """``(bucket, n, sizes, bases, marks, wide, cnts)``: the k-mers of some of the chains at a bucket, as runs of bases
    with a count of ``wide`` bytes for each k-mer."""
    dna.check_k(k)
    m = kmer_chains.minimizer_length(k)
    saved, own_k = getattr(counts, "_chains", (None, k))
    if saved is None or own_k != k:
        saved = kmer_chains.chained(counts, k)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bases, size, cnt in kmer_chains.chains_of(batches):
            letters, offsets = kernels.unpacked(bases, size), np.concatenate(([0], np.cumsum(size)))
            # Runs of nodes that share a minimizer, and the k-mers that lead into and out of them.
            codes, row, first, width, own = kernels.runs_by_slices(letters, offsets, k - 1, m)
            left, right = first > offsets[row], first + width < offsets[row + 1]
            marks = (LEFT * left + RIGHT * right).astype(np.uint8)
            first, width = first - left, width + left + right
            bucket = ((own >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, row, first, width, marks = bucket[order], row[order], first[order], width[order], marks[order]
            packed, ends = kernels.pack_runs(codes, first, width)
            # A chain has k - 1 k-mers fewer than bases.
            n_of = width - k + 1
            weight = cnt[kernels.each(first - row * (k - 1), n_of)]
            n_before = np.concatenate(([0], np.cumsum(n_of)))
            wide = kmer_chains.count_width(cnt)
            weight = weight.astype(f"<u{wide}")
            edges = np.flatnonzero(np.diff(bucket, prepend=-1))
            stops = np.append(edges[1:], len(bucket))[: len(edges)]
            spans = list(zip(edges.tolist(), stops.tolist(), strict=True))
            columns = [
                pa.array(bucket[edges].astype(np.int32)),
                pa.array(n_before[stops] - n_before[edges]),
                pa.array([byte_planes(width[a:b], "<u4") for a, b in spans], pa.binary()),
                pa.array([packed[int(ends[a - 1]) if a else 0 : int(ends[b - 1])].tobytes() for a, b in spans], pa.binary()),
                pa.array([marks[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array(np.full(len(spans), wide, np.int32)),
                pa.array([weight[n_before[a] : n_before[b]].tobytes() for a, b in spans], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_PACKED)

    return saved.mapInArrow(pack, _PACKED_SQL)


def out_edges(values: pa.Table, k: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(eid, src, dst, w)`` of the out-edges of the nodes owned by the buckets of some values.

    At most about ``most`` at a time, all edges of a node together and of a bucket too, unless it alone has more.
    """
    rows = np.concatenate(([0], np.cumsum(2 * values["n"].to_numpy())))
    bucket = values["bucket"].to_numpy()
    ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket))
    begin = 0
    for lo, hi in kernels.slices(np.concatenate(([0], rows[ends])), most):
        stop = int(ends[hi - 1])
        yield from _out_edges(values.slice(begin, stop - begin), k, most)
        begin = stop


def _out_edges(values: pa.Table, k: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    size, packed = joined_planes(values["sizes"], "<u4").astype(np.int64), joined(values["bases"], "u1")
    marks = joined(values["marks"], "u1")
    w = np.concatenate([np.frombuffer(b, f"<u{n}") for b, n in zip(values["cnts"].to_pylist(), values["wide"].to_pylist(), strict=True)])
    n_of = size - k + 1
    n_before = np.concatenate(([0], np.cumsum(n_of)))
    byte = np.concatenate(([0], np.cumsum((size + 3) // 4)))
    parts = -(-2 * len(w) // most)
    for part in range(parts):
        found = []
        # Pieces, as working out nodes takes many times the space of a k-mer.
        for lo, hi in kernels.slices(n_before, most):
            fwd, rc = kernels.oriented_windows(packed[byte[lo] : byte[hi]], size[lo:hi], k)
            own_w, first = w[n_before[lo] : n_before[hi]], n_before[lo:hi] - n_before[lo]
            starts_here, ends_here = np.ones(len(fwd), bool), np.ones(len(fwd), bool)
            starts_here[first[(marks[lo:hi] & LEFT) > 0]] = False
            ends_here[(first + n_of[lo:hi] - 1)[(marks[lo:hi] & RIGHT) > 0]] = False
            forward, kmer = fwd <= rc, np.minimum(fwd, rc)
            here = [np.flatnonzero(np.where(forward, a, b)) for a, b in ((starts_here, ends_here), (ends_here, starts_here))]
            eid = np.concatenate([2 * kmer[here[0]], 2 * kmer[here[1]] + 1])
            weight = np.concatenate([own_w[here[0]], own_w[here[1]]]).astype(np.int64)
            src, dst = kernels.edge_nodes(eid, k)
            if parts > 1:
                mine = kernels.hashed_bucket(src >> 1, parts) == part
                eid, src, dst, weight = eid[mine], src[mine], dst[mine], weight[mine]
            found.append((eid, src, dst, weight))
        yield tuple(np.concatenate(columns) for columns in zip(*found, strict=True))


def at_nodes(
    counts: DataFrame, k: int, n_kmers: int, most: int, use: Callable[..., Iterator[pa.RecordBatch]], out: str, buckets: int | None = None
) -> DataFrame:
    """What ``use(eid, src, dst, w)`` makes of the out-edges of some nodes; every edge comes once, next to its siblings."""
    usual = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or max(-(-n_kmers // BUCKET_KMERS), 4 * usual)
    together = packed_at_nodes(counts, k, buckets).repartition(usual if buckets <= 64 * usual else buckets // 64, "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values in whole_groups(batches, "bucket", READ_BYTES):
            for edges in out_edges(values, k, most):
                if len(edges[0]):
                    yield from use(*edges)

    return together.sortWithinPartitions("bucket").mapInArrow(run, out)
