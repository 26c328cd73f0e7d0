"""Little space for what travels and is saved: equal runs once, chains of k-mers, packed segments."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave.functions import batches, kernels
from strandweave.operators import contigs, graph, kmer_chains, kmers, node_buckets, super_kmers, unitigs
from strandweave.session import save_scratch, scratch_path
from tests import model


def _texts(n=40, length=300, seed=5):
    rng = random.Random(seed)
    text = "".join(rng.choices("ACGT", k=n * 50 + length))
    texts = [text[i * 50 : i * 50 + length] for i in range(n)]
    return [*texts, model.rc(texts[3]), "A" * 200, "AC" * 90, "ACGNNACG", "", texts[0]]


def _reads(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "read_id long, seq string")


def _rows(df):
    return sorted(map(tuple, df.select("kmer", "cnt").collect()))


@pytest.mark.parametrize("k", [9, 15, 31])
def test_equal_runs_travel_once(spark, k):
    texts = _texts() * 5
    reads = _reads(spark, texts).coalesce(1)
    runs = save_scratch(super_kmers.cut_runs(reads, k))
    once = super_kmers.cut_runs(_reads(spark, _texts()).coalesce(1), k)
    n_runs = F.sum(F.octet_length("sizes") / 4)
    # Runs of over 64 bases are not compared.
    assert runs.agg(n_runs).first()[0] <= once.agg(n_runs).first()[0] + 5 * 4
    want = {(model.pack(s), n) for s, n in model.count(texts, k).items()}
    assert set(_rows(super_kmers.count_runs(runs, k))) == want
    assert set(_rows(kmer_chains.unchained(save_scratch(super_kmers.count_chained(runs, k)), k))) == want


def test_weights_of_windows():
    rng = np.random.default_rng(1)
    size = rng.integers(9, 70, 50)
    codes = rng.integers(0, 4, int(size.sum())).astype(np.uint8)
    first = np.cumsum(size) - size
    packed, ends = kernels.pack_runs(codes, first, size)
    times = rng.integers(1, 12, 50)
    keys = kernels.weighted_windows(packed, size, times, 9)
    windows = np.repeat(kernels.run_windows(packed, size, 9), np.repeat(times, size - 8))
    for limit in (1, 30, 10**6):
        parts = list(kernels.counted(keys.copy(), limit, kernels.WEIGHT_BITS))
        values, n = np.unique(windows, return_counts=True)
        assert np.array_equal(np.concatenate([x for x, _ in parts]), values)
        assert np.array_equal(np.concatenate([x for _, x in parts]), n)
    twice = np.concatenate([np.arange(50), np.arange(50)])
    again = kernels.taken_runs(packed, size, twice)
    held, stops, own, bucket, often = kernels.distinct_runs(*again, size[twice], twice % 7)
    short = size <= 64
    assert len(own) == short.sum() + 2 * (~short).sum() and often.sum() == 100 and np.all(np.diff(bucket) >= 0)
    assert np.array_equal(np.sort(kernels.run_windows(held, own, 9)), np.sort(kernels.run_windows(*kernels.taken_runs(packed, size, np.concatenate([np.flatnonzero(short), np.repeat(np.flatnonzero(~short), 2)]))[:1], size[np.concatenate([np.flatnonzero(short), np.repeat(np.flatnonzero(~short), 2)])], 9)))


@pytest.mark.parametrize("k", [2, 6, 8])
def test_short_kmers_are_counted_where_the_reads_are(spark, k):
    texts = _texts()
    reads = _reads(spark, [*texts, None])
    counts = kmers.count_reads(reads.repartition(3), k, 1)
    # A task sends a row for each k-mer it met, and no runs.
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "bucket" not in plan and "hashpartitioning(kmer" in plan
    want = {(model.pack(s), n) for s, n in model.count(texts, k).items()}
    assert set(_rows(counts)) == want
    assert set(_rows(kmers.count_reads(reads, k, 3, 5))) == {(s, min(n, 5)) for s, n in want if n >= 3}
    assert kmers.count_reads(reads.limit(0), k).isEmpty()


@pytest.mark.parametrize("k", [2, 3, 4, 5, 9, 15, 30, 31])
def test_chains_hold_each_kmer_once(k):
    rng = np.random.default_rng(k)
    for n in (0, 1, 40, 3000):
        codes = rng.integers(0, 4, n + k).astype(np.uint8)
        codes[: n // 3] = 1
        fwd, rev = kernels._windows(codes, k)
        kmer = rng.permutation(np.unique(np.minimum(fwd, rev)))
        order, oriented, n_of = kernels.kmer_chains(kmer, k)
        assert np.array_equal(np.sort(order), np.arange(len(kmer))) and n_of.sum() == len(kmer)
        packed, size = kernels.pack_chains(oriented, n_of, k)
        assert np.array_equal(kernels.run_windows(packed, size, k), kmer[order])
        assert len(size) <= max(len(kmer) / 3, 1) or k < 6
        cnt = rng.integers(1, 400, len(kmer))
        found = [x for most in (10, 10**6) for x in [kmer_chains.chain_batches(kmer, cnt, k, most)]]
        for rows in found:
            held = {}
            for bases, sizes, counts in kmer_chains.chains_of(rows):
                held |= dict(zip(kernels.run_windows(bases, sizes, k).tolist(), counts.tolist(), strict=True))
            assert held == dict(zip(kmer.tolist(), cnt.tolist(), strict=True))


def test_counts_are_saved_and_sent_in_little_space(spark):
    rng = random.Random(2)
    text = "".join(rng.choices("ACGT", k=40_000))
    reads = spark.createDataFrame([(text[i : i + 151],) for i in range(0, 39_900, 50)], "seq string")
    counts = kmers.saved_counts(reads, 31)
    n = counts.count()
    assert kmer_chains.n_kmers(counts) == n and _rows(counts) == _rows(kmers.count_reads(reads, 31))

    def width(df, *columns):
        return df.agg(F.sum(sum(F.octet_length(c) for c in columns))).first()[0]

    saved = counts._chains[0]
    assert width(saved, "bases", "sizes", "cnts") < 4 * n
    sent = node_buckets.packed_at_nodes(counts, 31, 8)
    assert width(sent, "bases", "sizes", "marks", "cnts") < 7 * n
    expected = sorted(map(tuple, graph.degrees(graph.build_edges(counts, 31)).collect()))
    assert sorted(map(tuple, graph.degrees_at_nodes(counts, 31).collect())) == expected


def test_runs_of_a_minimizer_are_chained_together(monkeypatch):
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("ACGT"), 5000)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, 5000])
    codes, _, first, size, _ = kernels.minimizer_runs(data, offsets, 15, 8)
    packed, _ = kernels.pack_runs(np.concatenate([codes, codes]), np.concatenate([first, first + 5000]), np.concatenate([size, size]))
    size = np.concatenate([size, size])
    times = np.arange(len(size)) % 5 + 1
    monkeypatch.setattr(super_kmers, "CHAIN_WINDOWS", 700)
    parts = list(super_kmers._by_minimizer(packed, size, times, 15))
    assert len(parts) > 5
    found = {}
    for part in parts:
        oriented, n_of, cnt = kernels.counted_chains(*part, 15, 3)
        own = np.minimum(oriented, kernels._revcomp(oriented, 15)).tolist()
        assert not found.keys() & set(own) and n_of.sum() == len(cnt)
        found |= dict(zip(own, cnt.tolist(), strict=True))
        runs, sizes = kernels.pack_chains(oriented, n_of, 15)
        assert kernels.run_windows(runs, sizes, 15).tolist() == own
    windows = np.repeat(kernels.run_windows(packed, size, 15), np.repeat(times, size - 14))
    values, n = np.unique(windows, return_counts=True)
    assert found == {v: c for v, c in zip(values.tolist(), n.tolist(), strict=True) if c >= 3}


@pytest.mark.parametrize("k", [4, 5, 6, 15, 31])
def test_segments_are_packed(k):
    rng = np.random.default_rng(k)
    codes = rng.integers(0, 4, 2000).astype(np.uint8)
    fwd, rev = kernels._windows(codes, k)
    kmer = np.unique(np.minimum(fwd, rev))
    eid = np.concatenate([2 * kmer, 2 * kmer + 1])
    src, dst = kernels.edge_nodes(eid, k)
    w = rng.integers(1, 1 << 40, len(eid))
    for segments in (kernels.edges_to_segments(eid, src, dst, w, k), kernels.join_segments(kernels.edges_to_segments(eid, src, dst, w, k))):
        packed = kernels.pack_segments(segments, k)
        assert kernels.unpack_segments(*packed, k).to_pylist() == segments.to_pylist()
        bucket = rng.integers(0, 5, segments.num_rows)
        rows = unitigs._packed_rows(*packed, k, bucket)
        back = [x for held in unitigs._held([rows], 1) for x in kernels.unpack_segments(*held, k).to_pylist()]
        wanted = segments.to_pylist()
        assert back == [wanted[i] for i in np.argsort(bucket, kind="stable")]
        assert sum(rows["n_linear"].to_pylist()) == sum(segments["src_linear"].to_pylist())


def test_numbers_as_byte_planes():
    values = np.array([0, 1, 300, 70_000, 2**31], np.int64)
    assert batches.from_planes(batches.byte_planes(values, "<u4"), "<u4").tolist() == values.tolist()
    column = pa.chunked_array([[batches.byte_planes(values, "<i8"), batches.byte_planes(values[:2], "<i8")]], pa.binary())
    assert batches.joined_planes(column, "<i8").tolist() == [*values.tolist(), 0, 1]
    assert len(batches.joined_planes(pa.chunked_array([], pa.binary()), "<u4")) == 0


def test_tables_of_contigs_are_removed(spark):
    rng = random.Random(8)
    text = "".join(rng.choices("ACGT", k=3000))
    reads = spark.createDataFrame([(text[i : i + 100],) for i in range(0, 2900, 20)] * 2, "seq string")
    folder = Path(scratch_path(spark).removeprefix("file:")).parent
    found = unitigs.compact_unitigs(kmers.saved_counts(reads, 15), 15, drop_counts=True)
    expected = sorted(map(tuple, contigs.traverse_contigs(found, 15).collect()))
    before = {str(p) for p in folder.glob("*/table")}
    got = contigs.traverse_contigs(found, 15, drop_unitigs=True)
    assert sorted(map(tuple, got.collect())) == expected != []
    left = {str(p) for p in folder.glob("*/table")}
    assert found._scratch_folder.removeprefix("file:") not in left
    columns = [set(spark.read.parquet(t).columns) for t in left - before]
    assert not [c for c in columns if "step" in c or "bases" in c or "emitted" in c] and {"contig_id"} <= set().union(*columns)
