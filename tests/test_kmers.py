import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.functions import dna, kernels
from strandweave.operators import kmers, super_kmers
from strandweave.session import save_scratch
from strandweave.sources import kmer_dump
from tests import model


def _reads(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "read_id long, seq string")


def _named(df, k):
    return {r.kmer: r.cnt for r in df.select(dna.unpack(F.col("kmer"), k).alias("kmer"), "cnt").collect()}


def test_small_extraction(spark):
    found = kmers.extract_kmers(_reads(spark, ["ACGTACGT"]), 4)
    texts = Counter(r[0] for r in found.select(dna.unpack(F.col("kmer"), 4)).collect())
    assert texts == {"ACGT": 2, "CGTA": 2, "GTAC": 1}
    assert _named(kmers.count_kmers(found, 1), 4) == dict(texts)
    assert _named(kmers.count_kmers(found, 2), 4) == {"ACGT": 2, "CGTA": 2}


def test_strands_collide(spark):
    assert _named(kmers.count_reads(_reads(spark, ["AAAAA", "TTTTT"]), 5), 5) == {"AAAAA": 2}


@pytest.mark.parametrize("k", [2, 5, 16, 31])
def test_against_model(spark, k):
    rng = random.Random(k)
    texts = ["".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=rng.choice([0, 1, k - 1, k, k + 1, 80, 300]))) for _ in range(60)]
    texts += ["A" * 50, "acgtACGT" * 9, None]
    df = _reads(spark, texts)
    upper = [t.upper() for t in texts if t]
    assert _named(kmers.count_reads(df, k, 1), k) == dict(model.count(upper, k))
    rows = kmers.extract_kmers(df, k).select("read_id", "pos", dna.unpack(F.col("kmer"), k).alias("kmer")).collect()
    for r in rows:
        assert r.kmer == model.canonical(texts[r.read_id].upper()[r.pos - 1 : r.pos - 1 + k])
    # Reads split into slices give the same windows.
    assert len(rows) == sum(model.count(upper, k).values())


def test_slices_cover_all_rows():
    import numpy as np

    from strandweave.functions import kernels

    offsets = np.array([0, 0, 5, 6, 30, 31, 31])
    assert list(kernels.slices(offsets, 7)) == [(0, 3), (3, 4), (4, 6)]


def test_merge_cap_spectrum_top(spark):
    a = spark.createDataFrame([(1, 5), (2, 1)], "kmer long, cnt long")
    b = spark.createDataFrame([(1, 7), (3, 1)], "kmer long, cnt long")
    merged = kmers.merge_counts(a, b, max_count=10)
    assert {tuple(r) for r in merged.collect()} == {(1, 10), (2, 1), (3, 1)}
    assert {tuple(r) for r in kmers.spectrum(merged).collect()} == {(10, 1), (1, 2)}
    assert [tuple(r) for r in kmers.top_kmers(merged, 2).collect()] == [(1, 10), (2, 1)]
    with pytest.warns(UserWarning):
        assert kmers.warn_if_capped(merged, 10)
    assert not kmers.warn_if_capped(merged, 11)


def test_dump_round_trip(spark, tmp_path):
    counts = kmers.count_reads(_reads(spark, ["ACGTACGTTTGCA"] * 3), 5, 1)
    path = str(tmp_path / "dump")
    kmer_dump.write_dump(counts, 5, path)
    assert kmer_dump.read_dump(spark, path, 5).exceptAll(counts).isEmpty()
    lines = spark.createDataFrame([("ACGTA\t2",), ("TACGT\t3",), ("ACGNA\t1",), ("ACGTA",), ("",), ("ACG\t4",)], "value string")
    assert _named(kmer_dump.parse_dump(lines, 5), 5) == {"ACGTA": 5}


@pytest.mark.parametrize("k", [2, 4, 7, 15, 31])
@pytest.mark.parametrize("hot_bases", [super_kmers.HOT_BASES, 500])
def test_counts_by_runs(spark, k, hot_bases):
    """Counts of packed runs, with buckets whole and dealt over tasks, against a plain count."""
    rng = random.Random(k)
    texts = ["".join(rng.choices("ACGTacgtN", weights=[20] * 4 + [2] * 4 + [1], k=rng.randint(0, 200))) for _ in range(60)]
    texts += ["A" * 700, "T" * 300, "AC" * 200, "", "N" * 50, texts[0], model.rc(texts[1].upper())] + ["A" * 150] * 40
    df = _reads(spark, texts).unionByName(spark.createDataFrame([(9999, None)], "read_id long, seq string"))
    runs = save_scratch(super_kmers.cut_runs(df.repartition(3), k, buckets=5))
    want = model.count([t.upper() for t in texts], k)
    for least in (1, 3):
        got = super_kmers.count_runs(runs, k, least, buckets=5, hot_bases=hot_bases)
        assert _named(got, k) == {s: n for s, n in want.items() if n >= least}
    assert super_kmers.count_runs(save_scratch(super_kmers.cut_runs(df.limit(0), k)), k).isEmpty()


def test_runs_are_shorter_than_windows(spark):
    """No row for each window, and few bases more than the reads have."""
    rng = random.Random(1)
    texts = ["".join(rng.choices("ACGT", k=151)) for _ in range(500)]
    n, bases = super_kmers.cut_runs(_reads(spark, texts), 31).agg(F.sum(F.octet_length("sizes") / 4), F.sum("n_bases")).first()
    assert n < 500 * 121 / 6 and bases < 500 * 121 * 5


def test_counts_of_reads_merge_where_they_are_counted(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ACGT", k=60)) for _ in range(40)]
    chunks = [_reads(spark, texts + texts[:7]), _reads(spark, texts[::2] + ["ACGTTGCA" * 9]), _reads(spark, [])]
    for least, most in ((1, None), (2, None), (2, 3)):
        merged = kmers.merge_counts(*[kmers.count_reads(reads, 9, 1) for reads in chunks], min_count=least, max_count=most)
        # Tables that don't say what they were counted from are grouped by k-mer.
        grouped = kmers.merge_counts(*[save_scratch(kmers.count_reads(reads, 9, 1)) for reads in chunks], min_count=least, max_count=most)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (merged, grouped)]
        assert ["hashpartitioning(kmer" in plan for plan in plans] == [False, True]
        assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, grouped.collect()))
    # Of other tables, counts are not all there, or of another length.
    capped = kmers.count_reads(chunks[0], 9, 2)
    assert not hasattr(capped, "_counted_runs") and not hasattr(kmers.count_reads(chunks[0], 9, 1, max_count=2), "_counted_runs")


def test_counted_apart():
    rng = np.random.default_rng(4)
    parts = [rng.integers(-50, 50, n) for n in (700, 0, 90, 1)]
    for limit in (1, 7, 10_000):
        found = list(kernels.counted_apart([x.copy() for x in parts], limit))
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        assert np.concatenate([x for x, _ in found]).tolist() == values.tolist()
        assert np.concatenate([x for _, x in found]).tolist() == counts.tolist()
    assert list(kernels.counted_apart([])) == []
