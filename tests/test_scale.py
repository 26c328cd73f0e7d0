"""What must not grow with the tables: broadcasts, bytes read for a range, passes over a micro-batch."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave.functions import batches, dna, kernels
from strandweave.operators import compare, graph, kmers, mapping, node_buckets, unitigs
from strandweave.plans import catalog
from strandweave.session import BATCH_BYTES, save_scratch, scratch_path, ship_package
from strandweave.sources import fastq
from tests import model


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _counts(spark, n=3000, k=15, seed=1):
    rng = random.Random(seed)
    text = "".join(rng.choices("ACGT", k=n))
    reads = spark.createDataFrame([(text[i : i + 100],) for i in range(0, n, 20)] * 2, "seq string")
    return save_scratch(kmers.count_reads(reads, k, 1))


def test_edges_are_not_broadcast_to_find_twins(spark):
    runs_look_small = graph.build_edges(_counts(spark), 15)
    assert "Broadcast" not in _plan(graph.edge_twins(runs_look_small))
    assert graph.edge_twins(runs_look_small).count() == runs_look_small.count()


@pytest.mark.parametrize("start", [0, 5000])
def test_a_range_reads_little_beyond_itself(tmp_path, start):
    path = tmp_path / "r.fastq"
    path.write_text("".join(f"@{i}\n{'ACGT' * 25}\n+\n{'I' * 100}\n" for i in range(20000)))
    read = 0

    class Counting:
        def __init__(self, f):
            self.f = f

        def read(self, n):
            nonlocal read
            block = self.f.read(n)
            read += len(block)
            return block

    with open(path, "rb") as f:
        f.seek(start)
        for at, _ in fastq._blocks(Counting(f), start, b"", start + 1000):
            if at >= start + 1000:
                break
    assert 1000 <= read <= 3 * fastq.TAIL_BYTES
    parts = [fastq.FastqRange("r", "r", i, i + 1) for i in range(5000)]
    dealt = fastq._dealt(parts)
    assert len(dealt) <= fastq.MOST_TASKS and [p for d in dealt for p in d.parts] == parts


def test_both_ways_of_mapping_agree(spark):
    contigs, reads, k = _mapping_case(spark)
    index = mapping.stored_index(contigs, k)
    assert mapping.share_index(index, 1) is None
    for vote in ("majority", "plurality"):
        ways = [{"broadcast_kmers": 0}, {"broadcast_kmers": 0, "hot_bases": 200}, {}]
        found = [mapping.map_reads(reads, contigs, k=k, vote=vote, **way) for way in ways]
        rows = [sorted(tuple(r) for r in df.collect()) for df in found]
        assert rows[0] == rows[1] == rows[2] and any(c for _, c, _ in rows[0])
        assert "Exchange" not in _plan(found[2]) and "Exchange" in _plan(found[0])
    hits = [mapping.read_hits(reads, index, k, broadcast_kmers=n) for n in (0, 10**6)]
    assert sorted(map(tuple, hits[0].collect())) == sorted(map(tuple, hits[1].collect())) != []


def _mapping_case(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ACGT", k=400)) for _ in range(4)]
    contigs = spark.createDataFrame(list(enumerate(texts, 1)), "contig_id long, sequence string")
    raw = [(i, t[p : p + 60]) for i, (t, p) in enumerate((t, p) for t in texts for p in range(0, 340, 17))]
    return contigs, spark.createDataFrame(raw + [(10**6, "T" * 60)], "read_id long, seq string"), 11


def test_lookup_in_small_pieces(spark, monkeypatch):
    contigs, reads, k = _mapping_case(spark)
    whole = mapping.map_reads(reads, contigs, k=k, broadcast_kmers=0).collect()
    monkeypatch.setattr(mapping, "ASK_BASES", 100)
    assert sorted(mapping.map_reads(reads, contigs, k=k, broadcast_kmers=0).collect()) == sorted(whole)


def test_seeds_go_to_the_texts_if_few(spark, monkeypatch):
    texts = spark.createDataFrame([(7, "TTACGTTGCAACTT"), (8, "CCCCC"), (7, "TTACGTTGCAACTT")], "text_id long, sequence string")
    seeds = spark.createDataFrame([(model.pack(model.canonical("ACGTT")),)], "kmer long")
    few = compare._seed_windows(texts, seeds, 5)
    monkeypatch.setattr(compare, "SHARED_KMERS", 0)
    many = compare._seed_windows(texts, seeds, 5)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) != []
    assert "Exchange" not in _plan(few)


@pytest.mark.parametrize("limit", [1, 50, 10**6])
def test_runs_by_slices(limit):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=rng.randrange(80))) for _ in range(60)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    whole, sliced = kernels.minimizer_runs(data, offsets, 9, 4), kernels.runs_by_slices(data, offsets, 9, 4, limit)
    assert all(np.array_equal(a, b) for a, b in zip(whole[1:], sliced[1:], strict=True)) and len(whole[1])


@pytest.mark.parametrize("k", [2, 3, 6, 15, 31])
@pytest.mark.parametrize("most,buckets", [(3, 2), (50, 7), (10**6, 1)])
def test_every_edge_comes_once_with_its_siblings(spark, k, most, buckets):
    counts = _counts(spark, 600, k)

    def use(eid, src, dst, w):
        linear = kernels.linear_sources(src)
        yield pa.RecordBatch.from_arrays([*map(pa.array, (eid, src, dst, w, linear))], ["eid", "src", "dst", "w", "linear"])

    found = node_buckets.at_nodes(counts, k, 1, most, use, "eid long, src long, dst long, w long, linear boolean", buckets)
    edges = graph.with_source_linear(graph.build_edges(counts, k))
    wanted = edges.select((F.col("kmer") * 2 + F.col("dir")).alias("eid"), "src", "dst", "w", "src_linear")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_segments_need_no_shuffle_of_edges(spark):
    counts = _counts(spark)
    plan = _plan(unitigs.first_segments(counts, 15, counts.count()))
    # Packed k-mers, by bucket; no edge and no degree travels.
    assert plan.count("Exchange hashpartitioning") == 1 and "HashAggregate" not in plan and "Generate" not in plan


def test_stream_of_a_table_in_several_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, "the brown fox jumps over it " * 9, "en") for i in range(6)], "doc_id long, text string, lang string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.createDataFrame([(0, "brown fox jumps over it the lazy dog " * 3)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.contig_id: r.n for r in catalog.QUERIES["stream_map_counts"](spark, str(tmp_path)).collect()}
    reads = catalog._reads(spark, str(tmp_path))
    assert got[1] > 0 and sum(got.values()) == reads.count()


def test_batches_of_large_rows_are_cut():
    batch = pa.RecordBatch.from_pydict({"key": [i // 100 for i in range(2000)], "value": [b"x" * 1000] * 2000})
    tables = list(batches.tables_of([batch], 100_000))
    assert max(t.nbytes for t in tables) <= 200_000 and pa.concat_tables(tables).equals(pa.Table.from_batches([batch]))
    groups = list(batches.whole_groups([batch], "key", 100_000))
    assert max(t.nbytes for t in groups) <= 400_000 and pa.concat_tables(groups).equals(pa.Table.from_batches([batch]))
    assert sum(len(set(t["key"].to_pylist())) for t in groups) == 20


@pytest.mark.parametrize("limit", [1, 7, 1000])
def test_windows_are_counted_in_parts(limit):
    values = np.random.default_rng(1).integers(0, 40, 500)
    known, n = np.unique(values, return_counts=True)
    parts = list(kernels.counted(values.copy(), limit))
    assert np.array_equal(np.concatenate([x for x, _ in parts]), known)
    assert np.array_equal(np.concatenate([x for _, x in parts]), n)
    assert max(int(x.sum()) for _, x in parts) <= limit + int(n.max())
    assert not list(kernels.counted(values[:0]))


@pytest.mark.parametrize("k", [2, 4, 15, 31])
def test_kmers_are_spelled_by_lookup(spark, k):
    values = [0, 1, 4**k - 1, random.Random(k).randrange(4**k), None]
    spelled = [None if v is None else "".join("ACGT"[v >> 2 * i & 3] for i in range(k - 1, -1, -1)) for v in values]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, kmer long")
    found = rows.select("i", dna.unpack(F.col("kmer"), k).alias("text"))
    assert [r.text for r in found.orderBy("i").collect()] == spelled and "conv(" not in _plan(found)


@pytest.mark.parametrize("k", [4, 5, 15])
def test_degrees_are_counted_without_shuffling_edges(spark, k):
    counts = _counts(spark, 2000, k)
    found = graph.degrees_at_nodes(counts, k)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, graph.degrees(graph.build_edges(counts, k)).collect())) != []
    assert found.schema.simpleString() == graph.degrees(graph.build_edges(counts, k)).schema.simpleString()


def test_tables_of_finished_rounds_are_removed(spark):
    rng = random.Random(8)
    text = "".join(rng.choices("ACGT", k=3000))
    reads = spark.createDataFrame([(text[i : i + 100],) for i in range(0, 2900, 20)] * 2, "seq string")
    folder = Path(scratch_path(spark).removeprefix("file:")).parent

    def tables():
        return {str(p) for p in folder.glob("*/table")}

    before = tables()
    counts = kmers.saved_counts(reads, 15)
    # Only the table of buckets of many bases and the counts themselves are left.
    assert len(tables() - before) == 2
    kept = save_scratch(counts)
    expected = sorted(map(tuple, unitigs.compact_unitigs(kept, 15).collect()))
    before = tables()
    found = unitigs.compact_unitigs(counts, 15, task_bytes=20_000, task_links=10, drop_counts=True)
    assert sorted(map(tuple, found.collect())) == expected != []
    assert not Path(counts._scratch_folder.removeprefix("file:")).exists()
    segments = [t for t in tables() - before if "first_eid" in spark.read.parquet(t).columns]
    assert not segments


def test_python_workers_get_few_megabytes_at_a_time(spark):
    key, value = next(iter(BATCH_BYTES.items()))
    before = spark.conf.get(key, None)
    texts = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("x"), 10_000).alias("text"))

    def sizes(found):
        for batch in found:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    try:
        spark.conf.unset(key)
        ship_package(spark)
        found = [row.n for row in texts.mapInArrow(sizes, "n long").collect()]
        assert sum(found) > 30_000_000 and max(found) < int(value) + 100_000
        # What the session says stays.
        spark.conf.set(key, "1000000")
        ship_package(spark)
        assert spark.conf.get(key) == "1000000"
    finally:
        spark.conf.set(key, before or value)
