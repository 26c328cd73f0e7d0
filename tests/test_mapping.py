import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.functions import kernels
from strandweave.operators import abundance, compare, mapping
from tests import model

CASES = [
    ([], 0, 0),
    ([5, 5, 5], 5, 3),
    ([1, 2, 2, 2], 0, 2),
    ([1, 1, 1, 2, 2, 2], 1, 3),
    ([1, 1, 1, 2, 2, 3, 3], 0, 1),
    ([4, 4], 0, 2),
]


def _random_votes():
    rng = random.Random(5)
    lists = [h for h, _, _ in CASES]
    lists += [[rng.randint(1, 4) for _ in range(rng.randint(0, 20))] for _ in range(400)]
    lists += [[rng.choice([1, 1, 1, 2]) for _ in range(50)] for _ in range(50)]
    return lists


def test_vote_cases():
    for hits, contig, n in CASES:
        assert model.vote(hits, 3) == (contig, n)


def test_vote_kernel():
    lists = _random_votes()
    row = np.repeat(np.arange(len(lists)), [len(h) for h in lists])
    contig, hits = kernels.majority_votes(row, np.array(sum(lists, [])), len(lists), 3)
    assert list(zip(contig.tolist(), hits.tolist())) == [model.vote(h, 3) for h in lists]


def test_votes_as_columns(spark):
    lists = _random_votes()
    rows = [(i, p, c) for i, h in enumerate(lists) for p, c in enumerate(h, start=1)]
    random.Random(0).shuffle(rows)
    hits = spark.createDataFrame(rows, "read_id long, pos int, contig_id long")
    got = {r.read_id: (r.contig_id, r.hits) for r in mapping.vote_majority(hits, 3).collect()}
    assert got == {i: model.vote(h, 3) for i, h in enumerate(lists) if h}
    best = {r.read_id: (r.contig_id, r.hits) for r in mapping.vote_plurality(hits, 3).collect()}
    ordered = sorted(rows)
    row, contig = np.array([r[0] for r in ordered]), np.array([r[2] for r in ordered])
    by_kernel = list(zip(*(x.tolist() for x in kernels.plurality_votes(row, contig, len(lists), 3)), strict=True))
    assert {i: v for i, v in enumerate(by_kernel) if lists[i]} == best
    for i, h in enumerate(lists):
        if h:
            n = max(h.count(c) for c in set(h))
            first = min(c for c in set(h) if h.count(c) == n)
            assert best[i] == (first if n >= 3 else 0, n)


def _case(spark, k):
    rng = random.Random(k)
    texts = ["".join(rng.choices("ACGT", k=n)) for n in (200, 150, 90, k, k - 1)]
    texts.append(texts[0][50:150])
    contigs = [(i + 1, t, 1.5) for i, t in enumerate(texts)]
    reads = []
    for t in texts[:3]:
        for _ in range(20):
            at = rng.randrange(len(t) - 60)
            reads.append(rng.choice([str, model.rc])(t[at : at + 60]))
    reads += [texts[0][:40] + texts[1][:40], texts[0][:30] + "N" + texts[0][31:80], "ACGT", "", "A" * 70]
    return (
        spark.createDataFrame(contigs, "contig_id long, sequence string, mean_coverage float"),
        spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string"),
        texts,
        reads,
    )


@pytest.mark.parametrize("k", [11, 31])
def test_mapping_paths_agree_with_model(spark, k):
    contigs, reads, texts, raw = _case(spark, k)
    owner = {}
    for i, t in enumerate(texts, start=1):
        for p in range(len(t) - k + 1):
            owner.setdefault(model.canonical(t[p : p + k]), i)
    index = {r.kmer: r.contig_id for r in mapping.contig_index(contigs, k).collect()}
    assert index == {model.pack(s): c for s, c in owner.items()}

    def expected(drop):
        out = {}
        for i, r in enumerate(raw):
            if drop and "N" in r:
                continue
            windows = [model.canonical(r[p : p + k]) for p in range(len(r) - k + 1) if "N" not in r[p : p + k]]
            out[i] = model.vote([owner[w] for w in windows if w in owner], 3)
        return out

    for options in ({}, {"hot_bases": 200}, {"broadcast_kmers": 10**6}):
        for drop in (True, False):
            got = mapping.map_reads(reads.repartition(3), contigs, drop_with_n=drop, k=k, **options)
            assert {r.read_id: (r.contig_id, r.hits) for r in got.collect()} == expected(drop)
    hits = mapping.read_hits(reads, mapping.stored_index(contigs, k), k, hot_bases=200)
    places = {
        (i, p + 1): owner[w]
        for i, r in enumerate(raw)
        for p in range(len(r) - k + 1)
        if "N" not in r[p : p + k] and (w := model.canonical(r[p : p + k])) in owner
    }
    assert {(r.read_id, r.pos): r.contig_id for r in hits.collect()} == places


def test_empty_index_leaves_reads_unmapped(spark):
    _, reads, _, raw = _case(spark, 31)
    none = spark.createDataFrame([(1, "ACGT", 1.0)], "contig_id long, sequence string, mean_coverage float")
    got = mapping.map_reads(reads, none, k=31).collect()
    assert len(got) == len(raw) - 1 and all((r.contig_id, r.hits) == (0, 0) for r in got)
    with pytest.raises(ValueError):
        mapping.ReadMapper(none, vote="median")


def test_abundance(spark):
    contigs = spark.createDataFrame(
        [(1, "A" * 1000, 9.0), (2, "A" * 500, 3.0), (3, "A" * 250, 1.0)],
        "contig_id long, sequence string, mean_coverage float",
    )
    assigned = spark.createDataFrame(
        [(i, c, 5) for i, c in enumerate([1] * 6 + [2] * 2 + [0] * 4)], "read_id long, contig_id long, hits long"
    )
    rows = {r.contig_id: r for r in abundance.abundance_from_assignments(contigs, assigned).collect()}
    assert [rows[i].raw_count for i in (1, 2, 3)] == [6, 2, 0]
    assert rows[1].rpkm == pytest.approx(6 / 1.0 / (8 / 1e6))
    assert [rows[i].tpm for i in (1, 2, 3)] == pytest.approx([6e5, 4e5, 0])
    nothing = abundance.abundance_from_assignments(contigs, assigned.filter("contig_id = 0")).collect()
    assert all(r.rpkm == r.tpm == 0 for r in nothing)


def test_containment_and_repeats(spark):
    contigs = spark.createDataFrame([(1, "ACGTTGCAAC"), (2, model.rc("ACGTTGCAAC")), (3, "GGGGGGGGGG")], "contig_id long, sequence string")
    texts = spark.createDataFrame([(7, "TTACGTTGCAACTT"), (8, "CCCCC")], "text_id long, sequence string")
    found = compare.contained_in(contigs, texts, 5)
    assert {tuple(r) for r in found.collect()} == {(1, 7), (2, 7)}
    assert [r.n for r in compare.repeated_contigs(contigs).collect()] == [2]
    assert compare.repeated_contigs(contigs, min_length=11).isEmpty()
    assert contigs.filter(F.length("sequence") == 10).count() == 3


def test_containment_of_short_contigs(spark):
    texts = spark.createDataFrame([(1, "ACGTTGCATTAGGCTAACCGTTAAGGCTTACG"), (2, "TTTTT")], "text_id long, sequence string")
    contigs = spark.createDataFrame(
        [(1, "TTGCATTAGG"), (2, "CCTAATG"), (3, "A"), (4, "GGGG"), (5, "AAAAA"), (6, "")], "contig_id long, sequence string"
    )
    found = {(r.contig_id, r.text_id) for r in compare.contained_in(contigs, texts, 15).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (3, 2), (5, 2)}
    assert compare.contained_in(contigs.limit(0), texts, 15).isEmpty()
