"""Exact dedup and mixing against plain Python."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandweave.llm import exact_dedup, mixing


def test_filter_blocks():
    assert exact_dedup.filter_blocks(0, 16, 1 << 28) == 1
    assert exact_dedup.filter_blocks(2048, 16, 1 << 28) == 1
    assert exact_dedup.filter_blocks(2049, 16, 1 << 28) == 2
    assert exact_dedup.filter_blocks(1 << 40, 16, 1 << 28) == 1 << 13


@pytest.mark.parametrize("bits", [1 << 28, 1 << 15])
def test_mark_duplicates(docs, rows, bits):
    got = exact_dedup.mark_duplicates(docs, max_filter_bits=bits).collect()
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[text or ""].append(i)
    assert len(got) == len(rows)
    for row in got:
        same = groups[row.text or ""]
        assert row.group_size == len(same)
        assert row.keep_id == max((i for i in same if i is not None), default=None)
        assert row.text_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
        assert not row.kept or row.doc_id == row.keep_id
    assert Counter(row.text or "" for row in got if row.kept) == Counter(dict.fromkeys(groups, 1))


def test_drop_duplicates_keeps_columns(docs, rows, empty):
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert {row.kept for row in kept.collect()} == {"k"}
    assert kept.count() == len({text or "" for _, text, *_ in rows})
    assert exact_dedup.drop_duplicates(empty).count() == 0


def test_many_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.mark_duplicates(docs)
    assert got.filter("kept").count() == 2001
    assert got.filter("text = 'same' AND kept").collect()[0].doc_id == 2997


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    weights = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = [s for s in names if s not in stopped]
        rest = total - sum(3 * sizes[s] for s in stopped)
        share = {s: rest * weights[s] / sum(weights[x] for x in left) for s in left}
        above = {s for s in left if share[s] > 3 * sizes[s]}
        if not above:
            return share | {s: 3 * sizes[s] for s in stopped}
        stopped |= above


def test_mix(docs, rows, empty):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    pick = lambda x: sorted((str(r.doc_id), str(r.text), r.size, r.taken) for r in x)
    assert pick(got) == pick(again)
    sizes = defaultdict(int)
    for _, text, _, source, *_ in rows:
        sizes[source] += len((text or "").split())
    want, taken = targets(dict(sizes)), defaultdict(int)
    for row in got:
        assert row.size == len((row.text or "").split())
        assert row.source_size == sizes[row.source]
        assert row.target == pytest.approx(want[row.source])
        assert 0 <= row.taken <= 3 * row.size
        taken[row.source] += row.taken
    assert len(got) == len(rows)
    for source, n in taken.items():
        # Tied rows share what is left evenly, so less than one word each is lost.
        assert abs(n - want[source]) <= 3
    assert mixing.mix(empty).count() == 0


def test_smaller_budget_takes_a_subset(spark):
    rows = [(i, "w " * (1 + i % 9), "big") for i in range(300)] + [(1000 + i, "w " * 10, f"s{i}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = {r.doc_id: r.taken for r in mixing.mix(docs, weights=(1, 4)).collect()}
    other = {r.doc_id: r.taken for r in mixing.mix(docs, weights=(1, 2)).collect()}
    big = [i for i, _, source in rows if source == "big"]
    low, high = sorted((one, other), key=lambda t: sum(t[i] for i in big))
    assert all(low[i] <= high[i] for i in big)


def test_mixed_documents(docs, empty):
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = {(r.doc_id, r.text): r.taken // r.size for r in mixing.mix(docs, split_last=False).collect() if r.taken}
    seen = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert set(seen) == set(taken)
    assert all(n % taken[key] == 0 for key, n in seen.items())
    assert mixing.mixed_documents(empty).count() == 0
