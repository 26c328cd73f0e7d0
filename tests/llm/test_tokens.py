"""Subword ids, packing and token counts against the tokenizer itself."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strandweave.functions import batches
from strandweave.llm import packing, subwords, token_counts

CASES = ["", None, " \n x  y\t", "don't WE'LL it's 'tis", "ÀÉÎ STRASSE ẞß ΑΣ ας é", "a\x1cb \x0b c", "日本語 123abc ½ ª", "foo.bar... -- 'ab' (x) ÷x ﬁ"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(subwords.vocabulary_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_encoder(rows, tokenizer, name):
    encoder = subwords.WordEncoder(subwords.vocabulary_path(name))
    texts = CASES + [row[1] for row in rows]
    for array in (pa.array(texts), pa.array(["skipped"] + texts).slice(1)):
        ids, starts = encoder.encode(array)
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [ids_of(tokenizer, t) for t in texts]


def test_chunks_cover_all():
    array = pa.array(["a" * n for n in (5, 0, 30, 1, 9, 9)] + [None])
    parts = list(subwords.chunks(array, 10))
    assert [first for first, _ in parts] == [0, 2, 3, 5] or sum(len(t) for _, t in parts) == 7
    assert sum((t.to_pylist() for _, t in parts), []) == array.to_pylist()


def test_pack(docs, rows, empty, tokenizer):
    got = packing.pack(docs, length=64, with_ids=True).collect()
    want = Counter((row[0], tuple([*ids_of(tokenizer, row[1]), 1])) for row in rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        pieces[r.doc_id, r.doc_tokens, r.start].append(tuple(ids.tolist()))
        sequences[r.sequence_id].append((r.offset, r.length))
    expected = defaultdict(list)
    for (i, ids), n in want.items():
        for at in range(0, len(ids), 64):
            expected[i, len(ids), at] += [ids[at : at + 64]] * n
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in expected.items()}
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(empty).count() == 0


def test_pack_histogram_is_tight():
    rng = np.random.default_rng(5)
    histogram = Counter(np.minimum(2048, rng.lognormal(6, 1, 5000)).astype(int).tolist())
    histogram.pop(0, None)
    patterns = packing.pack_histogram(histogram, 2048)
    held = Counter()
    for pattern, count in patterns:
        assert sum(pattern) <= 2048
        for size in pattern:
            held[size] += count
    assert held == histogram
    total = sum(size * n for size, n in histogram.items())
    assert total / (2048 * sum(count for _, count in patterns)) > 0.99


def test_ranks_are_dense(spark, docs):
    many = spark.range(4000).selectExpr("id AS doc_id", "'alike' AS text")
    got = packing.pack(many, length=64).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 4000
    assert Counter(Counter(r.sequence_id for r in got).values()).most_common(1)[0][0] == 64 // got[0].length


def test_token_counts(docs, rows, empty, tokenizer):
    lengths = [len(ids_of(tokenizer, row[1])) for row in rows]
    got = {r.length: r for r in token_counts.token_counts(docs).collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        assert r.n_docs == lengths.count(limit)
        assert r.docs_within == sum(n <= limit for n in lengths)
        assert r.docs_over == sum(n > limit for n in lengths)
        assert r.tokens_within == sum(n for n in lengths if n <= limit)
        assert r.tokens_truncated == sum(min(n, limit) for n in lengths)
        assert r.total_tokens == sum(lengths)
        assert r.quantile == pytest.approx(r.docs_within / len(lengths))
    assert token_counts.token_counts(empty).count() == 0


def test_tasks_give_spare_memory_back(monkeypatch):
    released = []
    pool = type("Pool", (), {"release_unused": lambda self: released.append(True)})()
    monkeypatch.setattr(batches.pa, "default_memory_pool", lambda: pool)
    made = batches.given_back(iter([1, 2]))
    assert [next(made), next(made)] == [1, 2] and not released
    assert list(made) == [] and released == [True]
