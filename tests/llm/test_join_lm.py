"""N-gram join, language model and pipeline against plain Python."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from strandweave.llm import attention_lm as lm
from strandweave.llm import count_tree, lm_scoring, ngram_join, packing, queries
from strandweave.session import save_scratch

from .conftest import sentence

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SF_DIR = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().translate(LOWER).split()


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """(id, set size, component) of each row by comparing all pairs."""
    sets = [(i, shingles(text)) for i, text in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(None if i is None else find(i))) for i, s in sets)


def near_copies(n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, sentence(i, 30 + 9 * (i % 11))) for i in range(n)]
    common = sentence(999, 20)
    for group, size in ((0, 40), (1, 5), (2, 2)):
        text = sentence(500 + group, 120).split()
        for _ in range(size):
            own = list(text)
            for at in rng.choice(len(own), rng.integers(0, 5), replace=False):
                own[at] = f"w{rng.integers(50)}"
            rows.append((len(rows) + 7, " ".join(own)))
    rows += [(2000 + i, f"{common} {sentence(700 + i, 25)}") for i in range(12)]
    return rows


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.components_by_id(docs).collect()
    return sorted((str(r.id), r.n_shingles, str(r.component_id)) for r in got)


def test_join_messy(spark, docs, rows, empty):
    got = ngram_join.components_by_id(docs).collect()
    assert sorted((str(r.id), r.n_shingles, str(r.component_id)) for r in got) == components([r[:2] for r in rows])
    whole = ngram_join.near_duplicates(docs)
    assert whole.columns == [*docs.columns, "n_shingles", "component_id"] and whole.count() == len(rows)
    assert ngram_join.keep_one(docs).columns == docs.columns
    assert ngram_join.components_by_id(empty).count() == 0


@pytest.mark.parametrize("seed", [1])
def test_join_finds_every_component(spark, seed):
    rows = near_copies(40, seed)
    assert found(spark, rows) == components(rows)


def test_join_over_parts_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    monkeypatch.setattr(ngram_join, "PARTNERS", 1)
    rows = near_copies(20, 5)
    assert found(spark, rows) == components(rows)


def test_tree_leaves_out_no_similar_pair():
    texts = [text for _, text in near_copies(60, 9)] + [sentence(i, 400 + 3 * i) for i in range(30)]
    sets = count_tree.shingle_sets(pa.array(texts), 5)
    sizes = np.array([len(s) for s in sets])
    vectors = count_tree.unpacked_vectors([count_tree.count_vector(s) for s in sets])
    assert [v.sum() for v in vectors] == sizes.tolist()
    a, b = count_tree.CountTree(sizes, vectors, 80).pairs()
    kept = count_tree.similar_enough(count_tree.bounds(vectors, a, b), sizes[a] + sizes[b], 80)
    pairs = [tuple(sorted(p)) for p in zip(a[kept].tolist(), b[kept].tolist())]
    assert len(pairs) == len(set(pairs))
    similar = {
        (i, j)
        for j in range(len(sets))
        for i in range(j)
        if 180 * len(np.intersect1d(sets[i], sets[j])) >= 80 * (len(sets[i]) + len(sets[j]))
    }
    assert similar <= set(pairs) and len(pairs) < 3 * len(similar) + 20


def test_full_groups_are_not_cut():
    same = np.arange(16, dtype=np.uint64) << np.uint64(8)
    vector = count_tree.unpacked_vectors([count_tree.count_vector(same)])[0]
    assert vector.sum() == 16 and vector.max() <= 15


def random_model(seed=3):
    rng = np.random.default_rng(seed)
    pairs = rng.integers(0, 4, (lm.N_CODES + 1, lm.N_CODES))
    code_class, code_member = lm.classes(pairs)
    return lm.Model(code_class, code_member, *lm.biases(pairs, code_class, code_member), lm.new_weights(seed))


def test_model_is_a_distribution_and_causal():
    model = random_model()
    text = np.random.default_rng(1).integers(0, lm.N_CODES, 37)
    before, targets, owner = lm.blocks([text, text[:0], text[:5]])
    assert owner.tolist() == [0, 0, 0, 2] and (targets >= 0).sum() == 42
    assert targets[:3].ravel()[:37].tolist() == text.tolist()
    log_p = lm.log_probabilities(model, before, targets)
    assert (log_p[targets < 0] == 0).all() and (log_p[targets >= 0] < 0).all()
    # All codes at one position sum to one.
    many = np.repeat(before[1:2], lm.N_CODES, axis=0)
    tried = np.full((lm.N_CODES, lm.BLOCK), -1)
    tried[:, 6] = np.arange(lm.N_CODES)
    assert np.exp(lm.log_probabilities(model, many, tried)[:, 6]).sum() == pytest.approx(1, abs=1e-4)
    # Later codes do not matter to earlier ones, and batches do not matter at all.
    changed = text.copy()
    changed[20:] = (changed[20:] + 1) % lm.N_CODES
    other = lm.log_probabilities(model, *lm.blocks([changed])[:2]).ravel()[:20]
    assert np.allclose(other, log_p[:3].ravel()[:20], atol=1e-5)


def test_gradients_match_differences():
    model = random_model()
    rng = np.random.default_rng(2)
    before, targets, _ = lm.blocks([rng.integers(0, lm.N_CODES, n) for n in (40, 9)])
    weights = {name: x.astype(np.float64) for name, x in model.weights.items()}
    exact = lm_scoring.model_with(model, weights)
    g, loss = lm.gradients(exact, before, targets)
    assert loss == pytest.approx(-lm.log_probabilities(exact, before, targets).sum() / (targets >= 0).sum(), rel=1e-4)
    for name in lm.LEARNED:
        place = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        kept = weights[name][place]
        sides = []
        for step in (1e-5, -1e-5):
            weights[name][place] = kept + step
            sides.append(lm.gradients(exact, before, targets)[1])
        weights[name][place] = kept
        assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(g[name][place], rel=2e-2, abs=1e-6)


def test_training_uses_every_block(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 1000, n).astype("<u2") for n in (0, 5, 16, 700_000, 40, 300_000)]
    code = np.append(np.arange(1000), 1000)
    seen = []
    monkeypatch.setattr(lm, "gradients", lambda model, before, targets: (seen.append((before, targets)), ({}, 0.0))[1])
    batch = pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in texts])], ["ids"])
    steps, _ = lm_scoring._train_task(iter([batch]), random_model(), code, 0)
    want = np.concatenate(lm.blocks([np.append(t, 1000) for t in texts])[:2], axis=1)
    got = np.concatenate([np.concatenate(x) for x in zip(*seen)], axis=1)
    assert steps == len(seen) == -(-len(want) // lm_scoring.BATCH_BLOCKS) > 900
    assert sorted(map(bytes, got)) == sorted(map(bytes, want))


def test_every_id_has_context(spark):
    """Beyond the commonest ids too, an id depends on those before it; all ids have a probability."""
    n_ids = 5000
    rng = np.random.default_rng(6)
    order = rng.permutation(4000)
    texts = [np.repeat(order[i : i + 20], 2) for i in range(0, 4000, 20)] * 3
    ids = spark.createDataFrame([(t.astype("<u2").tobytes(),) for t in texts], "ids binary")
    counts, weights, code = lm_scoring.train(ids, n_ids)
    assert sorted(code) == list(range(n_ids + 1))
    model = counts.model(weights)
    assert len({*zip(counts.code_class.tolist(), counts.code_member.tolist())}) == n_ids + 1
    start = np.array([code[order[-40]], code[order[-40]]])
    before, targets, _ = lm.blocks([start], n_ids + 1)
    many, tried = np.repeat(before, n_ids + 1, axis=0), np.full((n_ids + 1, lm.BLOCK), -1)
    tried[:, 1] = np.arange(n_ids + 1)
    p = np.exp(lm.log_probabilities(model, many, tried)[:, 1].astype(np.float64))
    assert p.sum() == pytest.approx(1, abs=1e-3) and p.min() > 0
    rarest = [i for i in order.tolist() if code[i] > 3000][:50]
    after = lambda a, b: lm.log_probabilities(model, *lm.blocks([code[[a, b]]], n_ids + 1)[:2])[0, 1]
    own, other = (np.mean([after(a, b) for a, b in zip(x, rarest)]) for x in (rarest, rarest[7:] + rarest[:7]))
    assert own > other + 0.5


def test_lm_scoring(spark, docs, rows, empty):
    got = lm_scoring.score_documents(docs).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    learned = [words(text) for i, text, *_ in rows if not held(i)]
    counts = Counter(w for ws in learned for w in ws)
    n, v = sum(counts.values()) + len(learned), len(counts) + 1
    want = []
    for i, text, *_ in rows:
        c = [counts[w] for w in words(text)] + [len(learned)]
        base = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c)
        want.append((str(i), held(i), len(c), sum(x > 0 for x in c), n, round(base, 6)))
    assert sorted(want) == sorted(
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got
    )
    assert all(r.score < 0 for r in got)
    assert lm_scoring.score_documents(empty).count() == 0
    alone = spark.createDataFrame([(None, "only held out")], "doc_id long, text string")
    row = lm_scoring.score_documents(alone).first()
    assert row.held_out and row.train_tokens == 0 and row.n_known == 0 and row.score < 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = queries.quality_model(spark, SF_DIR, docs)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = save_scratch(stage(spark, docs, SF_DIR))
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns and set(after) <= set(before)
        if name == "quality_classifier":
            assert 0 < len(after) < len(before) and model.rules
        if name == "exact_dedup":
            best = {}
            for r in before:
                best[r.text] = max(best.get(r.text, -1), r.doc_id)
            assert {(r.text, r.doc_id) for r in after} == set(best.items()) and len(after) == len(best)
        if name == "ngram_jaccard_join":
            kept = {i for i, _, c in components([(r.doc_id, r.text) for r in before]) if i == c}
            assert {str(r.doc_id) for r in after} == kept
        if name == "packing":
            whole = packing.pack(spark.createDataFrame(before), with_ids=False).count()
            assert len(after) == whole and sum(r.length for r in after if r.start == 0) > 0
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
    assert corpus_pipeline.run(spark, SF_DIR).count() == len(after)


def test_bounds_fold_a_few_vectors_at_a_time():
    rng = np.random.default_rng(5)
    vectors = [rng.integers(0, 16, size, np.uint8) for size in [4096] * 500 + [16384] * 500]
    a, b = rng.integers(0, 500, 3000), rng.integers(500, 1000, 3000)
    tracemalloc.start()
    found = count_tree.bounds(vectors, a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20
    for i in range(0, 3000, 300):
        assert found[i] == np.minimum(vectors[a[i]], vectors[b[i]].reshape(-1, 4096).sum(axis=0)).sum()
