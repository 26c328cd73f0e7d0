"""Suffix-array dedup, tokenizer alignment and ranked search against plain versions of the same."""

import gc
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from strandweave.llm import ranked_search, subwords, suffix_dedup, tokenizer_alignment

# ---- suffix arrays -----------------------------------------------------------------------


def covered(texts, length):
    """Removed spans of each text, by a table of all strings of that length."""
    found = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if found[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        out.append([m.span() for m in re.finditer(b"\1+", bytes(mark))])
    return out


def expected_rows(texts, length):
    rows = []
    for t, spans in zip(texts, covered(texts, length), strict=True):
        kept = bytearray(t)
        for a, b in reversed(spans):
            del kept[a:b]
        rows.append((len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest(), bytes(kept)))
    return rows


def awkward_texts(seed):
    draw = random.Random(seed)
    letters = lambda n, kinds="abcd": "".join(draw.choices(kinds, k=n))
    passage, line = letters(90), letters(45)
    texts = [letters(draw.randint(0, 200)) for _ in range(30)]
    texts += [letters(draw.randint(0, 60)) + passage + letters(draw.randint(0, 60)) for _ in range(25)]
    texts += [letters(30) + line + letters(30) + line for _ in range(6)]
    texts += ["a" * 300, "a" * 70, "ab" * 100, "abc" * 60, "é𝒳" * 40, "x\0y" * 30, "\0" * 100, "\0" * 50 + letters(60), ""]
    texts += [texts[3]] * 3 + [texts[40]] * 2 + [texts[40][:-1] + "z", "q" + texts[41]]
    return texts


@pytest.mark.parametrize(
    "length,sizes", [(40, {}), (40, {"split_bytes": 100, "shard_bytes": 2000}), (7, {"split_bytes": 50, "shard_bytes": 500})]
)
def test_repeats(spark, monkeypatch, length, sizes):
    monkeypatch.setattr(suffix_dedup, "MERGE_STRINGS", 300)
    monkeypatch.setattr(suffix_dedup, "ROW_STARTS", 64)
    texts = awkward_texts(length)
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)] + [(None, None, "n")], "id long, text string, spans string")
    got = suffix_dedup.remove_repeats(docs.repartition(5), length=length, **sizes)
    assert got.columns == ["id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    rows = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got.collect()}
    want = expected_rows([t.encode() for t in texts], length)
    assert rows.pop(None) == (0, 0, 0, hashlib.sha256(b"").hexdigest(), b"")
    assert [rows[i] for i in range(len(texts))] == want


def test_repeats_of_long_texts(spark, monkeypatch):
    """Texts hashed in parts, and whole documents as they come."""
    monkeypatch.setattr(suffix_dedup, "HASH_BYTES", 1000)
    draw = random.Random(5)
    passage = "".join(draw.choices("abcdefgh", k=900))
    long = ["".join(draw.choices("abcdefgh", k=9000)) for _ in range(3)]
    texts = [long[0][:4100] + passage + long[0][4100:], passage + long[1], long[2] + passage[:399], long[2][3000:6000] + "end", passage]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    rows = suffix_dedup.mark_repeats(docs, columns=["id"]).orderBy("id").collect()
    want = expected_rows([t.encode() for t in texts], 400)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == [w[:4] for w in want]


def test_repeats_of_documents(docs, rows, empty):
    got = suffix_dedup.mark_repeats(docs, length=50, columns=["doc_id"])
    want = expected_rows([(row[1] or "").encode() for row in rows], 50)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == Counter(
        (row[0], *w[:4]) for row, w in zip(rows, want, strict=True)
    )
    assert suffix_dedup.mark_repeats(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array(seed):
    draw = np.random.default_rng(seed)
    sizes = draw.integers(1, 60, 20)
    data = draw.integers(0, 2, sizes.sum()).astype(np.uint8) * (seed + 1)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    left = np.repeat(offsets[1:], sizes) - np.arange(len(data))
    suffixes = [bytes(data[i : i + n]) for i, n in enumerate(left)]
    order, rank, seven = suffix_dedup.suffix_array(data, left, 25)
    assert [suffixes[i][:25] for i in order] == sorted(x[:25] for x in suffixes)
    at, before, common = suffix_dedup.common_prefixes(order, rank, seven, left, offsets[:-1], offsets[1:], 25)
    assert sorted(at.tolist()) == list(range(len(data)))

    def shared(a, b):
        return next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    for i, j, n in zip(at, before, common, strict=True):
        assert n == (min(shared(suffixes[i], suffixes[j]), 25) if j >= 0 else 0)


# ---- tokenizer alignment -----------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(subwords.vocabulary_path(tokenizer_alignment.BYTE_VOCABULARY))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=subwords.vocabulary_path(tokenizer_alignment.PIECE_MODEL))


def plain_tokens(tokenizers, text):
    """Ids and bytes of both tokenizers over whole texts, or none."""
    a, b = tokenizers
    if not text:
        return [], []
    whole = (" " + text).encode()
    letters = tokenizer_alignment._byte_letters()
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
        return [], []
    return left, right


def plain_alignment(tokenizers, texts):
    documents = []
    for text in texts:
        left, right = plain_tokens(tokenizers, text)
        ends_a, ends_b = (np.cumsum([len(x) for _, x in side]).tolist() for side in (left, right))
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in cuts]
        for side, (tokens, ends) in enumerate(((left, ends_a), (right, ends_b))):
            for (i, _), end in zip(tokens, ends, strict=True):
                groups[int(np.searchsorted(cuts, end))][side].append(i)
        documents.append((len(left), len(right), groups, [(x, y) for g, h in groups for x in g for y in h]))
    counts = Counter(pair for *_, links in documents for pair in set(links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for n_a, n_b, groups, links in documents:
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append(
            (
                n_a,
                n_b,
                len(groups),
                len(links),
                sum(counts[x, y] == best[x] for x, y in links),
                sum(counts[link] for link in links),
                hashlib.sha256(shown.encode()).hexdigest() if shown else "",
            )
        )
    return out


TRICKY = [
    "a  b\n c", "½ ﬁ é x", "▁x in it", "日本語 \x00 y", "<s> </s> <unk> <|endoftext|>", "\n\nfoo", " lead", "trail ", "trail\n", "<0x0A>",
    "tab\tx y z", "𝒳𝒴 naïve 𝒳x", " ", "\n", "  \n  x", "don't it's\n\n 'quoted'", "x" * 300, "é" * 100, "á é", "1234567 89,000.5",
    "\x1c a\x1f b", "....... !!! ---\n---", "퟿\U0010ffff", "a\r\n b\r\n\r\n c",
]


@pytest.mark.parametrize("block_pairs", [2_000_000, 40])
def test_alignment(spark, tokenizers, rows, empty, block_pairs):
    texts = [row[1] for row in rows] + TRICKY + [TRICKY[0]]
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, pairs string")
    got = tokenizer_alignment.tokenizer_links(docs.repartition(3), block_pairs=block_pairs)
    found = {r[0]: tuple(r)[1:] for r in got.collect()}
    assert [found[i] for i in range(len(texts))] == plain_alignment(tokenizers, texts)
    assert tokenizer_alignment.tokenizer_links(empty).count() == 0


def test_alignment_of_ids(docs, rows):
    got = tokenizer_alignment.tokenizer_links(docs)
    assert Counter(r.id for r in got.collect()) == Counter(row[0] for row in rows)


def test_aligner_keeps_units_that_recur(monkeypatch):
    monkeypatch.setattr(tokenizer_alignment, "REMEMBERED", 8)
    aligner = tokenizer_alignment.Aligner(subwords.vocabulary_path(tokenizer_alignment.BYTE_VOCABULARY), subwords.vocabulary_path(tokenizer_alignment.PIECE_MODEL))
    for i in range(6):
        units = [" the", " of", *[f" x{i}y{j}" for j in range(4)]]
        known = aligner.known(units)
        whole = aligner.align(units)
        assert known.shown.to_pylist() == whole.shown.to_pylist() and known.codes.tolist() == whole.codes.tolist()
        assert {" the", " of"} <= set(aligner.place) and len(aligner.place) <= 8 + len(units)
        assert len(aligner.units.fine) == len(aligner.again) == len(aligner.place)


def test_rows_are_linked_a_few_megabytes_at_a_time(spark, monkeypatch):
    pairs = list(range(20_000))
    rows = spark.createDataFrame([(i, pairs, [1] * len(pairs), 0, 0) for i in range(300)], "id long, pairs array<long>, times array<long>, n_best long, count_sum long").coalesce(1)
    block = spark.sparkContext.broadcast((np.arange(20_000), np.full(20_000, 2), np.ones(20_000, bool)))
    sizes = tokenizer_alignment._add_counts(rows, block).mapInArrow(lambda batches: (b.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    found = [r.n for r in sizes.collect()]
    # 300 rows have 96 MB here.
    assert sum(found) == 300 and max(found) < 300
    assert {tuple(r)[3:] for r in tokenizer_alignment._add_counts(rows, block).collect()} == {(20_000, 40_000)}


def test_aligner_stops_collection_while_it_encodes(monkeypatch):
    aligner = tokenizer_alignment.Aligner(subwords.vocabulary_path(tokenizer_alignment.BYTE_VOCABULARY), subwords.vocabulary_path(tokenizer_alignment.PIECE_MODEL))
    seen, plain = [], aligner._a_tokens
    monkeypatch.setattr(aligner, "_a_tokens", lambda *args: seen.append(gc.isenabled()) or plain(*args))
    assert aligner.align([" some", " words"]).fine.all() and seen == [False] and gc.isenabled()


# ---- ranked search -----------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(texts, items, top):
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in texts]
    sizes = [sum(c.values()) for _, c in held]
    n_docs, n_words = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(LOWER)))
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms}
        scored = []
        for (i, c), n in zip(held, sizes, strict=True):
            m = 50 + (50 * n * n_docs) // n_words
            score = sum(w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weights.items() if t in c)
            if score > 0:
                scored.append((-score, -1 if i is None else i, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(scored, key=lambda x: x[:2])[:top], 1)]
    return out


@pytest.mark.parametrize("top,block_bytes,cells", [(50, 8 << 20, 12_000_000), (3, 300, 500), (1000, 8 << 20, 3000)])
def test_search(spark, docs, rows, empty, monkeypatch, top, block_bytes, cells):
    monkeypatch.setattr(ranked_search, "SEGMENT_CELLS", cells)
    monkeypatch.setattr(ranked_search, "FIRST_LOOK", 4)
    words = [(row[1] or "").split() for row in rows]
    items = [(n, " ".join(words[n][:30] + words[-n - 3][:40]).upper() if n % 4 else " ".join(words[n])) for n in range(18)]
    items += [(50, None), (51, ""), (52, "!?"), (53, "nowhereatall"), (54, "É é ONE two-one"), (54, "É é ONE two-one"), (None, "the in")]
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id int, text string, score int")
    got = ranked_search.search(docs, asked, top=top, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = plain_search([(row[0], row[1]) for row in rows], items, top)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert ranked_search.search(empty, asked).count() == 0
    assert ranked_search.search(docs, asked.limit(0)).count() == 0
