"""Secret scan, fingerprints, url filter and quality rules against plain Python."""

import hashlib
import random
import re
import string
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.llm import fingerprints, quality_rules, secret_scan, url_filter
from strandweave.llm.components import connected_components

from .conftest import WORDS, sentence

PATTERNS = [
    ("assign", re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 12),
    ("access", re.compile(r"(AKIA[A-Z0-9]+)"), 18),
    ("hex", re.compile(r"([0-9a-f]+)"), 16),
]


def base(text):
    found = [
        (m.start(), kind, m.end())
        for kind, (_, pattern, n) in enumerate(PATTERNS)
        for m in pattern.finditer(text or "")
        if len(m.group(1)) >= n
    ]
    return ",".join(f"{PATTERNS[kind][0]}:{a}:{b}" for a, kind, b in sorted(found))


def random_text(rng, n, letters=string.ascii_letters + string.digits):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.fixture(scope="module")
def secrets(spark):
    rng = random.Random(4)
    texts = [f"{sentence(i, 30)} password: {random_text(rng, 20)} {sentence(i + 1, 5)}" for i in range(60)]
    texts += [f"𝒳é {sentence(i, 9)} key {random_text(rng, 40)} thereafter" for i in range(10)]
    # Many different ordinary words, so that the few unknown keys are no large part of what is learned as ordinary.
    texts += [" ".join("".join(rng.choice(WORDS) for _ in range(4)) for _ in range(300)) for _ in range(10)]
    texts += ["secret: token: abcdefghijklmnop", "API_KEY='abc' passwd=token=abcdefghijkl", "AKIA" + "A" * 14, "AKIA" + "A" * 13]
    texts += ["0123456789abcdef" * 40 + "g" + "f" * 15, "x" * 20000 + " token = " + "b" * 30, None, "", "internationalisations" * 2]
    texts += ["deadbeefdeadbeef password=deadbeefdeadbeef"] * 2
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")


def test_secret_scan(secrets, empty):
    models = secret_scan.train(secrets)
    got = secret_scan.scan(secrets, models).collect()
    for row in got:
        want = base(row.text)
        assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (row.text[:200], row.spans, want)
        assert [row.n_assign, row.n_access, row.n_hex] == [want.count(kind) for kind in ("assign", "access", "hex")]
        spans = row.spans.split(",") if row.spans else []
        assert [s for s in spans if not s.startswith("markov")] == (want.split(",") if want else [])
        starts = [int(s.split(":")[1]) for s in spans]
        assert starts == sorted(starts)
    # The random keys that no pattern knows are found, whole, and prose is left alone.
    for row in got:
        held = [row.text[int(a) : int(b)] for k, a, b in (s.split(":") for s in row.spans.split(",") if s) if k == "markov"]
        assert row.n_markov == len(held)
        if row.text and " key " in row.text:
            assert held == [row.text.split(" key ")[1].split()[0]]
        elif row.text and row.text.startswith(sentence(row.doc_id, 30)):
            assert not held
    assert secret_scan.scan(empty, secret_scan.train(empty)).count() == 0


def test_markov_ratio(spark):
    samples = spark.createDataFrame(
        [(True, "x7Qz9", 1), (True, "9zK2q", 2), (False, "banana", 5), (False, "bandana", 1)], "random boolean, value string, n long"
    )
    models = secret_scan.learn(samples)
    width = len(secret_scan.ALPHABET) + 1
    number = lambda c: secret_scan.ALPHABET.find(c) + 1

    def log_p(values, value):
        seen = [(number(a), number(b)) for v in values for a, b in zip(" " + v, v)]
        total = 0.0
        for a, b in zip(" " + value, value):
            anywhere = (sum(y == number(b) for _, y in seen) + secret_scan.PRIOR_EACH) / (len(seen) + secret_scan.PRIOR_EACH * width)
            after = sum(x == number(a) for x, _ in seen)
            total += np.log((seen.count((number(a), number(b))) + secret_scan.PRIOR * anywhere) / (after + secret_scan.PRIOR))
        return total

    value = "banX7"
    got = spark.range(1).select(models.ratio(F.lit(value)).alias("r")).first().r
    assert got == pytest.approx(log_p(["x7Qz9", "9zK2q"], value) - log_p(["banana", "bandana"], value))


def plain_leaves(text):
    """Leaves by plain Python: sections, their paragraphs, sentences, up to five words with the spaces around them."""
    leaves = []
    for section in re.split("(?<=\n\n)(?=[^\n \t\r])", text):
        for paragraph in re.split("(?<=\n)", section):
            for sentence_ in re.split("(?<=[.!?;][ \t])(?=[^ \t])", paragraph):
                words = re.findall(r"\s*\S+\s*", sentence_, re.ASCII)
                leaves += ["".join(words[i : i + 5]) for i in range(0, len(words), 5)] or [sentence_]
    return leaves


def shared_leaves(one, other):
    a, b = Counter(plain_leaves(one)), Counter(plain_leaves(other))
    return (a & b).total() / max(a.total(), b.total())


def test_fingerprints(docs, rows, empty):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    texts = [r[1] or "" for r in order]
    want = []
    for i, text in enumerate(texts):
        other, n = texts[(i + 1) % len(texts)], len(text) // 4
        edited = text[: len(text) - n] + other[:n]
        near = [shared_leaves(text, edited), shared_leaves(text, other)]
        want.append((order[i][0], len(text), hashlib.sha256(edited.encode()).hexdigest(), *near, text == edited))
    got = fingerprints.compare_with_next(docs).collect()
    found = [
        (r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.fingerprint == r.edited_fingerprint) for r in got
    ]
    assert sorted(map(str, found)) == sorted(map(str, want))
    assert all((r.edit_section is None) == (r.fingerprint == r.edited_fingerprint) for r in got)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.compare_with_next(empty).count() == 0


def test_trees_lose_nothing_and_locate_edits(spark, docs):
    text = "One two. Three four five six seven!\nSecond line here.\n\n \nNew section. " + sentence(1, 60) + "\nlast"
    changed = text.replace("Second line", "Other line")
    frame = spark.createDataFrame([(text, changed), ("a\n\nb", "a\n\n\nb"), ("a b", "a  b"), ("", " ")], "a string, b string")
    got = frame.select(
        fingerprints.root(fingerprints.tree(F.col("a"))).alias("ra"),
        fingerprints.root(fingerprints.tree(F.col("b"))).alias("rb"),
        fingerprints.likeness(fingerprints.tree(F.col("a")), fingerprints.tree(F.col("b"))).alias("near"),
        fingerprints.differing_paragraphs(fingerprints.tree(F.col("a")), fingerprints.tree(F.col("b"))).alias("where"),
    ).collect()
    assert all(r.ra != r.rb for r in got)
    assert 0.8 < got[0].near < 1 and [tuple(w) for w in got[0]["where"]] == [(0, 1)]
    marked = fingerprints.fingerprints(docs).select("text", "fingerprint").distinct().collect()
    assert len({r.fingerprint for r in marked}) == len({r.text or "" for r in marked})


def test_order_over_many_buckets(spark):
    docs = spark.range(5000).selectExpr("(id * 7919) % 5003 * 1000 - 90 AS doc_id", "concat('t', id) AS text")
    got = {r.text: r.next_text for r in fingerprints.with_next(docs).collect()}
    order = [r.text for r in docs.orderBy("doc_id").collect()]
    assert got == dict(zip(order, order[1:] + order[:1]))


PAGES = [
    (0, "http://a.example.com/de/1", ""),
    (1, "https://www.a.example.com/de/1/?utm_source=x#top", ""),
    (2, "https://other.org/x", '<link rel="canonical" href="http://bad.net/1">'),
    (3, "https://third.org/y", "<LINK href='https://other.org/x' rel=canonical>"),
    (4, "https://fourth.org/z", '<meta http-equiv="refresh" content="0; url=/fr/ok">'),
    (5, "https://fourth.org/fr/ok", ""),
    (6, "HTTP://X.EXAMPLE.NET/en/?a=1", ""),
    (7, "https://net", None),
    (8, None, '<link rel="canonical" href="http://bad.net/1">'),
    (9, "no scheme", ""),
    (10, "", ""),
    (11, "https://fifth.org/q", '<link rel="canonical" href="http://bad.net/2"><meta http-equiv=refresh content="1;url=https://fourth.org/fr/ok">'),
    (12, "https://other.org/x", ""),
    (None, "https://bad.net/1", ""),
]
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def test_url_filter(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, verdict string")
    rules = [url_filter.parse_rule(*rule) for rule in RULES]
    got = {r.page_id: r for r in url_filter.judge(pages, rules).collect()}
    assert len(got) == len(PAGES)
    assert [(got[0].host, got[0].path, got[0].rule, got[0].verdict)] == [("a.example.com", "/de/1", "example.com/de/", "block")]
    assert got[6].host == "x.example.net" and got[6].path == "/en/" and got[6].rule == "example.net/en/"
    assert (got[7].host, got[7].path, got[7].rule) == ("net", "", None)
    for i in (8, 9, 10):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == ("", "", None, "allow")
    # Aliases of a blocked page are blocked; of a component that also holds an allowed page, allowed.
    assert [got[i].verdict for i in (2, 3, 12)] == ["block"] * 3 and got[2].component == got[3].component
    assert (got[5].rule, got[4].verdict) == ("org/fr/", "allow")
    assert got[11].rule is None and got[11].verdict == "allow"
    moved = spark.createDataFrame([("https://fifth.org/q", "no scheme")], "x string, y string")
    again = {r.page_id: r.verdict for r in url_filter.judge(pages, rules, redirects=moved).collect()}
    assert again[9] == "allow"
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_url_targets_in_other_spellings(spark):
    pages = [
        (0, "https://a.org/1", '<link rel=canonical href="http://mid.org/p?x=1&amp;y=2">'),
        (1, "https://b.org/1", '<meta http-equiv=refresh content="0; url=http://mid.org/p?x=1&#38;y=2&#x26;ref=q#top">'),
        (2, "https://www.mid.org/p?x=1&y=2", '<link rel="canonical" href="http://bad.net/1">'),
        (3, "https://c.org/1", ""),
        (4, "https://d.org/1", '<link rel=canonical href="http://mid.org/p?x=1&amp;amp;y=2">'),
    ]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string")
    moved = spark.createDataFrame([("https://c.org/1", "http://mid.org/p?x=1&y=2")], "x string, y string")
    got = {r.page_id: r.verdict for r in url_filter.judge(docs, [url_filter.parse_rule("bad.net/", "block")], redirects=moved).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "block", 4: "allow"}


def test_url_spellings_need_no_rounds(spark, monkeypatch):
    pages = [(i, f"http{'s' * (i % 2)}://www.site{i // 4}.org/{i // 2 % 2}#{i}", "") for i in range(40)]
    pages += [(40, "address:site1.org/0", ""), (41, "no host", ""), (42, "other", ""), (43, "", ""), (44, None, "")]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string")
    given = []
    monkeypatch.setattr(url_filter, "connected_components", lambda edges: given.append(edges.filter("a <> b").count()) or connected_components(edges))
    rules = [url_filter.parse_rule("moved.org/", "block"), url_filter.parse_rule("www.site2.org/1", "block")]
    got = {r.page_id: (r.component, r.verdict) for r in url_filter.judge(docs.limit(40), rules).collect()}
    assert [got[i] for i in range(40)] == [(f"address:site{i // 4}.org/{i // 2 % 2}", "block" if i // 2 == 5 else "allow") for i in range(40)]
    # Urls without a host share one spelling, which is not their address; a page's url may look like a spelling.
    moved = spark.createDataFrame([("https://a.net/", "http://site0.org/0"), ("https://site0.org/1", "http://moved.org/")], "x string, y string")
    got = {r.page_id: (r.component, r.verdict) for r in url_filter.judge(docs, rules, redirects=moved).collect()}
    assert [got[i] for i in (0, 1)] == [("address:a.net", "allow")] * 2 and [got[i] for i in (2, 3)] == [("address:moved.org", "block")] * 2
    assert {got[i] for i in (4, 5, 40, 41, 42, 43)} == {("", "allow")}
    # Only links between different addresses take rounds: three urls without a host, a page like a spelling, two redirects.
    assert given == [0, 6]


@pytest.mark.parametrize("seed", [1, 2])
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(0, 300) if i % 50] + [(1000, 1000 + i) for i in range(1, 400)] + [(7, 7), (None, 3)]
    edges += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    parent: dict[int, int] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_quality_rules(spark, docs, empty):
    good = [(i, sentence(i, 50 + i % 30), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in sentence(i, 40).split()), 0) for i in range(150)]
    bad += [(2000 + i, " ".join([sentence(i, 1)] * 60), 0) for i in range(150)]
    frame = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    labels = frame.select("doc_id", "quality").filter(~quality_rules.held_out(F.col("doc_id")))
    model = quality_rules.train(frame.drop("quality"), labels)
    assert 0 < len(model.rules) <= 60
    scored = quality_rules.score(frame, model)
    wrong = scored.filter(quality_rules.held_out(F.col("doc_id"))).filter("predicted <> quality")
    assert wrong.count() == 0
    got = quality_rules.score(docs, model)
    assert got.count() == docs.count() and got.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert got.columns == [c for c in docs.columns if c != "score"] + ["score", "predicted"]
    assert quality_rules.score(empty, model).count() == 0
    # Nothing to learn from, or one label only.
    none = quality_rules.train(docs, labels.limit(0))
    assert none.rules == [] and quality_rules.score(docs, none).first().score == pytest.approx(0.5)
    assert quality_rules.train(frame, labels.filter("quality = 1")).rules == []


def plain_statistics(text):
    """The statistics by plain Python."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text.lower()) if w]
    per = lambda n, of: n / of if of else 0.0
    chars = lambda among: per(sum(c in among for c in text), len(text))
    return {
        "log_words": np.log1p(len(words)),
        "mean_word": per(sum(map(len, words)), len(words)),
        "upper_share": per(sum(unicodedata.category(c) == "Lu" for c in text), len(text)),
        "symbol_share": chars("#%&$*|<>{}[]~^_=+@\\"),
        "shout_share": chars("!?"),
        "digit_share": chars("0123456789"),
        "stop_share": chars(".,;:"),
        "line_share": chars("\n"),
        "distinct_share": per(len(set(words)), len(words)),
        "again_share": per(sum(a == b for a, b in zip(words, words[1:])), len(words)),
        "short_share": per(sum(len(w) <= 3 for w in words), len(words)),
    }


def test_statistics_and_score_by_plain_python(spark, rows):
    texts = {r[1] or "" for r in rows} | {"a A b [x]\\y!? 12,3;\n\tZ z", "  lead", "É É é 𝕏𝕏 _#@ ~^", "\x0b\x0c\r", " ".join("ab" * 9) * 400}
    docs = spark.createDataFrame([(t,) for t in sorted(texts)], "text string")
    rules = [
        (quality_rules.Rule((("log_words", True, 2.0), ("mean_word", False, 5.0))), 1.5),
        (quality_rules.Rule((("again_share", True, 0.1),)), -2.0),
        (quality_rules.Rule((("short_share", True, 0.3), ("symbol_share", False, 0.02))), 0.75),
    ]
    model = quality_rules.RuleEnsemble(-0.25, rules)
    scores = {r.text: r.score for r in quality_rules.score(docs, model).collect()}
    assert scores.keys() == texts
    for row in quality_rules.measured(docs, F.col("text")).collect():
        want = plain_statistics(row.text)
        assert {name: row[name] for name in want} == pytest.approx(want)
        holds = lambda rule: all((want[n] > limit) == above for n, above, limit in rule.conditions)
        margin = -0.25 + sum(weight for rule, weight in rules if holds(rule))
        assert scores[row.text] == pytest.approx(1 / (1 + np.exp(-margin)))


def test_lasso_finds_the_rule():
    rng = np.random.default_rng(3)
    columns = {"x": rng.random(800), "y": rng.random(800), "z": rng.random(800)}
    labels = ((columns["x"] > 0.5) & (columns["y"] <= 0.3)).astype(float)
    model = quality_rules.fit(columns, labels)
    total = model.bias + sum(w * rule.holds(columns) for rule, w in model.rules)
    assert ((total > 0) == labels).mean() > 0.98
    assert {name for rule, _ in model.rules for name, _, _ in rule.conditions} <= {"x", "y", "z"}
