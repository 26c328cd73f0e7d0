r"""Secret scan in DataFrame operations only: patterns, and Markov models for what patterns miss.

Three patterns find the known forms. For the rest two first-order character models are learned, one
of random strings (the values that the patterns found) and one of ordinary identifiers (long runs
of the same letters outside of them). A run is a secret if it is long, mixes kinds of characters and the
log-likelihood ratio of the two models speaks clearly for a random string.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import packed, text_of, unpacked
from strandweave.session import save_scratch

# The base patterns and the shortest part of a match that counts.
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{14,})"
HEX = r"([0-9a-f]{16,})"
KINDS = (("assign", ASSIGN, 12), ("access", ACCESS, 18), ("hex", HEX, 16))

#: Characters that the models know; all others are outside of runs.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="
RUN = r"(?<![A-Za-z0-9+/_=])([A-Za-z0-9+/_=]{%d,})"
#: Runs from which ordinary identifiers are learned, and runs that are judged, have so many characters.
LEARNED_FROM, JUDGED_FROM = 8, 16
#: Pseudo-counts after each character, shared by how common the next one is; and of each single character.
PRIOR, PRIOR_EACH = 30.0, 1.0
#: The least log-likelihood ratio (natural logarithm) of a secret, in all and for each character.
LEAST_RATIO, LEAST_EACH = 12.0, 0.75
FOUND = "markov"
SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"
OWN = ("n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans")


def matches(text: Column, pattern: str, kind: int) -> Column:
    r"""Leftmost non-overlapping matches as an array of ``(start, kind, end, value)``.

    ``pattern`` has one group, the value. Positions are code points. Each match is taken together with
    the text before it (``\G`` keeps them side by side), so the lengths add up to positions.
    """
    whole = f"(?s)\\G(.*?)({pattern})"
    part = lambda group: F.regexp_extract_all(text, F.lit(whole), F.lit(group))
    zipped = F.arrays_zip(part(1).alias("gap"), part(2).alias("match"), part(3).alias("value"))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("found"))

    def add(state: Column, one: Column) -> Column:
        start = state["at"] + F.length(one["gap"])
        end = start + F.length(one["match"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), one["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    return F.when(text.rlike(pattern), F.aggregate(zipped, empty, add)["found"]).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """The spans of all base patterns, by start and then kind."""
    long_enough = lambda n: lambda span: F.length(span["value"]) >= n
    found = [F.filter(matches(text, pattern, kind), long_enough(n)) for kind, (_, pattern, n) in enumerate(KINDS)]
    return F.array_sort(F.concat(*found))


def outside(spans: Column, base: Column) -> Column:
    """Spans that share no character with a base span."""
    return F.filter(
        spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def labelled_samples(found: DataFrame) -> DataFrame:
    """``(random, value, n)`` of the text runs to learn from, each text once with its count.

    Values of base spans are samples of random strings; runs outside of base spans are ordinary, except for
    those that are to be judged themselves.
    """
    runs = F.regexp_extract_all("rest", F.lit(RUN % LEARNED_FROM), F.lit(1))
    judged = lambda v: _mixed(v) & (F.length(v) >= JUDGED_FROM)
    as_sample = lambda random: lambda v: F.struct(F.lit(random).alias("random"), v.alias("value"))
    ordinary = F.transform(F.filter(runs, lambda v: ~judged(v)), as_sample(False))
    random = F.transform(F.col("base.value"), as_sample(True))
    samples = found.select(F.inline(F.concat(ordinary, random)))
    return samples.groupBy("random", "value").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(samples: DataFrame) -> DataFrame:
    """``(random, pair, n)``: how many different samples have two characters in a row; pair numbers the two.

    Each sample counts once however often it is copied. Characters outside of the alphabet have number 0.
    """
    width = len(ALPHABET) + 1
    places = samples.select("random", "value", F.explode(F.sequence(F.lit(1), F.length("value"))).alias("i"))
    at = lambda i: F.expr(f"locate(substring(value, {i}, 1), '{ALPHABET}')")
    before = F.when(F.col("i") > 1, at("i - 1")).otherwise(0)
    return places.groupBy("random", (before * width + at("i")).alias("pair")).agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class MarkovModels:
    """Log-likelihood ratios of each pair of characters, by its number."""

    ratios: list[float]

    def ratio(self, value: Column) -> Column:
        """The log-likelihood ratio of a run: above 0 it is likelier random."""
        width = len(ALPHABET) + 1
        table = F.split(F.lit(",".join(map(repr, self.ratios))), ",").cast("array<double>")
        chars = F.transform(F.split(value, ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))
        start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
        walked = F.aggregate(
            chars,
            start,
            lambda s, c: F.struct(c.alias("last"), (s["sum"] + F.get(table, s["last"] * width + c)).alias("sum")),
        )
        return walked["sum"]


def learn(samples: DataFrame) -> MarkovModels:
    """Fit both models; with no samples of a kind its model is even over all characters.

    A character's probability after another leans on its probability after any.
    """
    width = len(ALPHABET) + 1
    # A row for each pair of characters and kind; kept, as several sums are made of them.
    counts = save_scratch(pair_counts(samples))
    grid = samples.sparkSession.range(width * width).select(F.col("id").cast("int").alias("pair"))
    both = counts.groupBy("pair").agg(
        F.sum(F.when(F.col("random"), F.col("n")).otherwise(0)).alias("n_random"),
        F.sum(F.when(F.col("random"), 0).otherwise(F.col("n"))).alias("n_ordinary"),
    )
    full = grid.join(both, "pair", "left").na.fill(0)
    full = full.withColumn("last", F.expr(f"pair div {width}")).withColumn("next", F.col("pair") % width)
    sums = lambda by, prefix: full.groupBy(by).agg(
        F.sum("n_random").alias(f"{prefix}_random"), F.sum("n_ordinary").alias(f"{prefix}_ordinary")
    )
    table = full.join(sums("last", "after"), "last").join(sums("next", "any"), "next")
    total = F.struct(*[F.sum(f"n_{kind}").alias(kind) for kind in ("random", "ordinary")])
    totals = full.agg(total.alias("t")).first().t

    def log_p(kind: str) -> Column:
        anywhere = (F.col(f"any_{kind}") + PRIOR_EACH) / F.lit(totals[kind] + PRIOR_EACH * width)
        return F.log((F.col(f"n_{kind}") + PRIOR * anywhere) / (F.col(f"after_{kind}") + PRIOR))

    table = table.select("pair", (log_p("random") - log_p("ordinary")).alias("ratio"))
    # One number for each pair of characters comes to the driver, whatever the input.
    return MarkovModels([row.ratio for row in table.orderBy("pair").collect()])


def suspicious(text: Column, base: Column, models: MarkovModels) -> Column:
    """Spans of runs that mix kinds of characters and that the models call random."""
    runs = outside(matches(text, RUN % JUDGED_FROM, len(KINDS)), base)
    mixed = F.filter(runs, lambda s: _mixed(s["value"]))
    return F.filter(
        mixed,
        lambda s: models.ratio(s["value"]) >= F.greatest(F.lit(LEAST_RATIO), F.length(s["value"]) * F.lit(LEAST_EACH)),
    )


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(name) for name, _, _ in KINDS], F.lit(FOUND))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def train(docs: DataFrame, text_col: str = "text") -> MarkovModels:
    """Learn both models from all texts."""
    text = docs.select(text_of(F.col(f"`{text_col}`")).alias("text"))
    found = text.withColumn("base", base_spans(F.col("text")))
    # What the base patterns match is cut out; the gap keeps the rest from growing together.
    rest = F.col("text")
    for _, pattern, _ in KINDS:
        rest = F.when(F.size("base") > 0, F.regexp_replace(rest, pattern, " ")).otherwise(rest)
    return learn(labelled_samples(found.select("base", rest.alias("rest"))))


def scan(docs: DataFrame, models: MarkovModels, text_col: str = "text") -> DataFrame:
    """Every row with ``n_assign, n_access, n_hex, n_markov, base_sha256, spans``.

    ``spans`` are all spans as ``kind:start:end`` (code points, end exclusive) by start and kind;
    ``base_sha256`` is the SHA-256 of those of the base patterns alone. Null text is empty; a text
    without spans has an empty list. Columns named like an added one are replaced.
    """
    text = text_of(F.col(f"doc.`{text_col}`"))
    rows = packed(docs).withColumn("base", base_spans(text))
    rows = rows.withColumn("more", suspicious(text, F.col("base"), models))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    result = rows.select(
        "doc",
        *[count(kind).alias(f"n_{name}") for kind, (name, _, _) in enumerate(KINDS)],
        F.size("more").cast("long").alias("n_markov"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "more"))).alias("spans"),
    )
    return unpacked(result, *OWN)
