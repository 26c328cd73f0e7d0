"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees are grown on a bounded sample of labelled documents; the path to each of their
nodes is a conjunctive rule over statistics. A lasso logistic regression keeps few of the rules,
and these become one Spark column expression, so scoring is a scan without Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import packed, text_of, unpacked

#: At most so many labelled documents are used for fitting.
MAX_TRAINING_ROWS = 20_000
N_TREES, DEPTH, LEAF_ROWS, SHRINK = 40, 3, 20, 0.3
#: Weight of the lasso penalty on each rule, per training row.
PENALTY = 0.002
SPACES = r"[\x20\x09-\x0D]+"
OWN = ("score", "predicted")


def words_of(text: Column) -> Column:
    """The words, A-Z and other letters in lower case."""
    return F.array_remove(F.split(F.lower(text), SPACES), "")


def statistics(text: Column, words: Column) -> dict[str, Column]:
    """Numbers that describe a text, given with its ``words_of``; all are 0 for an empty one."""
    n_chars, n_words = F.length(text), F.size(words)
    per = lambda count, of: F.when(of > 0, count / of).otherwise(F.lit(0.0))
    # One character of a class at a time; most texts have few of them.
    count = lambda chars: F.regexp_count(text, F.lit(chars))
    return {
        "log_words": F.log1p(n_words.cast("double")),
        "mean_word": per(F.length(F.array_join(words, "")), n_words),
        "upper_share": per(F.length(F.regexp_replace(text, r"\P{Lu}+", "")), n_chars),
        "symbol_share": per(count(r"[#%&$*|<>{}\[\]~^_=+@\\]"), n_chars),
        "shout_share": per(count("[!?]"), n_chars),
        "digit_share": per(count("[0-9]"), n_chars),
        "stop_share": per(count("[.,;:]"), n_chars),
        "line_share": per(count("\n"), n_chars),
        "distinct_share": per(F.size(F.array_distinct(words)), n_words),
        "again_share": per(F.size(F.filter(words, lambda w, i: w == F.get(words, i + 1))), n_words),
        "short_share": per(F.size(F.filter(words, lambda w: F.length(w) <= 3)), n_words),
    }


def measured(rows: DataFrame, text: Column, names: list[str] | None = None) -> DataFrame:
    """Every row with statistics of its text as columns: those of ``names``, or all.

    Each step is a one-row ``inline``: the words are split once for all statistics, and a statistic is measured
    once for all rules, also where the optimizer moves a filter on the score down.
    """
    split = F.inline(F.array(F.struct(text_of(text).alias("__text"), words_of(text_of(text)).alias("__words"))))
    found = statistics(F.col("__text"), F.col("__words"))
    numbers = [found[name].alias(name) for name in names or found]
    return rows.select("*", split).select(*rows.columns, F.inline(F.array(F.struct(*numbers))))


@dataclass(frozen=True)
class Rule:
    """Holds where every statistic lies on its side of its limit; ``above`` means greater than it."""

    conditions: tuple[tuple[str, bool, float], ...]

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        fits = [columns[name] > limit if above else columns[name] <= limit for name, above, limit in self.conditions]
        return np.logical_and.reduce(fits)

    def column(self) -> Column:
        fits = F.lit(True)
        for name, above, limit in self.conditions:
            value = F.col(name)
            fits = fits & ((value > limit) if above else (value <= limit))
        return fits


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules; ``bias`` alone scores where nothing could be learned."""

    bias: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, rows: DataFrame, text: Column) -> DataFrame:
        """Rows with ``score``, the probability of label 1: one column expression over the statistics of the rules."""
        names = sorted({name for rule, _ in self.rules for name, _, _ in rule.conditions})
        weights = [F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0)) for rule, weight in self.rules]
        margin = sum(weights, F.lit(self.bias))
        held = measured(rows, text, names) if names else rows
        return held.select(*rows.columns, (1 / (1 + F.exp(-margin))).alias("score"))


def _grow(columns, names, order, gradient, hessian, rows, depth, path, found) -> np.ndarray:
    """Grow one regression tree; notes the path to each node and returns the rows' values."""
    values = np.full(len(gradient), 0.0)
    best = (1e-9, None, 0.0)
    if depth and len(rows) >= 2 * LEAF_ROWS:
        inside = np.zeros(len(gradient), bool)
        inside[rows] = True
        g_all, h_all = gradient[rows].sum(), hessian[rows].sum()
        for name in names:
            ranked = order[name][inside[order[name]]]
            x, g, h = columns[name][ranked], np.cumsum(gradient[ranked]), np.cumsum(hessian[ranked])
            cut = np.flatnonzero(x[:-1] < x[1:])
            cut = cut[(cut >= LEAF_ROWS - 1) & (cut < len(x) - LEAF_ROWS)]
            if not len(cut):
                continue
            gain = g[cut] ** 2 / (h[cut] + 1) + (g_all - g[cut]) ** 2 / (h_all - h[cut] + 1) - g_all**2 / (h_all + 1)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], name, float((x[cut[at]] + x[cut[at] + 1]) / 2))
    if best[1] is None:
        values[rows] = gradient[rows].sum() / (hessian[rows].sum() + 1)
        return values
    _, name, limit = best
    low = columns[name][rows] <= limit
    for above, side in ((False, rows[low]), (True, rows[~low])):
        longer = (*path, (name, above, limit))
        found.append(Rule(longer))
        values += _grow(columns, names, order, gradient, hessian, side, depth - 1, longer, found)
    return values


def tree_rules(columns: dict[str, np.ndarray], labels: np.ndarray) -> list[Rule]:
    """The paths of boosted trees, each rule once."""
    order = {name: np.argsort(x, kind="stable") for name, x in columns.items()}
    margin = np.full(len(labels), math.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    found: list[Rule] = []
    for _ in range(N_TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = labels - p, p * (1 - p)
        if np.abs(gradient).max() < 0.02:
            break
        margin += SHRINK * _grow(columns, list(columns), order, gradient, hessian, np.arange(len(labels)), DEPTH, (), found)
    return list(dict.fromkeys(found))


def lasso_logistic(x: np.ndarray, labels: np.ndarray, penalty: float, n_steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal gradient steps."""
    n, m = x.shape
    full = np.column_stack([x, np.ones(n)])
    step = 4 * n / max(np.linalg.norm(full, 2) ** 2, 1e-9)
    weights, ahead, t = np.zeros(m + 1), np.zeros(m + 1), 1.0
    for _ in range(n_steps):
        p = 1 / (1 + np.exp(-(full @ ahead)))
        moved = ahead - step * (full.T @ (p - labels)) / n
        moved[:m] = np.sign(moved[:m]) * np.maximum(np.abs(moved[:m]) - step * penalty, 0)
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = moved + (t - 1) / t_next * (moved - weights)
        weights, t = moved, t_next
    return weights[:m], float(weights[m])


def fit(columns: dict[str, np.ndarray], labels: np.ndarray, penalty: float = PENALTY) -> RuleEnsemble:
    """An ensemble from statistics of labelled documents; without both labels only a bias."""
    labels = np.asarray(labels, float)
    if len(np.unique(labels)) < 2:
        return RuleEnsemble(math.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    rules = tree_rules(columns, labels)
    if not rules:
        return RuleEnsemble(math.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    x = np.column_stack([rule.holds(columns) for rule in rules]).astype(float)
    weights, bias = lasso_logistic(x, labels, penalty)
    return RuleEnsemble(bias, [(rule, float(w)) for rule, w in zip(rules, weights, strict=True) if w])


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is ``fold``; a null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == fold


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = MAX_TRAINING_ROWS,
) -> RuleEnsemble:
    """Fit on at most ``max_rows`` labelled documents, drawn by a hash of their id.

    ``labels`` has one or more rows ``(id, label)`` of 0 or 1; null ids and labels are left out. Only the
    sample's statistics, ``max_rows`` rows of numbers, come to the driver.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).dropna()
    mix = F.xxhash64("id")
    drawn = known.orderBy(mix, "id", "label").limit(max_rows)
    # The sample's ids are few, so their rows are found without shuffling any text.
    drawn = spark.createDataFrame(drawn.collect(), drawn.schema)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    numbers = list(statistics(F.lit(""), F.array()))
    sample = measured(texts.join(F.broadcast(drawn), "id"), F.col("text")).drop("text")
    sample = sample.orderBy(mix, "id", "label", *numbers).limit(max_rows).collect()
    sample.sort(key=tuple)
    columns = {name: np.array([row[name] for row in sample], float) for name in numbers}
    return fit(columns, np.array([row.label for row in sample]))


def score(docs: DataFrame, model: RuleEnsemble, text_col: str = "text") -> DataFrame:
    """Every row with ``score`` (probability of label 1) and ``predicted`` (1 if at least 0.5).

    Null and empty texts have all statistics 0 and are scored like any other. Columns named like an
    added one are replaced.
    """
    scored = model.score(packed(docs), F.col(f"doc.`{text_col}`"))
    return unpacked(scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)), *OWN)
