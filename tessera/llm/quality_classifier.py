"""A quality classifier as a sparse ensemble of rules.

Statistics of whole texts are computed by Spark columns. On a bounded sample of labelled rows shallow trees
are boosted; every path from a root to a node is a conjunctive rule, a logistic model with an L1 penalty
weighs the rules, and those with a weight are compiled back into one Spark column.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import base_counts
from .shared import cut, share01

#: Labelled rows used for the fit at most (the first by a hash of doc_id).
SAMPLE = 20_000
TREES, DEPTH, BINS, L1 = 24, 3, 32, 2e-3
FEATURES = ["log_words", "word_chars", "symbols", "upper", "other", "digits", "dup_lines", "repeats", "distinct", "line_chars"]
Rule = tuple[tuple[int, bool, float], ...]  # (feature, at most, bound), all of which must hold


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of FEATURES: numbers that are never null (empty text: zeros)."""
    text = F.coalesce("text", F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))
    count = lambda keep: F.length(F.regexp_replace(text, keep, ""))
    lines = F.size(F.split(text, "\n"))
    words = F.split(F.lower(text), r"[\x20\x09-\x0D]+")
    docs = base_counts(docs)
    n = F.greatest("n_words", F.lit(1))
    made = [
        F.log1p("n_words"), F.col("word_chars") / n, F.col("n_symbols") / chars, count(r"\P{Lu}+") / chars, count(r"[\p{L}\s]+") / chars,
        count(r"[^0-9]+") / chars, F.col("n_dup_lines") / lines, F.col("n_repeat_words") / n, F.size(F.array_distinct(words)) / n, chars / lines,
    ]
    return docs.withColumns({k: v.cast("double") for k, v in zip(FEATURES, made)})


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: list, bounds: list[np.ndarray], rules: list[Rule], step: np.ndarray, features: np.ndarray) -> None:
    """One tree on binned ``x``; ``step`` gets each row's leaf value, ``rules`` the paths of all nodes."""
    if path:
        rules.append(tuple(path))
    best = (1e-6, None, None)
    if depth and len(rows) >= 20:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f in features:
            gs = np.cumsum(np.bincount(x[rows, f], g[rows], len(bounds[f]) + 1))[:-1]
            hs = np.cumsum(np.bincount(x[rows, f], h[rows], len(bounds[f]) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
    if best[1] is None:
        step[rows] = g[rows].sum() / (h[rows].sum() + 1)
        return
    _, f, b = best
    low = x[rows, f] <= b
    for side, at_most in ((rows[low], True), (rows[~low], False)):
        _grow(x, g, h, side, depth - 1, [*path, (int(f), at_most, float(bounds[f][b]))], bounds, rules, step, features)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, f] <= b) == at_most for f, at_most, b in rule])


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, l1: float = L1, seed: int = 11) -> tuple[float, dict[Rule, float]]:
    """(intercept, weight of each rule that has one) for statistics ``x`` and labels ``y`` (0 or 1)."""
    if not len(y):
        return 0.0, {}
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if y.min() == y.max():
        return prior, {}
    rng = np.random.default_rng(seed)
    bounds = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    bounds = [b[b < c.max()] for b, c in zip(bounds, x.T)]
    binned = np.stack([np.searchsorted(b, c, "left") for b, c in zip(bounds, x.T)], axis=1)
    score, rules = np.full(len(y), prior), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(len(y))
        some = np.sort(rng.permutation(len(y))[: max(20, len(y) // 2)])
        features = np.sort(rng.permutation(x.shape[1])[: max(2, x.shape[1] * 2 // 3)])
        found: list[Rule] = []
        _grow(binned, y - p, p * (1 - p), some, depth, [], bounds, found, step, features)
        rules += found
        score[some] += 0.3 * step[some]
    rules = list(dict.fromkeys(rules))
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
    weights, intercept = _lasso(z, y.astype(np.float64), l1, prior)
    return intercept, {r: float(w) for r, w in zip(rules, weights) if w}


def _lasso(z: np.ndarray, y: np.ndarray, l1: float, intercept: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for logistic loss with an L1 penalty (the intercept has none)."""
    z = np.hstack([z, np.ones((len(y), 1))])
    rate = 4 * len(y) / max(1e-9, np.linalg.norm(z, 2) ** 2)
    now = np.zeros(z.shape[1])
    now[-1] = intercept
    ahead, t = now.copy(), 1.0
    for _ in range(rounds):
        step = ahead - rate * (z.T @ (1 / (1 + np.exp(-z @ ahead)) - y)) / len(y)
        step[:-1] = np.sign(step[:-1]) * np.maximum(np.abs(step[:-1]) - rate * l1, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, now = step + (before - 1) / t * (step - now), step
    return now[:-1], float(now[-1])


def compiled(intercept: float, rules: dict[Rule, float]) -> Column:
    """The probability of label 1 as a column over FEATURES."""
    term = lambda f, at_most, b: F.col(FEATURES[f]) <= b if at_most else F.col(FEATURES[f]) > b
    total = F.lit(intercept)
    for rule, weight in rules.items():
        total = total + F.when(reduce(lambda a, b: a & b, [term(*x) for x in rule]), F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text, ...).

    labels: (doc_id, quality). The fit uses rows with a quality of 0 or 1 whose crc32(doc_id as text) mod 3
    is not 1, ``sample`` of those that meet a row of ``docs`` at most (a row of ``docs`` or ``labels`` that is repeated counts each time); only
    FEATURES enter a score. Jobs of the fit run when this is called. Null and empty texts are scored like any
    other; a null doc_id is not held out and never learned from; repeated rows are scored each. Without
    labels every score is 0.5, with one label only its smoothed share. Other columns are ignored.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    stats = cut(statistics(docs.select("doc_id", "text")).select("doc_id", *FEATURES))
    usable = labels.where(F.col("quality").isin(0, 1) & (fold != 1)).select("doc_id", "quality").join(stats, "doc_id")
    n = usable.count()  # of the labels those that meet a document
    usable = usable.where(share01(F.col("doc_id")) <= min(1.0, 1.5 * sample / max(1, n)))
    first = usable.orderBy(share01(F.col("doc_id")), "doc_id", "quality", *FEATURES).limit(sample)
    rows = first.select("quality", *FEATURES).toArrow()
    x = np.stack([rows.column(c).to_numpy() for c in FEATURES], axis=1)
    intercept, rules = fit(x, rows.column("quality").to_numpy())
    out = stats.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), compiled(intercept, rules).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
