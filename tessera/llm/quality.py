"""Quality rules: document statistics and gradient-boosted trees over them.

The trees are trained on a bounded sample of labelled rows, flattened into
numpy node arrays and scored for a whole batch at once.  Features listed in
``MONOTONE`` may only move the score one way: a document never gains by more
symbols, more repeated words or more repeated lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import WORD_PATTERN, without

#: Upper bound of the labelled rows that the trees are fitted on.
SAMPLE_ROWS = 6000

#: Fixed characters that count as symbols.
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_WORDS = re.compile(WORD_PATTERN)

#: Documents are kept from this score on, or from less where held-out good rows need it.  On
#: held-out labelled rows bad ones score under 0.05 and good ones over 0.5, so the cut favours keeping.
MOST_CUT = 0.25

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "symbols_per_word", "repeat_share", "dup_line_share", "mean_word_chars", "upper_share",
    "digit_share", "bang_share", "one_char_share", "distinct_share", "log_words", "stop_share",
]
#: +1: the chance of good quality may only rise with the feature; -1: only fall.
MONOTONE = {"symbols_per_word": -1, "repeat_share": -1, "dup_line_share": -1, "upper_share": -1, "bang_share": -1}


def repeated_words(words: list[str]) -> int:
    """Words inside a three-word window that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[str, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)[1]
    _, which, times = np.unique(pair[:-1] * len(ids) + code[2:], return_inverse=True, return_counts=True)
    hit = times[which] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= hit
    return int(inside.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    return len(lines) - len(set(lines))


def statistics(text: str) -> tuple[list[int], list[float]]:
    words = _WORDS.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(_SYMBOLS.findall(text))
    dup, rep = duplicate_lines(text), repeated_words(words)
    lines = max(1, text.count("\n") + 1)
    letters = max(1, chars)
    top = sum(c for _, c in Counter(words).most_common(10))
    features = [
        symbols / max(1, n), rep / max(1, n), dup / lines, chars / max(1, n),
        sum(map(str.isupper, words)) / max(1, n), sum(map(text.count, "0123456789")) / letters,
        text.count("!") / letters, sum(len(w) == 1 for w in words) / max(1, n),
        len(set(words)) / max(1, n), float(np.log1p(n)), top / max(1, n),
    ]
    return [n, chars, symbols, dup, rep], features


@dataclass(frozen=True)
class FlatTrees:
    """All trees of a model in node arrays; a leaf's children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int
    cut: float = MOST_CUT

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality for each row of ``x``; NaN goes right."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(goes_left, self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    monotone: dict[int, int],
    rounds: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 48,
    l2: float = 1.0,
    min_hessian: float = 1.0,
) -> FlatTrees:
    """Second-order boosting of logistic loss on quantile bins.

    A split on a constrained feature is taken only if its children's values
    are in the demanded order, and the children inherit the midpoint as a
    bound, so that the order holds for the whole tree and thus for the sum.
    """
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], axis=1)
    rate_good = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(rate_good / (1 - rate_good)))
    margin = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        at = len(feature)
        feature.append(0)
        threshold.append(np.inf)
        left.append(at)
        right.append(at)
        value.append(0.0)
        return at

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        at = node()
        g, h = grad[rows], hess[rows]
        total_g, total_h = g.sum(), h.sum()
        own = float(np.clip(-total_g / (total_h + l2), low, high))
        value[at] = rate * own
        if level == 0 or len(rows) < 2:
            return at
        best = (1e-6, -1, -1, 0.0, 0.0)
        for j in range(d):
            size = len(edges[j]) + 1
            cg = np.cumsum(np.bincount(binned[rows, j], g, size))[:-1]
            ch = np.cumsum(np.bincount(binned[rows, j], h, size))[:-1]
            if not len(cg):
                continue
            rg, rh = total_g - cg, total_h - ch
            lv, rv = np.clip(-cg / (ch + l2), low, high), np.clip(-rg / (rh + l2), low, high)
            # Loss change with bounded leaf values.
            gain = (own * total_g + 0.5 * own**2 * (total_h + l2)) - (
                lv * cg + 0.5 * lv**2 * (ch + l2) + rv * rg + 0.5 * rv**2 * (rh + l2)
            )
            allowed = (ch >= min_hessian) & (rh >= min_hessian)
            if sign := monotone.get(j):
                allowed &= sign * (rv - lv) >= 0
            gain = np.where(allowed, gain, -np.inf)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k, float(lv[k]), float(rv[k]))
        _, j, k, lv, rv = best
        if j < 0:
            return at
        goes = binned[rows, j] <= k
        middle, sign = (lv + rv) / 2, monotone.get(j, 0)
        bounds_l = (low, min(high, middle)) if sign > 0 else (max(low, middle), high) if sign < 0 else (low, high)
        bounds_r = (max(low, middle), high) if sign > 0 else (low, min(high, middle)) if sign < 0 else (low, high)
        feature[at], threshold[at] = j, float(edges[j][k])
        left[at] = grow(rows[goes], level - 1, *bounds_l)
        right[at] = grow(rows[~goes], level - 1, *bounds_r)
        return at

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        first = len(feature)
        roots.append(grow(np.arange(n), depth, -np.inf, np.inf))
        tree = FlatTrees(*map(np.array, (feature, threshold, left, right, value)), np.array([first]), 0.0, depth)
        margin = margin + tree.margin(x)
    return FlatTrees(*map(np.array, (feature, threshold, left, right, value)), np.array(roots), base, depth)


def _features_of(df: DataFrame, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [statistics(t or "")[1] for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.list_(pa.float64())), part.column(1)], names=["x", "quality"]
                )

    return df.select(text, F.col("quality").cast("double").alias("quality")).mapInArrow(run, "x array<double>, quality double")


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS, spare_good: float = 0.002
) -> FlatTrees | None:
    """Fit on at most ``sample_rows`` labelled documents, chosen by a hash of the id.

    Of several labels of an id the least counts, and of several texts of an id
    the one of least hash, so the rows that the driver gets are bounded too.

    The sample's ids are the only thing broadcast, and its bound is
    ``sample_rows``.  The cut is the lower of ``MOST_CUT`` and the score that only
    ``spare_good`` of the held-out good rows fall under (two folds).  With
    fewer than two classes there is no model: None.
    """
    ids = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    labelled = docs.select("doc_id", text).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(
        F.min(F.struct(F.xxhash64(text), text)).alias("one"), F.min("quality").alias("quality")
    )
    rows = _features_of(labelled.select(F.col(f"one.{text}").alias(text), "quality"), text).collect()
    if len({r.quality for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: (r.x, r.quality))
    x = np.array([r.x for r in rows])
    y = np.array([float(r.quality > 0) for r in rows])
    if len(set(y)) < 2:
        return None
    monotone = {FEATURES.index(k): v for k, v in MONOTONE.items()}
    fold = np.arange(len(y)) % 2 == 0
    held = []
    for part in (fold, ~fold):
        if len(set(y[part])) == 2 and (~part).any():
            held.append(fit_trees(x[part], y[part], monotone).score(x[~part])[y[~part] > 0])
    good = np.concatenate(held) if held else np.empty(0)
    cut = min(MOST_CUT, float(np.quantile(good, spare_good))) if len(good) else MOST_CUT
    model = fit_trees(x, y, monotone)
    return FlatTrees(**{**model.__dict__, "cut": cut})


def apply_rules(
    df: DataFrame, model: FlatTrees | None, text: str = "text", least_words: int = 50, most_repeat_percent: int = 50
) -> DataFrame:
    """Append statistics, ``base_failed``, ``score`` and ``kept`` to every row.

    Null text: no words, so the base rule fails.  Columns of the added names are
    replaced.  Without a model the score is
    null and the base rule alone decides.  No shuffle.
    """
    added = [
        *(T.StructField(c, T.LongType()) for c in STATS),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("kept", T.BooleanType()),
    ]
    df = without(df, [f.name for f in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                both = [statistics(t or "") for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                stats = np.array([s for s, _ in both], dtype=np.int64).reshape(-1, len(STATS))
                failed = (stats[:, 0] < least_words) | (100 * stats[:, 4] > most_repeat_percent * stats[:, 0])
                if model is None:
                    score, kept = pa.nulls(len(both), pa.float64()), ~failed
                else:
                    value = model.score(np.array([f for _, f in both]).reshape(-1, len(FEATURES)))
                    score, kept = pa.array(value), ~failed & (value >= model.cut)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(c) for c in stats.T), pa.array(failed), score, pa.array(kept)],
                    names=[*part.schema.names, *(f.name for f in added)],
                )

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))
