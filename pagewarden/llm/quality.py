"""Quality rules and gradient-boosted trees over statistics of whole texts.

Trees are fitted in numpy on a bounded sample of labelled rows and flattened
into node arrays; scoring walks all trees of a batch at once inside the tasks.
More symbols, shouting, repeats or copied lines never raise a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import unused

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SAMPLE = 20_000  # labelled rows the trees are fitted on, at most
MIN_WORDS, MAX_REPEAT = 50, 50  # base rules: words at least, repeated words in per cent at most
KEEP_AT = 0.5
FEATURES = ("words", "word_chars", "symbols", "dup_lines", "repeats", "upper", "digits", "bangs", "distinct", "line_words", "commas")
# -1: a higher value never raises the score.
DIRECTION = dict.fromkeys(FEATURES, 0) | dict.fromkeys(("symbols", "dup_lines", "repeats", "upper", "bangs"), -1)
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, x array<double>"


def repeat_words(words: list[str]) -> tuple[int, int]:
    """Words inside three-word windows found twice or more, and distinct words."""
    seen: dict[str, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if len(words) < 3:
        return 0, len(seen)
    _, pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
    _, window, often = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    hit = often[window] > 1
    mark = np.zeros(len(words), bool)
    for k in range(3):
        mark[k : k + len(hit)] |= hit
    return int(mark.sum()), len(seen)


def measure(text: str | None) -> tuple:
    """Counts of one whole text, and the features made of them."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines, seen, copied = 0, set(), 0
    for line in text.split("\n"):
        if line.strip(_BLANK):
            lines += 1
            copied += line in seen
            seen.add(line)
    repeats, distinct = repeat_words(words)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    digits = int(((raw >= 48) & (raw <= 57)).sum())
    per = max(n, 1)
    x = [float(np.log1p(n)), chars / per, symbols / per, copied / max(lines, 1), repeats / per, upper / max(chars, 1),
         digits / max(chars, 1), text.count("!") / per, distinct / per, n / max(lines, 1), text.count(",") / per]
    return n, chars, symbols, copied, repeats, x


def _measured(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "x"])


def measures(text: Column | str) -> Column:
    """Struct of the counts and features of a text column."""
    return F.pandas_udf(_measured, _SCHEMA)(text)


@dataclass
class Trees:
    """Flattened trees in heap order: trees x inner nodes, trees x leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of a good text for every row of features."""
        total = np.full(len(x), self.base)
        if len(self.feature):
            tree = np.arange(len(self.feature))[None, :]
            node = np.zeros((len(x), len(self.feature)), np.int64)
            for _ in range(int(np.log2(self.value.shape[1]))):
                right = np.take_along_axis(x, self.feature[tree, node], axis=1) > self.threshold[tree, node]
                node = 2 * node + 1 + right
            total = total + self.value[tree, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 5.0) -> Trees:
    """Boosted trees of logistic loss; splits that break a direction are refused."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), 20.0)
    sign = np.array([DIRECTION[f] for f in FEATURES])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        feature, threshold, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves)
        bounds = {0: (-np.inf, np.inf)}
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            low, high = bounds[node]
            own = np.clip(grad[rows].sum() / (hess[rows].sum() + 1), low, high)
            best, split = 1e-6, None
            for f in range(x.shape[1]):
                width = len(cuts[f]) + 1
                g = np.cumsum(np.bincount(code[rows, f], grad[rows], width))
                h = np.cumsum(np.bincount(code[rows, f], hess[rows], width))
                gl, hl, gr, hr = g[:-1], h[:-1], g[-1] - g[:-1], h[-1] - h[:-1]
                vl, vr = np.clip(gl / (hl + 1), low, high), np.clip(gr / (hr + 1), low, high)
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g[-1] ** 2 / (h[-1] + 1)
                gain = np.where((hl >= least) & (hr >= least) & ((vr - vl) * sign[f] >= 0), gain, -1)
                if len(gain) and gain.max() > best:
                    k = int(gain.argmax())
                    best, split = gain[k], (f, k, vl[k], vr[k])
            left, right = (low, high), (low, high)
            if split:
                f, k, vl, vr = split
                feature[node], threshold[node] = f, cuts[f][k]
                middle = (vl + vr) / 2
                if sign[f] < 0:
                    left, right = (middle, high), (low, middle)
                elif sign[f] > 0:
                    left, right = (low, middle), (middle, high)
                at[rows] = 2 * node + 1 + (x[rows, f] > cuts[f][k])
            else:
                vl = vr = own
                at[rows] = 2 * node + 1
            bounds[2 * node + 1], bounds[2 * node + 2] = left, right
            if 2 * node + 1 >= inner:
                value[2 * node + 1 - inner], value[2 * node + 2 - inner] = rate * vl, rate * vr
        margin = margin + value[at - inner]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return Trees(np.stack(features), np.stack(thresholds), np.stack(values), base)


def fit_from(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from the ``sample`` labelled rows with the smallest hashed ids."""
    picked = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_y"))
        .dropna().orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    )
    rows = (
        docs.select(F.col("doc_id").alias("_d"), F.col("text").alias("_t"))
        .join(F.broadcast(picked), F.col("_d") == F.col("_id"))  # bounded by ``sample``
        .select(F.xxhash64("_d").alias("o"), F.xxhash64("_t").alias("t"), "_y", measures("_t")["x"].alias("x"))
        .orderBy("o", "t", "_y").limit(sample).collect()
    )
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["_y"] > 0 for r in rows], float))


def judged(docs: DataFrame, trees: Trees, text_col: str = "text", into: str = "_quality") -> DataFrame:
    """``docs`` with a struct column ``into``: the counts, score, base_failed and kept.

    Null, empty and blank texts have no words and fail the base rules. Rows are
    judged one by one, so ties, repeated rows and other columns change nothing;
    a column that is called ``into`` is replaced, all others pass through.
    """
    measured, scored = unused(docs, "_m", "_s")

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(trees.score(np.array(list(x), float).reshape(len(x), len(FEATURES))))

    m = F.col(measured)
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT * m["n_words"])
    return (
        docs.withColumn(measured, measures(F.col(text_col)))
        .withColumn(scored, score(m["x"]))
        .withColumn(into, F.struct(
            *(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            failed.alias("base_failed"), (~failed & (F.col(scored) >= KEEP_AT)).alias("kept"), F.col(scored).alias("score"),
        ))
        .drop(measured, scored)
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that pass the base rules and the trees."""
    (into,) = unused(docs, "_quality")
    return judged(docs, fit_from(docs, labels), into=into).filter(F.col(into)["kept"]).drop(into)
