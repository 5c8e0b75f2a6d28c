"""Toxicity by a weighted grammar of finite-state transducers over clauses.

A lexical transducer turns words into symbols: insult, threat, target, negation,
report, intent, other, and the clause end. Followers read a clause from left to
right and tell, at each word, if a target, a negation or an intent came shortly
before and if the clause is reported speech; one more reads it from right to left
and tells if a target comes shortly after. The insult and the threat transducer
read a word with what the followers say on both of its sides and write the form
it stands in (a lone insult, one aimed at somebody, a threat that is aimed or
vowed); negation and report mark that form. Composed, they give every clause its
set of patterns. A text is scored by its clauses alone, with a weight for each
pattern learned from labels; no word counts outside its clause.
"""

from __future__ import annotations

import re
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import scratch, written

SAMPLE = 10_000  # labelled rows the stems and weights are learned from, at most
SHARE, ODDS = 0.03, 8.0  # a learned stem: in this share of toxic texts, and so much likelier there
STEM, LONGEST = 4, 12  # characters of a stem
REACH = 4  # words that a target, a negation or an intent reaches
CUT = 0.3
SYMBOLS = 8
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, END = range(SYMBOLS)

# Fixed word lists of the grammar: English, German, French, Spanish. Insults of
# other languages are learned as stems.
WORDS = {
    INSULT: ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile", "fool"),
    THREAT: ("kill", "hurt", "destroy", "beat", "shoot", "stab", "burn", "strangle"),
    TARGET: (
        "you", "your", "yours", "he", "she", "they", "him", "her", "them", "this", "that", "these", "those", "who",
        "du", "dich", "dir", "ihr", "euch", "sie", "tu", "toi", "te", "vous", "ils", "elles", "eux", "tú", "ti", "usted", "ustedes", "ellos",
    ),
    NEGATION: (
        "not", "no", "never", "nor", "neither", "without", "isn't", "aren't", "don't", "doesn't", "wasn't",
        "nicht", "kein", "keine", "nie", "pas", "jamais", "sans", "nunca", "sin",
    ),
    REPORT: (
        "said", "says", "claimed", "claims", "wrote", "reported", "quoted", "alleged", "accused", "called",
        "sagte", "schrieb", "behauptete", "dit", "écrit", "affirme", "dijo", "escribió", "afirmó",
    ),
    INTENT: (
        "will", "i'll", "we'll", "shall", "gonna", "going", "must", "should", "let's",
        "werde", "werden", "wollen", "vais", "allons", "voy", "vamos",
    ),
}
ENDINGS = ("s", "es", "ed", "ing", "ly", "'s")  # a listed insult or threat also stands with one of these
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]")
_ENDS = ".!?;\n"


def follower(opens: int, reach: int | None) -> dict[tuple[int, int], tuple[int, bool]]:
    """Transducer whose output tells if ``opens`` was read up to ``reach`` words ago in this clause.

    State 0 is closed, state n has n words left; None means up to the clause end.
    """
    top = reach or 1
    arcs = {}
    for state, symbol in product(range(top + 1), range(SYMBOLS)):
        if symbol == opens:
            target = top
        elif symbol == END:
            target = 0
        else:
            target = state if reach is None else max(state - 1, 0)
        arcs[state, symbol] = (target, state > 0)
    return arcs


def compose(*machines: dict) -> tuple[list[list[int]], list[list[tuple[bool, ...]]]]:
    """Product machine: next state, and the outputs of all machines, by state and symbol."""
    start = (0,) * len(machines)
    number, queue, step, emit = {start: 0}, [start], [], []
    while len(step) < len(queue):
        state = queue[len(step)]
        row, out = [], []
        for symbol in range(SYMBOLS):
            arcs = [m[s, symbol] for m, s in zip(machines, state)]
            to = tuple(a[0] for a in arcs)
            if to not in number:
                number[to] = len(queue)
                queue.append(to)
            row.append(number[to])
            out.append(tuple(a[1] for a in arcs))
        step.append(row)
        emit.append(out)
    return step, emit


# Forms that the insult and the threat transducer write.
FORMS = ("insult", "aimed insult", "threat", "aimed threat", "vowed threat")
PATTERNS = 4 * len(FORMS)


def insult(before: bool, after: bool, intent: bool) -> int:
    """A target on either side makes an insult an aimed one."""
    return int(before or after)


def threat(before: bool, after: bool, intent: bool) -> int:
    """A threat is aimed at the target after it; with an intent before it, it is vowed."""
    return 2 + (1 + intent if after else 0)


WRITERS = {INSULT: insult, THREAT: threat}
STEP, SIDE = compose(follower(TARGET, REACH), follower(NEGATION, REACH), follower(REPORT, None), follower(INTENT, REACH))
BACK, AHEAD = compose(follower(TARGET, REACH))


def written_pattern(state: int, symbol: int, after: bool) -> int:
    """Output of the composed machine: 4 x form + 2 x negated + reported."""
    before, negated, reported, intent = SIDE[state][symbol]
    return 4 * WRITERS[symbol](before, after, intent) + 2 * negated + reported


# By state, symbol of a match, and what the reading from the right says.
EMIT = {
    (state, symbol, after): written_pattern(state, symbol, after)
    for state, symbol, after in product(range(len(STEP)), WRITERS, (False, True))
}


class Lexicon:
    """Symbol of a word: listed words first, then learned insult stems."""

    def __init__(self, stems: tuple[str, ...] = ()):
        self.words = {w + e: s for s in WRITERS for w in WORDS[s] for e in ("",) + ENDINGS}
        self.words.update({w: s for s, words in WORDS.items() for w in words})
        self.stems = stems
        self.heads = {s[:STEM] for s in stems}

    def get(self, word: str, default: int = OTHER) -> int:
        if word[:STEM] in self.heads and word not in self.words and word.startswith(self.stems):
            return INSULT
        return self.words.get(word, default)


def stems_of(counts: dict[str, int]) -> tuple[str, ...]:
    """The shortest of the qualifying prefixes, each grown while it keeps its texts.

    ``counts`` has the toxic texts of each qualifying prefix.
    """
    roots = [p for p in counts if not any(p[:n] in counts for n in range(STEM, len(p)))]
    out = set()
    for stem in roots:
        while longer := [p for p in counts if len(p) == len(stem) + 1 and p.startswith(stem) and counts[p] >= 0.95 * counts[stem]]:
            stem = longer[0]
        out.add(stem)
    return tuple(sorted(out))


def patterns(tokens: list[str], symbols: Lexicon) -> list[list[int]]:
    """Patterns of the matches of each clause, in order; clauses without words are left out."""
    tape = [END if t in _ENDS else symbols.get(t) for t in tokens]
    after, state = [False] * len(tape), 0
    for at in range(len(tape) - 1, -1, -1):
        after[at] = AHEAD[state][tape[at]][0]
        state = BACK[state][tape[at]]
    clauses, fresh, state = [], True, 0
    for symbol, ahead in zip(tape, after):
        if symbol == END:
            fresh = True
        else:
            if fresh:
                clauses.append([])
                fresh = False
            if symbol in WRITERS:
                clauses[-1].append(EMIT[state, symbol, ahead])
        state = STEP[state][symbol]
    return clauses


WIDTH = PATTERNS + 7


def matches(text: str | None, symbols: Lexicon) -> np.ndarray:
    """Features of one text: clauses by pattern, clauses that match and their share, the densest clause."""
    tokens = _TOKEN.findall((text or "").lower())
    out = np.zeros(WIDTH)
    if any(symbols.get(t) in WRITERS for t in set(tokens)):
        clauses = patterns(tokens, symbols)
        found = [c for c in clauses if c]
        for clause in found:
            out[list(set(clause))] += 1
        n = len(found)
        out[:PATTERNS] = np.log1p(out[:PATTERNS])
        out[PATTERNS : PATTERNS + 4] = [n >= k for k in (1, 2, 3, 4)]
        out[PATTERNS + 4 :] = np.log1p(n), max(map(len, found)), np.log1p(100 * n / len(clauses))
    return out


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic weights by Newton steps: mean, scale and weights with the constant last."""
    if not len(y):
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), np.r_[np.zeros(x.shape[1]), -4.0]
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.r_[np.full(x.shape[1], penalty), 1e-3]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
    return mean, scale, w


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Lexicon, tuple]:
    """Lexicon and weights from the ``sample`` rows with the smallest hashed ids.

    Held-out rows are left out. ``sample`` bounds the rows that are sent about.
    """
    picked = (
        labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("y")).dropna()
        .filter(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id", "y").limit(sample)
    )
    rows = docs.select(F.col("doc_id").alias("_d"), F.col("text").alias("t")).join(F.broadcast(picked), F.col("_d") == F.col("_id"))
    rows = rows.select("t", "y").orderBy(F.xxhash64("t"), "y").limit(sample)
    rows = written(rows, scratch(docs.sparkSession), "sample")
    n_toxic = rows.filter("y = 1").count()
    n_clean = rows.count() - n_toxic
    found = F.filter(F.array_distinct(F.split(F.lower("t"), r"[^\p{L}]+")), lambda w: F.length(w) >= STEM)
    prefixes = F.array_distinct(F.flatten(F.transform(found, lambda w: F.transform(
        F.sequence(F.lit(STEM), F.least(F.length(w), F.lit(LONGEST))), lambda n: F.substring(w, F.lit(1), n)
    ))))
    often = (
        rows.select("y", F.explode(prefixes).alias("stem")).groupBy("stem")
        .agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
        .filter(F.col("toxic") >= max(SHARE * n_toxic, 5))
        .filter((F.col("toxic") + 0.5) / (n_toxic + 1) >= ODDS * (F.col("clean") + 0.5) / (n_clean + 1))
    )
    # Few rows: each prefix is in that share of the toxic texts of the sample.
    symbols = Lexicon(stems_of({r["stem"]: r["toxic"] for r in often.collect()}))
    data = rows.select("y", features("t", symbols).alias("x")).collect()
    x = np.array([r["x"] for r in data], float).reshape(len(data), WIDTH)
    return symbols, fit(x, np.array([r["y"] for r in data], float))


def features(text: str, symbols: Lexicon) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([matches(t, symbols) for t in texts])

    return F.pandas_udf(run, "array<double>")(F.col(text))


def scored(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    Texts without a match, null and empty ones included, get the score of no
    match. Rows are scored one by one from their text alone; null ids are not
    held out; repeated rows get equal scores; other columns are not looked at.
    """
    symbols, (mean, scale, weights) = model

    def run(texts: pd.Series) -> pd.Series:
        x = np.array([matches(t, symbols) for t in texts]).reshape(len(texts), len(mean))
        return pd.Series(1 / (1 + np.exp(-np.clip((x - mean) / scale @ weights[:-1] + weights[-1], -30, 30))))

    rows = docs.select(F.col(id_col).alias(id_col), F.pandas_udf(run, "double")(F.col(text_col)).alias("score"))
    return rows.select(
        id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
