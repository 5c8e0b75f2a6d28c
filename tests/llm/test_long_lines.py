"""Variants of lines by running sums: against plain removal, and for one very long line."""

import random
import time

import numpy as np

from pagewarden.llm import linededup


def test_variants_are_equal_where_the_words_are():
    rng = random.Random(1)
    lines = [[rng.randrange(1, 4) for _ in range(rng.randint(0, 7))] for _ in range(80)] + [[5, 6, 7]] * 2
    values = np.array([x for line in lines for x in line], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    offsets = np.concatenate([[0], np.cumsum([len(line) for line in lines])]).astype(np.int64)
    row, place, key = linededup.neighbourhood(values, offsets)
    assert len(row) == sum(len(line) + 1 for line in lines)
    by_key, by_words = {}, {}
    for r, p, k in zip(row.tolist(), place.tolist(), key.tolist()):
        left = tuple(lines[r] if p == 0 else lines[r][: p - 1] + lines[r][p:])
        by_key.setdefault(k, set()).add(left)
        by_words.setdefault(left, set()).add(k)
    assert all(len(v) == 1 for v in by_key.values()) and all(len(v) == 1 for v in by_words.values())


def test_one_line_of_many_words(spark):
    words = [f"w{n * 7919 % 100_003}" for n in range(200_000)]
    edited = [*words[:150_000], "other", *words[150_001:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, "short line of six words here")], "doc_id long, text string")
    begin = time.time()
    got = {r.doc_id: r.n for r in linededup.drop_lines(docs).selectExpr("doc_id", "_lines.n_removed as n").collect()}
    assert got == {1: 0, 2: 1, 3: 0}
    assert time.time() - begin < 60
