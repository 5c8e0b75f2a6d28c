"""Columns that clash with the operators' own, notices of close licences, schedules with any knots, pieces of long texts."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewarden.llm import chosenpath, curriculum, decontaminate, licenses, linededup, quality, runindex

CLASHES = (
    "_gone", "_gone_id", "_gone_k", "_own_k", "_lines", "_i", "_k", "_key", "_leaky", "_m", "_s", "_quality", "_KEY_", "k", "id", "h",
)


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(80)) + f"\nshared line here\nown {i}" for i in range(12)]
    rows = [(i, t, "s") for i, t in enumerate([*texts, texts[0], None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id")) for c in CLASHES})


def intact(out, docs, but=()):
    own = [c for c in CLASHES if c not in but]
    assert set(docs.columns) <= set(out.columns)
    for r in out.collect():
        assert [r[c] for c in own] == [f"{c} of {r.doc_id}" for c in own]


def test_columns_of_the_user_pass_through(spark, clashing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    intact(quality.keep_good(clashing, labels), clashing)
    intact(quality.judged(clashing, quality.fit_from(clashing, labels)), clashing, {"_quality"})
    intact(linededup.drop_lines(clashing), clashing, {"_lines"})
    intact(linededup.without_duplicate_lines(clashing), clashing)
    intact(chosenpath.keep_first(clashing), clashing)
    intact(decontaminate.clean(clashing, bench), clashing)
    for out in (linededup.without_duplicate_lines(clashing), chosenpath.keep_first(clashing), decontaminate.clean(clashing, bench)):
        assert out.columns == clashing.columns
    assert curriculum.mixed(clashing).count() == clashing.count()


def test_close_licences(spark):
    gnu = dict(licenses.GNU_FAMILIES)
    rows = [
        (1, "a/x", licenses.GPL_HEADER.replace("GNU General", gnu["LGPL"])), (2, "b/x", licenses.GPL_HEADER.replace("GNU General", gnu["AGPL"])),
        (3, "c/x", licenses.GPL_HEADER), (4, "d/x", "Copyright (c) 2020 Jo Doe, licensed under the MIT License"),
        (5, "e/LICENSE", "Everything was written at night. This project uses the MIT License. Ask for help at the desk."),
        (6, "f/x", "Licensed under MIT or Apache-2.0."), (7, "f/y", "Licensed under Apache-2.0 or MIT"),
        (8, "g/x", "Copyright 2019 The Authors of the Under Project\nnothing else"),
        (9, "h/x", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
        (10, "i/x", "Dual licensed under the MIT or GPL Version 2 licenses."),
    ]
    files = spark.createDataFrame(rows, "id long, path string, text string")
    many = spark.range(100, 5_100).selectExpr("id", "'z/' || id as path", "'code and text here are under this or that of the software uses it' as text")
    out = {r.id: r.license for r in licenses.scan(files.unionByName(many)).filter("id < 100").collect()}
    assert out == {
        1: "LGPL", 2: "AGPL", 3: "GPL", 4: "MIT", 5: "MIT", 6: "Apache-2.0 OR MIT", 7: "Apache-2.0 OR MIT", 8: None, 9: "LGPL",
        10: "GPL-2.0 OR MIT",
    }


KNOTS = ((0.0, 0.0), (0.2, 3.0), (0.5, 0.0), (0.7, 0.0), (1.0, 1.0))


def test_time_inverts_the_integral(spark):
    times, weights = np.array(KNOTS).T
    fine = np.linspace(0, 1, 200_001)
    value = np.interp(fine, times, weights)
    met = np.r_[0, np.cumsum((value[1:] + value[:-1]) / 2)]
    met /= met[-1]
    shares = [0.0, 0.01, 0.3, 0.6, 0.749, 0.76, 0.9, 0.999, 1.0]
    rows = spark.createDataFrame([(s,) for s in shares], "s double")
    got = [r.t for r in rows.select("s", curriculum._time(F.col("s"), KNOTS).alias("t")).orderBy("s").collect()]
    assert got == sorted(got) and got[-1] == 1
    for s, t in zip(shares, got):
        assert np.interp(t, fine, met) == pytest.approx(s, abs=1e-4)
    for bad in (((0.0, 1.0),), ((0.0, 1.0), (0.5, 1.0)), ((0.0, 0.0), (1.0, 0.0)), ((0.0, 1.0), (0.5, -1.0), (1.0, 1.0))):
        with pytest.raises(ValueError):
            curriculum.pieces(bad)


def test_order_against_brute_force(spark):
    """Passes taken and the order of all positions, from the documents in the order of their first positions."""
    rng = random.Random(8)
    rows = [(i, "abc"[min(2, i % 7)], " ".join(["w"] * rng.randrange(0, 40))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    schedules = (((0.0, 1.0), (1.0, 1.0)),)
    out = [r.asDict() for r in curriculum.mixed(docs, schedules=schedules).collect()]
    for source in "abc":
        own = [r for r in out if r["source"] == source]
        size, target = own[0]["source_size"], own[0]["target"]
        assert size == sum(r["size"] for r in own)
        # With a flat schedule a position is the demand before it out of the target.
        taken = sorted((r for r in own if r["passes"]), key=lambda r: r["positions"][0])
        for r in taken:
            at = r["positions"][0] * target
            assert r["passes"] == sum(at + r["size"] / 2 + p * size < target for p in range(3)) and r["taken"] == r["size"] * r["passes"]
            assert r["positions"] == pytest.approx([(at + p * size) / target for p in range(r["passes"])])
        ends = [r["positions"][0] * target + r["size"] for r in taken]
        if target >= size:  # every document with words stands right behind the one before it
            assert [r["positions"][0] * target for r in taken] == pytest.approx([0, *ends[:-1]], abs=1e-6)
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own)
    order = [(r.doc_id, r["pass"], r.position) for r in curriculum.training_order(docs, schedules=schedules).collect()]
    assert [x[2] for x in order] == sorted(x[2] for x in order)
    assert collections.Counter(x[0] for x in order) == {r["doc_id"]: r["passes"] for r in out if r["passes"]}
    first = [r.first_position for r in curriculum.ordered(docs, schedules=schedules).collect()]
    known = [p for p in first if p is not None]
    assert len(first) == len(rows) and known == sorted(known) and first[: len(known)] == known


def test_pieces_of_long_texts(monkeypatch):
    """Every window of every text once, whether or not a text is handled in pieces."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcd é") for _ in range(n)) for n in (150, 5_000, 0, 200, 2_345)]
    keys = [bytes([i]) * 16 for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts)], ["k", "text"])

    def windows():
        seen = collections.Counter()
        for out in runindex._anchors(200)([batch]):
            for k, place, seed in zip(*(out.column(c).to_pylist() for c in ("k", "place", "ah"))):
                start, more, anchor = place >> 16, (place >> 8) & 255, place & 255
                for w in range(start, start + more + 1):
                    seen[(k, w, start + anchor, seed)] += 1
        return seen

    whole = windows()
    monkeypatch.setattr(runindex, "LONG_TEXT", 700)
    cut = windows()
    sizes = {k: max(0, len(t.encode()) - 199) for k, t in zip(keys, texts)}
    assert {x: n for x, n in collections.Counter(k for k, *_ in whole).items()} == {k: n for k, n in sizes.items() if n}
    assert set(whole.values()) == set(cut.values()) == {1}
    # A piece picks the same anchors unless two of a window's strings hash alike in their high bits.
    assert len(whole & cut) >= 0.999 * len(whole)
