"""The ten operators on awkward rows, and against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from pagewarden.llm import (
    chosenpath, curriculum, decontaminate, licenses, linededup, linkgraph, quality, runindex, toxicity, warc,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, w long, kept string, n long"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base, passage = sentence(rng, 120), sentence(rng, 60)
    near = base.split()
    near[60] = "changed"
    long_line = sentence(rng, 30)
    edited = long_line.split()
    edited[7] = "other"
    return [
        base, base, " ".join(near), None, "", " \n\t ", "one two", "one two",
        sentence(rng, 40) + "\n" + passage, passage + "\n" + sentence(rng, 40), sentence(rng, 5000),
        long_line + "\n" + sentence(rng, 20), " ".join(edited) + "\nshort\nshort", " ".join(edited[1:]), "x" * 900,
        "é" * 300 + sentence(rng, 10),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), "a", 1, "b", 2) for i, t in enumerate(texts)]
    rows += [(None, "a row without an id, " + "word " * 60, "en", "s1", 5, "a", 1, "b", 2), rows[2]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, texts):
    return spark.createDataFrame([(i, i % 2, int(i == 3)) for i in range(len(texts))] + [(None, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_run_index_is_exact(spark, docs, empty):
    rows = docs.select("doc_id", "text").collect()
    got = collections.Counter((r[0], r[1], r[2], r[3], hashlib.sha256(r[4]).hexdigest()) for r in runindex.remove_repeats(docs).collect())
    want = collections.Counter((r[0], *w) for r, w in zip(rows, runindex.brute_force([r[1] for r in rows])))
    assert got == want
    assert runindex.remove_repeats(empty).count() == 0


def test_run_index_beyond_a_block(docs, monkeypatch):
    monkeypatch.setattr(runindex, "GROUP", 1)  # every group takes the exact way for large groups
    rows = docs.select("doc_id", "text").collect()
    got = collections.Counter((r[0], r[2]) for r in runindex.remove_repeats(docs).collect())
    assert got == collections.Counter((r[0], w[1]) for r, w in zip(rows, runindex.brute_force([r[1] for r in rows])))


def test_spans_of_copies_come_once(spark, tmp_path):
    rng = random.Random(2)
    copied, other = sentence(rng, 200), sentence(rng, 100)
    rows = [(1, copied)] * 40 + [(2, other + " " + copied[:400])]
    spans = runindex.repeated_spans(spark.createDataFrame(rows, "k long, text string"), 200, f"file://{tmp_path}/spans").collect()
    assert len(spans) == len(set(spans)) and {r.k for r in spans} == {1, 2}


def test_matching_statistics():
    rng = np.random.default_rng(3)
    text = np.r_[rng.integers(97, 99, 400), rng.integers(97, 120, 100), [255]].astype(np.uint8)
    b = text.tobytes()

    def match(i):
        return max(next((k for k in range(len(b)) if max(i, j) + k >= len(b) or b[i + k] != b[j + k]), 0) for j in range(len(b)) if j != i)

    assert list(runindex.matching_statistics(text)) == [match(i) for i in range(len(b))]


def test_quality_counts_and_direction(docs, labels, empty):
    text = "a b c a b c\n\n#x #x\n#x #x\n"
    assert quality.measure(text)[:5] == (10, 14, 4, 1, 10)
    assert quality.measure(None)[:5] == (0, 0, 0, 0, 0)
    rng = np.random.default_rng(1)
    x = rng.random((800, len(quality.FEATURES)))
    y = ((x[:, 2] < 0.5) ^ (rng.random(800) < 0.1)).astype(float)
    trees = quality.fit(x, y)
    assert ((trees.score(x) > 0.5) == (x[:, 2] < 0.5)).mean() > 0.93
    for name, sign in quality.DIRECTION.items():
        if sign < 0:
            more = x.copy()
            more[:, quality.FEATURES.index(name)] += 0.3
            assert (trees.score(more) <= trees.score(x) + 1e-12).all()
    out = quality.judged(docs, quality.fit_from(docs, labels)).select("doc_id", "_quality.*", "k").collect()
    assert len(out) == docs.count() and all(r.base_failed for r in out if r.n_words < 50)
    assert quality.keep_good(empty, labels).count() == 0
    assert quality.judged(docs, quality.fit_from(docs, labels.limit(0))).count() == docs.count()


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nb", "same", "x"), (2, None, "same", "x"), (3, "u", None, "x"), (4, "u", "", "x"),
            (None, "u", "same", "x"), (5, "u", "é" * 200_000, "x"), (2, None, "same", "x"), (None, "u", "alone", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    out = warc.round_trip(pages).collect()
    assert len(out) == len(rows) and all(r.digest_ok for r in out if r.record_type == "response")
    by = {r.page_id: r for r in out if r.page_id is not None}
    assert (by[1].record_type, by[1].refers_to, by[1].payload_bytes) == ("revisit", 2, 4)
    assert (by[2].record_type, by[3].refers_to, by[4].record_type) == ("response", 4, "response")
    assert by[5].payload == ("é" * 200_000).encode() and by[5].payload_digest == warc.digest(by[5].payload)
    assert warc.round_trip(pages.limit(0)).count() == 0
    small = warc.round_trip(pages, least=10).filter("record_type = 'revisit'")
    assert small.count() == 0
    with pytest.raises(ValueError):
        list(warc.Reader(warc.record("1", "u", b"payload", None, False)[:-9]))


def test_link_graph(spark):
    rows = [(1, "http://A.Example.org/es/x?q", ""), (2, None, None), (3, "nothing", "<a href=/x>"), (4, "http://b.net/p#f", ""),
            (5, "http://bad.com/de/", '<a href="http://c.net/">'), (6, "http://c.net/", '<a href="//bad.com/q">'),
            (7, "https://good.com/fr/", "<a href='http://b.net/'>"), (8, "http://x.org", ""), (9, "http://x.org/en/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r for r in linkgraph.judged(pages.withColumn("host", pages.url)).collect()}
    assert (out[1].host, out[1].path, out[1].rule, out[1].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (out[2].host, out[2].path, out[2].verdict) == ("", "", "allow") and out[3].host == ""
    assert out[4].verdict == "allow" and out[4].trust > 0  # a trusted host links to it
    assert out[6].verdict == "block"  # it links to a blocked host
    assert (out[8].path, out[8].rule, out[9].rule) == ("", None, "org/")
    assert linkgraph.judged(pages.limit(0)).count() == 0


def test_line_dedup(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = linededup.brute_force(rows)
    for r in linededup.drop_lines(docs).select("doc_id", "text", "_lines.*").collect():
        assert r.n_removed == len(set(want.get(r.doc_id, []))), r.doc_id
    assert linededup.without_duplicate_lines(empty).count() == 0
    assert linededup.within("a b c".split(), "a c".split(), 1) and not linededup.within("a b".split(), "b a".split(), 1)


def test_equal_short_lines_go(spark):
    rows = [(1, "All rights reserved.\n\nHome"), (2, "All  rights reserved.\n\nAll rights reserved"), (3, "Home\nMenu\nHome"), (4, "a b c d"), (5, "a b c d e"), (6, "a b c d")]
    out = linededup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.text for r in out.select("doc_id", "_lines.text").collect()}
    assert got == {1: rows[0][1], 2: "\nAll rights reserved", 3: "Menu", 4: "a b c d", 5: "a b c d e", 6: ""}
    assert linededup.brute_force(rows) == {2: [0], 3: [0, 2], 6: [0]}


def test_lines_of_rows_that_share_an_id(spark):
    rows = [(1, "a b c d e f"), (None, "x1 x2 x3 x4 x5\nclean one\na b c d e f"), (None, "a b c d e f\nclean two\nclean three"), (None, None),
            (7, "clean four\na b c d e z"), (7, "a b c d e f\nclean five"), (7, "a b c d e f\nclean five")]
    want = linededup.brute_force(rows, by_text=True)
    assert want[(None, rows[1][1])] == [2] and want[(None, rows[2][1])] == [0] and want[(7, rows[5][1])] == [0, 0]
    out = linededup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "_lines.*").collect()
    assert len(out) == len(rows)
    for r in out:
        gone = set(want.get((r.doc_id, r.text), []))
        left = None if r.text is None else "\n".join(s for n, s in enumerate(r.text.split("\n")) if n not in gone)
        assert (r[2], r.n_removed) == (left, len(gone)), r


def test_curriculum(docs, empty):
    rows = [r.asDict() for r in curriculum.mixed(docs).collect()]
    assert len(rows) == docs.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    source = collections.Counter()
    for r in docs.collect():
        source[r.source] += len(WORD.findall(r.text or ""))
    names = sorted((s for s in source if s is not None)) + ([None] if None in source else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, full = sum(source.values()), {}, set()
    while True:  # share, stop at the cap, share what is left again
        left = total - sum(3 * source[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * source[s] if s in full else left * weight[s] / open_weight for s in names}
        over = {s for s in names if target[s] > 3 * source[s] and s not in full}
        if not over:
            break
        full |= over
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]])
    order = [r.position for r in curriculum.training_order(docs).collect()]
    assert order == sorted(order) and 0 <= order[0] and order[-1] <= 1
    assert curriculum.mixed(empty).count() == 0


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return root


@pytest.mark.parametrize("leaf,tile", [(128, 512), (1, 2)])
def test_chosen_path(docs, empty, leaf, tile, monkeypatch):
    monkeypatch.setattr(chosenpath, "LEAF", leaf)
    monkeypatch.setattr(chosenpath, "TILE", tile)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    root = brute_classes(rows)
    smallest = {}
    for r, (i, _) in zip(root, rows):
        smallest[r] = min([x for x in (smallest.get(r), i) if x is not None], default=None)
    want = collections.Counter((i, smallest[r]) for r, (i, _) in zip(root, rows))
    got = collections.Counter((r.doc_id, r.class_id) for r in chosenpath.near_duplicates(docs).collect())
    assert got == want
    if leaf > 1:
        kept = chosenpath.keep_first(docs)
        assert kept.columns == docs.columns and chosenpath.keep_first(empty).count() == 0
        blank = sum(not WORD.search(t or "") for _, t in rows)
        assert kept.count() == len(set(root)) and sum(not WORD.search(r.text or "") for r in kept.collect()) == blank


def test_runs_reach_the_recall():
    assert 1 - (1 - 0.8**chosenpath.DEPTH) ** chosenpath.n_runs(0.8, 0.99) >= 0.99


def test_runs_do_not_share_orders():
    """More than 128 different near copies: links found of those at 0.8 to 0.82, with every node split to the last step."""
    rng = np.random.default_rng(4)
    base = rng.integers(1 << 63, size=400).astype(np.uint64)
    sets = []
    for _ in range(600):
        own = base.copy()
        own[rng.permutation(400)[:22]] = rng.integers(1 << 63, size=22).astype(np.uint64)
        sets.append(np.unique(own))
    last = chosenpath.paths(sets, chosenpath.n_runs(0.8, chosenpath.RECALL))[:, :, -1]
    found = pairs = 0
    for i in range(len(sets)):
        for j in range(0, i, 3):
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 0.8 <= shared / (len(sets[i]) + len(sets[j]) - shared) < 0.82:
                pairs += 1
                found += (last[i] == last[j]).any()
    assert pairs > 5_000 and found / pairs >= 0.998


def test_leak_between_diagonals(spark):
    rng = random.Random(12)
    item = [f"{rng.randrange(10**9)}w" for _ in range(304)]
    new = lambda n: [f"{rng.randrange(10**9)}x" for _ in range(n)]
    text = new(100) + new(14) + item[14:152] + new(28) + item[152:290] + new(14) + new(120)
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text[:240]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    b, best = {tuple(item[i : i + 5]) for i in range(300)}, (0, 0)
    for s in range(len(text) - 303):
        a = {tuple(text[s + i : s + i + 5]) for i in range(300)}
        best = max(best, (len(a & b) / len(a | b), -s))
    got = decontaminate.leaks(docs, bench).collect()
    assert best[0] >= 0.8 and [(r.doc_id, r.item_id, r.start) for r in got] == [(1, 1, -best[1])] and got[0].similarity == pytest.approx(best[0])


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    item = sentence(rng, 30).split()
    edited = item.copy()
    edited[15] = "edit"
    loose = item.copy()
    loose[5] = loose[12] = loose[20] = "edit"
    extra = [(100, "start " + " ".join(item) + " end"), (101, sentence(rng, 30) + " " + " ".join(edited[:29] + ["z"])),
             (102, " ".join(loose)), (103, " ".join(item[:15])), (104, "a b c"), (105, sentence(rng, 20) + " a b c " + sentence(rng, 9)), (106, "z a b c")]
    rows = spark.createDataFrame([(i, t, "en", "s", 1, "a", 1, "b", 2) for i, t in extra], SCHEMA).unionByName(docs)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "a b c"), (5, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(rows, bench).collect()}

    def best(text, of):
        w, v, top = WORD.findall(text or ""), WORD.findall(of or ""), 0
        if not w or not v:
            return 0
        b = collections.Counter(tuple(v[i : i + 5]) for i in range(max(1, len(v) - 4)))
        for s in range(max(1, len(w) - len(v) + 1)):
            x = w[s : s + len(v)]
            a = collections.Counter(tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4)))
            top = max(top, sum((a & b).values()) / sum((a | b).values()))
        return top

    want = {(r.doc_id, b.item_id): s for r in rows.collect() for b in bench.collect() if (s := best(r.text, b.text)) >= 0.8}
    assert got == pytest.approx(want) and (100, 1) in got and (102, 1) not in got and {(i, 4) for i in (104, 105, 106)} <= set(got)
    assert decontaminate.clean(empty, bench).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


def test_grammar():
    lexicon = toxicity.Lexicon(("grumpf",))
    assert toxicity.stems_of({"grum": 10, "grump": 10, "grumpf": 10, "grumpfa": 4}) == ("grumpf",)
    assert lexicon.get("grumpfling") == toxicity.INSULT and lexicon.get("grumble") == toxicity.OTHER
    plain, aimed = toxicity.matches("an idiot stood there", lexicon), toxicity.matches("you idiot stood there", lexicon)
    negated, told = toxicity.matches("never an idiot", lexicon), toxicity.matches("she said a b c d e f idiot", lexicon)
    assert len({tuple(np.flatnonzero(x[:16])) for x in (plain, aimed, negated, told)}) == 4
    assert not toxicity.matches(None, lexicon).any() and not toxicity.matches("said you not", lexicon).any()


def test_toxicity_on_labels(spark, docs, labels, empty):
    folder = "/root/testdata/sf0.01"
    rows, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = toxicity.scored(rows, toxicity.learn(rows, marks)).join(marks, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.predicted == (r.score >= 0.3) for r in out)
    assert sum(r.predicted == r.toxic for r in out) / len(out) > 0.93
    odd = toxicity.scored(docs, toxicity.learn(docs, labels)).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.scored(empty, toxicity.learn(empty, labels)).count() == 0


def test_license_scan(spark):
    rows = [(1, "r/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "r/a/x.txt", "plain"), (3, "r/a/b/COPYING.md", "Released under the MIT License."),
            (4, "r/a/b/c/y", "text\n// All rights reserved.\nmore"), (5, "r/a/b/c/z", None), (6, None, "Licensed under CC BY-NC 4.0."), (7, None, ""), (8, "q/w", "my fishing license costs a lot of money"), (5, "r/a/b/c/z", None)]
    files = spark.createDataFrame([(*r, "x") for r in rows], "id long, path string, text string, license string")
    out = {r.id: (r.license, r.origin, r.from_dir) for r in licenses.scan(files).collect()}
    assert out == {
        1: ("Apache-2.0", "own", None), 2: ("Apache-2.0", "inherited", "r"), 3: ("MIT", "own", None), 4: ("Proprietary", "own", None),
        5: ("MIT", "inherited", "r/a/b"), 6: ("CC-BY-NC", "own", None), 7: (None, "none", None), 8: (None, "none", None),
    }
    assert licenses.scan(files).count() == len(rows) and licenses.scan(files.limit(0)).count() == 0


def test_license_texts_and_frequencies(spark):
    mit = "\n\n".join(licenses.MIT_TEXT)
    header = "#!/bin/sh\n# Copyright 2024 Acme Widgets\n#\n" + re.sub(r"(.{40,60}) ", r"# \1\n", licenses.APACHE_HEADER).replace("\nS", "\n# S") + "\nrun_this --now\n"
    rows = [(1, "a/x", "Code and text here are licensed under CC BY-NC 4.0."), (2, "b/x", "zork plugh\n\n" + mit.replace(", ", ",\n") + "\n\nxyzzy"),
            (3, "c/x", "Copyright 2024 Acme. All rights reserved."), (4, "d/LICENSE", "MIT License\n\nCopyright (c) 2019 Jo Doe\n\n" + mit), (5, "e/x.sh", header),
            (6, "f/x.c", "// SPDX-License-Identifier: GPL-2.0-only\nint x;"), (7, "g/x.c", "/* SPDX-License-Identifier: MIT OR Zlib */"), (8, "d/y", None),
            (9, "h/COPYING", dict(licenses.templates()[-8:])["MPL-2.0"]), (10, "i/x", "a permission slip costs a lot of money here"), (11, "j/x", licenses.MIT_TEXT[0])]
    files = spark.createDataFrame(rows, "id long, path string, text string")
    many = spark.range(100, 200_100).selectExpr("id", "'z/' || id as path", "'code and text here are under this or that of the software' as text")
    out = {r.id: (r.license, r.origin) for r in licenses.scan(files.unionByName(many)).filter("id < 100").collect()}
    assert out == {
        1: ("CC-BY-NC", "own"), 2: ("MIT", "own"), 3: ("Proprietary", "own"), 4: ("MIT", "own"), 5: ("Apache-2.0", "own"), 6: ("GPL", "own"),
        7: ("MIT OR Zlib", "own"), 8: ("MIT", "inherited"), 9: ("MPL-2.0", "own"), 10: (None, "none"), 11: ("MIT", "own"),
    }


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, kept, folder)
        assert out.columns == docs.columns and 0 < out.count() <= kept.count(), number
        kept = out
    good = spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1").join(docs, "doc_id")
    first = corpus_pipeline.STAGES[0][1](spark, docs, folder).join(good.select("doc_id"), "doc_id").count()
    long_enough = sum(not m[0] < 50 and not 100 * m[4] > 50 * m[0] for m in map(quality.measure, [r.text for r in good.collect()]))
    assert first >= 0.97 * long_enough
    mixed = corpus_pipeline.run(spark, folder)
    assert mixed.count() > 0 and "position" in mixed.columns
