"""HyperMinHash links, metric-tree codes and stripe collocations against brute force, and on awkward rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from pagewarden.llm import collocations, hyperminhash, metrictree
from tests import harness

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, k string, set_id string, root long, n long, id long, next string, f long, size long"


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n)]


def rows_of(texts):
    return [(i, t, None if i % 7 == 0 else ("en", "de")[i % 2], "k", "s", 1, 2, 3, "x", 4, 5) for i, t in enumerate(texts)]


AWKWARD = [None, "", " \n\t ", "one", "ONE", "one two three four", "One two Three four", "a b c d e", "A B C D E f", "é É ß. x,y;z", "...", "w " * 5000]


@pytest.fixture(scope="module")
def near():
    rng = random.Random(4)
    base, texts = words(rng, 150), list(AWKWARD)
    for _ in range(150):  # a group whose members are near, but mostly not to each other
        x = list(base)
        for _ in range(rng.randint(1, 5)):
            x[rng.randrange(150)] = words(rng, 1)[0]
        texts.append(" ".join(x))
    for _ in range(120):  # pairs around the threshold
        x = words(rng, rng.randint(7, 600))
        y = list(x)
        for _ in range(rng.randint(1, max(1, len(x) // 55))):
            y[rng.randrange(len(y))] = words(rng, 1)[0]
        texts += [" ".join(x), " ".join(y).upper()]
    texts += texts[20:40]
    return rows_of(texts)


@pytest.mark.parametrize("tile", [512, 32])
def test_links_are_those_of_brute_force(spark, near, monkeypatch, tile):
    monkeypatch.setattr(hyperminhash, "TILE", tile)  # 32: the group takes hubs and bands
    got = hyperminhash.near_duplicates(spark.createDataFrame(near, DOCS)).collect()
    assert sorted(map(tuple, got)) == sorted(hyperminhash.brute_force([r[:2] for r in near]))


def test_links_of_null_and_repeated_ids(spark):
    text = " ".join(words(random.Random(1), 60))
    rows = [(None, text), (3, text), (3, text), (None, "other " + text[:100]), (None, None), (9, text + " tail")]
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted(
        [(None, 3, False), (3, 3, True), (3, 3, True), (None, None, True), (None, None, True), (9, 3, False)], key=str
    )


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(2)
    for size in (40, 400, 20_000):
        for share in (0.5, 0.85):
            both = int(size * share)
            tokens = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(tokens[:size]), np.sort(np.concatenate([tokens[:both], tokens[size : 2 * size - both]]))
            got = hyperminhash.estimates(hyperminhash.registers(a), hyperminhash.registers(b)[None], hyperminhash.chance(size))[0]
            assert abs(got - both / (2 * size - both)) < 0.17
    assert 0 < hyperminhash.chance(10) < 0.01 and 0 < hyperminhash.chance(1 << 24) < 0.01


def vectors(rng, n, dims=16):
    return [(i, [round(rng.gauss(i % 5, 0.4), 3) for _ in range(dims)]) for i in range(n)]


def test_codes_are_those_of_brute_force(spark):
    rng = random.Random(6)
    rows = vectors(rng, 700)
    rows += [(900 + i, rows[i % 3][1]) for i in range(90)]  # equal vectors, equal entries
    rows += [(i, rows[0][1]) for i in (-5, -4, -3)]
    full = [(i, v, None if i % 4 == 0 else i % 3, "c", 7) for i, v in rows]
    bad = [(1, None, 1, "c", 7), (2, [1.0, None] * 8, 1, "c", 7), (3, [float("nan")] * 16, 1, "c", 7), (4, [float("inf")] * 16, 0, "c", 7)]
    df = spark.createDataFrame(full + bad, "vec_id long, embedding array<double>, label int, code string, count long").repartition(3)
    got = metrictree.codes(df).collect()
    want = metrictree.brute_force(rows)
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted(want)
    errors: dict = {}
    for i, _, error in want:
        label = None if i % 4 == 0 else i % 3
        errors[label] = errors.get(label, 0) + error
    assert {(r.label, r.label_error) for r in got} == set(errors.items())
    assert len({r.codebooks_sha256 for r in got}) == 1


def test_codes_of_odd_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert metrictree.codes(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, [1.0] * 5, 1), (2, [], None), (3, [1e30, -1e30], 2), (3, [1.0], 2)]
    got = metrictree.codes(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 4 and {r.error for r in got} == {0}


def test_trees_hold_every_point_once():
    points = np.random.default_rng(1).integers(-40, 40, (900, 3))
    tree = metrictree.Tree.build(points)
    entries = points[:50].copy()
    far = ((points[:, None] - entries[None]) ** 2).sum(2)
    owner, error = tree.codes(entries)
    assert (owner == far.argmin(1)).all() and (error == far.min(1)).all()
    sums, counts = tree.settle(entries)
    assert counts.sum() == 900 and (sums.sum(0) == points.sum(0)).all()
    assert sum(cached is not None for *_, cached in tree.owners(entries)) > 0  # some balls are wholly owned
    assert len(metrictree.Tree.build(np.ones((300, 4), np.int64)).kids) == 1


@pytest.mark.parametrize("longest,chunk,merge", [(3, 2 << 20, 1 << 19), (4, 500, 40)])
def test_phrases_are_those_of_brute_force(spark, monkeypatch, longest, chunk, merge):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "MERGE_ROWS", merge)
    monkeypatch.setattr(collocations, "BROAD", 20)
    rng = random.Random(8)
    pool = ["The", "of", "ab", "Éa", "x-1", "a_b", "new", "york", "city"]
    texts = AWKWARD + [
        "".join(rng.choice(pool) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n"]) for _ in range(rng.randint(1, 400))) + "New York City"
        for _ in range(60)
    ]
    rows = rows_of(texts) + [(None, "new york " * 30, "", "k", "s", 1, 2, 3, "x", 4, 5)]
    got = collocations.collocations(spark.createDataFrame(rows, DOCS), longest=longest, top=50).collect()
    assert sorted(map(tuple, got)) == sorted(collocations.brute_force([(r[1], r[2]) for r in rows], longest=longest, top=50))


def test_phrases_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame(rows_of([None, "", "one two"]), DOCS)).count() == 0


@pytest.mark.parametrize("name", ["op11_hyperminhash", "op12_metric_tree_codes", "op13_stripe_collocations"])
def test_query(spark, name):
    assert name in entry.queries()
    assert harness.compare(spark, harness.connect(FOLDER), name, FOLDER) == ""


def test_a_pair_is_confirmed_in_its_first_band_only():
    rng = random.Random(7)
    base = words(rng, 150)
    texts = [" ".join(base), " ".join(base[:-1] + ["end"])]
    sets = [s for _, part in hyperminhash._sets(pa.array(texts)) for s in part]
    signs = [hyperminhash.registers(s) for s in sets]
    same = (signs[0] == signs[1])[: hyperminhash.ROWS * hyperminhash.BANDS].reshape(hyperminhash.BANDS, hyperminhash.ROWS).all(1)
    at = np.flatnonzero(same)
    assert len(at) > 1
    found = {
        k: hyperminhash._links([(1, None, b"%d" % n, k, s.tobytes(), t) for n, (s, t) in enumerate(zip(signs, texts))], 85)
        for k in [-1, *at.tolist()]
    }
    assert {k for k, links in found.items() if links} == {-1, at[0]}


def test_links_of_a_tile_lead_to_the_smallest_member():
    text = " ".join(words(random.Random(8), 200))
    texts = [text + f" tail{n}" for n in range(9)]
    signs = [hyperminhash.registers(s) for _, part in hyperminhash._sets(pa.array(texts)) for s in part]
    rows = [(1, None, b"%d" % (8 - n), -1, s.tobytes(), t) for n, (s, t) in enumerate(zip(signs, texts))]
    assert sorted(hyperminhash._links(rows, 85)) == [(b"0", b"%d" % n) for n in range(1, 9)]
    labelled = [(1, b"ab"[n % 2 : n % 2 + 1], *r[2:]) for n, r in enumerate(rows)]
    assert hyperminhash._links(labelled, 85) == [(b"a", b"b")]


def test_a_cluster_graph_has_the_hubs_of_bands_only(spark, near, monkeypatch):
    seen = {}
    plain = hyperminhash.components

    def counted(edges, folder, *more):
        seen[folder.rsplit("/", 1)[1]] = edges.filter("a <> b").distinct().count()
        return plain(edges, folder, *more)

    monkeypatch.setattr(hyperminhash, "components", counted)
    hyperminhash.near_duplicates(spark.createDataFrame(near, DOCS)).collect()
    assert seen["coarse"] < 200  # links of every set to the hubs of its bands are more: each set has one at least
