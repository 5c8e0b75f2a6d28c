"""The keyed sink: overlapping keys, repeated and broken writes, folds."""

from pagewarden.sources import results

SCHEMA = "k string, status string, n int"


def put(spark, path, number, rows):
    results.write(spark.createDataFrame(rows, SCHEMA), path, number, ["k"], buckets=3)


def held(spark, path):
    return {r.k: (r.status, r.n) for r in results.read(spark, path, SCHEMA, ["k"]).collect()}


def test_later_writes_win(spark, tmp_path):
    path = f"file://{tmp_path}/sink"
    assert held(spark, path) == {}
    results.fold(spark, path, SCHEMA, ["k"])
    put(spark, path, 0, [("a", "new", 1), ("b", "new", 1), (None, "x", 0)])
    put(spark, path, 1, [("a", "done", None), ("c", None, 3)])
    want = {"a": ("done", 1), "b": ("new", 1), None: ("x", 0), "c": (None, 3)}
    assert held(spark, path) == want
    put(spark, path, 1, [("a", "done", None), ("c", None, 3)])  # again
    assert held(spark, path) == want
    results.fold(spark, path, SCHEMA, ["k"])
    assert held(spark, path) == want
    put(spark, path, 1, [("a", "done", None), ("c", None, 3)])  # again, after the fold
    put(spark, path, 2, [("b", None, 7)])
    assert held(spark, path) == {**want, "b": ("new", 7)}
    results.fold(spark, path, SCHEMA, ["k"])
    assert held(spark, path) == {**want, "b": ("new", 7)}


def test_a_write_without_a_marker_is_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/sink"
    put(spark, path, 0, [("a", "new", 1)])
    put(spark, path, 1, [("a", "lost", 2)])
    results._unmark(spark, path, "write=1")  # as if the driver had died before
    assert held(spark, path) == {"a": ("new", 1)}
    put(spark, path, 1, [("b", "late", 2)])
    assert held(spark, path) == {"a": ("new", 1), "b": ("late", 2)}
