"""Line deduplication: only variants that another row has are grouped by place."""

from pyspark.sql import functions as F

from pagewarden.llm import linededup


def test_lone_variants_go_no_further(spark, monkeypatch):
    kept, written = {}, linededup.written
    monkeypatch.setattr(linededup, "written", lambda df, folder, name: kept.setdefault(name, written(df, folder, name)))
    # Lines share their first half, so all get variants; two pairs are one word apart, one has a word twice.
    head = "one two three four five six"
    texts = [f"{head} a{n} b{n} c{n} d{n} e{n} f{n}" for n in range(40)]
    texts += [f"{head} x y z u v w", f"{head} x y z u v other", f"{head} x y z u v", f"{head} p p q r s t"]
    rows = [(n, t) for n, t in enumerate(texts)]
    docs = linededup.drop_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    gone = {r.doc_id for r in docs.filter("_lines.n_removed > 0").collect()}
    assert gone == set(linededup.brute_force(rows)) == {41, 42}
    variants, places = kept["variants"], kept["places"]
    assert variants.count() > 500
    shared = {r.v1 for r in variants.groupBy("v1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").collect()}
    assert {r.v1 for r in places.collect()} == shared and 0 < len(shared) < 20
