"""Containment by rarest grams: brute force, and values that all begin alike."""

import random

from pyspark.sql import functions as F

from pagewarden.functions import joins


def test_rare_contains_join_is_brute_force(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé9") for _ in range(n))
    hays = [(k, word(rng.randint(0, 30))) for k in (1, 2) for _ in range(120)] + [(1, None)]
    needles = [(k, word(n)) for k in (1, 2, 3) for n in (0, 1, 2, 3, 4, 7, 8, 9, 12) for _ in range(6)] + [(2, None)]
    needles += [(k, h[3:14]) for k, h in hays[::7] if h]
    got = joins.rare_contains_join(
        spark.createDataFrame(needles, "k int, n string"), spark.createDataFrame(hays, "k int, h string"), ["k"], "n", "h"
    ).collect()
    want = {(k, n, h) for k, n in needles for j, h in hays if n and h and j == k and n in h}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_numbers_of_one_prefix(spark):
    """50,000 numbers that share five digits: no gram gathers many of them."""
    n = 50_000
    numbers = spark.range(n).select(F.lit(1).alias("k"), (F.lit(9876500000) + F.col("id") * 2).cast("string").alias("n"))
    hays = numbers.select("k", F.concat(F.lit("+91 "), F.col("n"), F.lit(" (home)")).alias("h"))
    per_gram = joins.rarest_grams(numbers, ["k"], "n").groupBy("_gram").count().agg(F.max("count")).first()[0]
    assert per_gram <= 2
    assert joins.gram_candidates(numbers, hays, ["k"], "n", "h").count() <= 2 * n
    found = joins.rare_contains_join(numbers, hays, ["k"], "n", "h")
    assert found.filter(F.col("h").contains(F.col("n"))).count() == n


def test_page_queries_broadcast_nothing(spark):
    """Elements are many times the rows of their file: no side of a keyed join goes through the driver."""
    import __spark_entry__

    queries = __spark_entry__.queries()
    for name in ("verify_select", "verify_type", "select_option", "match_selector", "leak_audit_unprotected", "validate_plan"):
        plan = queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan, name


def test_own_broadcast_limit_comes_back(spark):
    from pagewarden.session import configure

    limit = "spark.sql.autoBroadcastJoinThreshold"
    own = spark.conf.get(limit)
    try:
        spark.conf.set(limit, "256k")
        for _ in range(2):
            assert configure(spark, keyed_joins=True).conf.get(limit) == "-1"
        assert configure(spark).conf.get(limit) == "256k"
    finally:
        spark.conf.set(limit, own)


def test_rows_are_dealt_before_they_are_expanded(spark):
    """One file of one row group: all tasks get a share, and grouping by page or image exchanges nothing more."""
    import __spark_entry__
    from pagewarden.sources import derived as D

    sf = "/root/testdata/sf0.001"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for made in (D.form_elements, D.form_pages, D.form_states, D.form_html, D.ocr_words):
        assert made(spark, sf).rdd.getNumPartitions() == tasks, made.__name__
    queries = __spark_entry__.queries()
    for name in ("ocr_lines", "ocr_page_text", "sanitize_page_text", "privacy_summary"):
        plan = queries[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange " in line]
        assert exchanges and all("REPARTITION_BY_NUM" in line for line in exchanges), name
