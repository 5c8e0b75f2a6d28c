"""Packed profile rows: brute force over many runs, a very large page, and the plan's exchanges."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewarden.operators import profiles, targets
from pagewarden.plans import task_queries

ELEMENT = (
    "page_id bigint, ord int, type string, tag string, input_type string, text string, aria_label string, "
    "placeholder string, name string, id string, value string"
)
KINDS = {"any": {"button", "input", "textarea", "select", "a"}, "type": {"input", "textarea"}, "select": {"select"}, "click": {"button", "a"}}


def scored(rows, kind, target):
    """Best score, ties and first element by comparing the target with every element."""
    best = Counter()
    words = target.split()
    for _, ord_, _, tag, input_type, *fields in rows:
        if tag not in KINDS[kind] or input_type == "password":
            continue
        form = " ".join(f for f in fields[:5] if f).lower()
        tokens = form.split()
        score = sum(20 if w in tokens else 5 if any(w in t for t in tokens) else 0 for w in words) + 100 * (" ".join(tokens) == target)
        if score:
            best[ord_] = score
    top = max(best.values(), default=None)
    first = [o for o, s in best.items() if s == top]
    return top and (top, len(first), min(first))


@pytest.mark.parametrize("run,pack", [(1024, 1024), (7, 3)])
def test_runs_merge_to_brute_force(spark, monkeypatch, run, pack):
    monkeypatch.setattr(profiles, "RUN", run)
    monkeypatch.setattr(profiles, "PACK", pack)
    rng = random.Random(3)
    pool = ["save", "saved", "draft", "name", "first", "mail", "e", "next"]
    pick = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    rows = [
        (1, n, "", rng.choice(["button", "input", "select", "div"]), rng.choice(["", "", "password"]), pick(2), pick(rng.randint(0, 1)), "", pick(1), "", "v")
        for n in range(60)
    ]
    asked = {(rng.choice(list(KINDS)), pick(rng.randint(1, 3))) for _ in range(60)}
    got = targets.match_scored(
        spark.createDataFrame([(1, *a) for a in asked], "page_id bigint, kind string, target string"), spark.createDataFrame(rows, ELEMENT)
    ).collect()
    want = {(kind, target): scored(rows, kind, target) for kind, target in asked}
    assert {(r.kind, r.target): (r.score, r.ties, r.ord) for r in got} == {k: v for k, v in want.items() if v}


def test_very_large_page(spark):
    """Every element has the word that every target asks for."""
    n, m = 100_000, 10_000
    blank = F.lit("")
    elements = spark.range(n).select(
        F.lit(1).cast("bigint").alias("page_id"), F.col("id").cast("int").alias("ord"), blank.alias("type"), F.lit("input").alias("tag"),
        blank.alias("input_type"), blank.alias("text"), F.concat(F.lit("account a"), F.col("id"), F.lit("z")).alias("aria_label"),
        blank.alias("placeholder"), blank.alias("name"), blank.alias("value"), blank.alias("id_"),
    ).withColumnRenamed("id_", "id")
    requests = spark.range(m).select(
        F.lit(1).cast("bigint").alias("page_id"), F.lit("type").alias("kind"), F.concat(F.lit("the account a"), F.col("id") * 10, F.lit("z")).alias("target")
    )
    cells = profiles.cells(targets._packed_requests(requests), targets._packed_elements(elements))
    sizes = cells.select(F.size("requests").alias("r"), F.size("elements").alias("e"), F.spark_partition_id().alias("p")).collect()
    assert max(s.e for s in sizes) <= profiles.RUN and max(s.r for s in sizes) <= 2 * profiles.PACK
    assert len(sizes) < n * m / 100_000
    assert max(Counter(s.p for s in sizes).values()) < 0.5 * len(sizes)
    found = targets.resolve_bridge(requests, elements)
    number = F.regexp_extract("target", r"a(\d+)z", 1).cast("int")
    assert found.filter((F.col("ord") == number) & (F.col("rule") == "score")).count() == m


def test_few_exchanges(spark):
    plan = task_queries.enforce_requirements(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 10
