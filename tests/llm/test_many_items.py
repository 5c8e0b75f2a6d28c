"""Decontamination against many items: entries of items are not sent whole to every task, texts without windows not at all."""

import random

from pagewarden.llm import decontaminate


def _tables(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(k, [word() for _ in range(rng.choice((12, 12, 20, 31)))]) for k in range(40)]
    items.append((40, items[3][1]))
    docs = [(k, " ".join([word() for _ in range(30)] + items[k % 40][1] + [word() for _ in range(20)])) for k in range(0, 60, 2)]
    docs += [(100 + k, " ".join(word() for _ in range(60))) for k in range(30)] + [(0, docs[0][1]), (200, None)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    return spark.createDataFrame(docs, "doc_id long, text string"), bench


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_many_items_are_not_broadcast(spark, monkeypatch):
    docs, bench = _tables(spark)
    few = _rows(decontaminate.leaks(docs, bench))
    planted = {(k, k % 40) for k in range(0, 60, 2)} | {(k, 40) for k in range(0, 60, 2) if k % 40 == 3}
    assert {r[:2] for r in few} == planted and all(r[2:] == (30, 1.0) for r in few)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", 0, raising=False)
    many = decontaminate.leaks(docs, bench)
    plan = many._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :|+-"))
    for at, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = next((k for k in range(at + 1, len(plan)) if depth(plan[k]) <= depth(line)), len(plan))
            assert not any("Generate" in x for x in plan[at:below]), "\n".join(plan[at:below])
    assert _rows(many) == few
