"""Limits on a stream: any order of arrival gives the batch rule, also across a stop."""

import datetime
import os
import random

import pandas as pd
import pytest

from pagewarden.operators import policy
from pagewarden.streaming import budget

LOG = "task_id bigint, ts timestamp, event_id bigint, elapsed_s bigint, is_replan boolean"
START = datetime.datetime(2024, 1, 1)


def sample_log():
    rng = random.Random(9)
    log = []
    for task in range(40):
        at = START + datetime.timedelta(hours=task)
        pace = rng.choice([2, 5, 9])
        for n in range(rng.choice([3, 12, 25, 60])):
            log.append((task, at + datetime.timedelta(seconds=n * pace // 2 * 2), len(log) % 7, n * pace // 2 * 2, rng.random() < 0.4))
    log += [(99, START + datetime.timedelta(seconds=n), n, n, False) for n in range(len(log))]  # half of all rows
    return log


def put(spark, folder, number, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(f"{folder}/b={number}")
    for part in (folder / f"b={number}").glob("*.parquet"):  # files are taken by age
        os.utime(part, (1_700_000_000 + 60 * number, 1_700_000_000 + 60 * number))


@pytest.mark.parametrize("seed", [None, 1])
def test_any_order_gives_the_batch_rule(spark, tmp_path, seed):
    log = sample_log()
    if seed is not None:
        random.Random(seed).shuffle(log)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", budget.STATE_STORE)
    third = len(log) // 3 + 1

    def run():
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = budget.write_breaches(budget.budget_stream(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        query.awaitTermination()

    put(spark, tmp_path / "in", 0, log[:third])
    run()  # stops after one batch; the next run goes on from the checkpoint
    put(spark, tmp_path / "in", 1, log[third : 2 * third])
    put(spark, tmp_path / "in", 2, log[2 * third :])
    run()
    got = {r.task_id: (r.step, r.breach) for r in budget.latest_breaches(spark, f"{tmp_path}/out").collect()}
    want = {r.task_id: (r.step, r.breach) for r in policy.budget_breaches(spark.createDataFrame(log, LOG)).collect()}
    assert got == want and {b for _, b in want.values()} == {"runtime", "actions", "replans"}


def test_few_rows_of_a_task_leave_a_partition():
    rows = pd.DataFrame({"task_id": [1] * 50_000 + [2], "ts_us": [*range(50_000, 0, -1), 3], "event_id": range(50_001), "is_replan": False})
    out = pd.concat(budget.cut_to_heads(iter([rows[:20_000], rows[20_000:]])))
    assert len(out) == budget.HEAD + 1 and out.loc[out.task_id == 1, "ts_us"].max() == budget.HEAD
