"""Limits per task as actions arrive, in any order.

A task breaks a limit at the latest one row after the action limit, so its verdict
follows from its ``HEAD`` smallest rows by (ts, event_id). That is all the state a
task has: the smallest rows of two sets are the smallest of their smallest, so it
can be kept for any part of the rows and merged. Each task of a micro-batch first
cuts the rows it reads to the smallest of each task, whoever owns them, and only
those meet in the task's state. The verdict is worked out anew when a row enters the
head; a late row can move it to another step, so a changed verdict replaces the
one before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pagewarden.functions import fixed

HEAD = fixed.MAX_ACTIONS + 1
ROW_SCHEMA = "ts_us bigint, event_id bigint, is_replan boolean"
VERDICT_SCHEMA = "step int, breach string"
OUTPUT_SCHEMA = "task_id bigint, step int, breach string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELD_ROWS = 1 << 16  # rows that a task of a micro-batch holds before it cuts them again


def smallest(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of each task that can be in its head."""
    return rows.sort_values(["ts_us", "event_id"], kind="stable").groupby("task_id", sort=False, dropna=False).head(HEAD)


def cut_to_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Smallest rows of each task among the rows of one partition; memory is bounded."""
    held = None
    for rows in batches:
        held = smallest(rows if held is None else pd.concat([held, rows]))
        if len(held) > HELD_ROWS:
            yield held
            held = None
    if held is not None:
        yield held


def verdict(head: list[tuple], unit_us: int) -> tuple[int, str] | None:
    """(step, breach) of the first limit that sorted (ts_us, event_id, is_replan) rows break."""
    replans = 0
    for seen, (ts_us, _, is_replan) in enumerate(head):
        if ts_us - head[0][0] > fixed.MAX_SECONDS * unit_us:
            return seen + 1, "runtime"
        if seen >= fixed.MAX_ACTIONS:
            return seen + 1, "actions"
        if replans > fixed.MAX_REPLANS:
            return seen + 1, "replans"
        replans += bool(is_replan)
    return None


class BudgetProcessor(StatefulProcessor):
    """Emits a task's verdict when it changes; ``idle_ms`` after its last batch a task is forgotten."""

    def __init__(self, unit_us: int = 1_000_000, idle_ms: int | None = None) -> None:
        self.unit_us, self.idle_ms = unit_us, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getListState("head", ROW_SCHEMA)
        self.said = handle.getValueState("said", VERDICT_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        before = [tuple(r) for r in self.head.get()] if self.head.exists() else []
        head = before
        for chunk in rows:
            new = zip(chunk["ts_us"].tolist(), chunk["event_id"].tolist(), map(bool, chunk["is_replan"].tolist()))
            head = sorted([*head, *new])[:HEAD]
        if head == before:
            return
        self.head.put(head)
        now = verdict(head, self.unit_us)
        was = tuple(self.said.get()) if self.said.exists() else None
        if now is not None and now != was:
            self.said.update(now)
            yield pd.DataFrame({"task_id": [key[0]], "step": [now[0]], "breach": [now[1]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.head.clear()
        self.said.clear()
        return iter([])

    def close(self) -> None:
        pass


def budget_stream(log: DataFrame, unit_us: int = 1_000_000, idle_ms: int | None = None) -> DataFrame:
    """log(task_id, ts, event_id, is_replan) as a stream to verdicts.

    ``unit_us`` is the length of one second of the limit in microseconds of
    ``ts``. Whatever the order of arrival, the last verdict of a task is that of
    the batch rule over all its rows so far; rows that are equal count each time.
    A later verdict of a task replaces the earlier one (``latest_breaches``). Once
    a limit is broken no row can undo it, but it may turn out to be another one.
    Rows without a time count first, and the limit of time then does not run.

    A head stays for good unless ``idle_ms`` is given: then a task without rows
    for that long, by the clock of the cluster, is forgotten, and rows that come
    after that start a new one, which may break a limit again.
    """
    rows = log.selectExpr(
        "task_id", "coalesce(unix_micros(cast(ts as timestamp)), -9223372036854775807) as ts_us",
        "coalesce(event_id, -9223372036854775807) as event_id", "coalesce(is_replan, false) as is_replan",
    )
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(cut_to_heads, kinds).groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=BudgetProcessor(unit_us, idle_ms),
        outputStructType=OUTPUT_SCHEMA,
        outputMode="Update",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )


def write_breaches(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch under its own number, so a repeated batch overwrites itself.

    ``checkpoint`` is the caller's folder: a stream that starts again with it goes
    on after the last batch that was written.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        rows.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_breaches(spark: SparkSession, path: str) -> DataFrame:
    """The verdict that stands for each task."""
    batches = spark.read.option("basePath", path).schema(f"{OUTPUT_SCHEMA}, batch bigint").parquet(f"{path}/batch=*")
    last = batches.groupBy("task_id").agg(F.max_by(F.struct("step", "breach"), "batch").alias("b"))
    return last.select("task_id", "b.step", "b.breach")
