"""Registered queries that run a finite stream over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewarden.functions.staging import work_folder
from pagewarden.plans.flow_queries import inspect_rows
from pagewarden.sources import derived as D
from pagewarden.streaming import budget, inspect

# One second of the limit is an hour of the event log; views, clicks and signups replan.
UNIT_US = 3_600_000_000
REPLANS = "event_type in ('view', 'click', 'signup')"


def _stream(spark, sf, name):
    """The table's file as a stream source."""
    schema = D.read_table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def inspect_stream(spark, sf):
    folder = work_folder(spark)
    payloads = _stream(spark, sf, "customer").selectExpr("c_custkey as page_id", f"{D.PAYLOAD} as payload")
    query = inspect.write_stream(inspect.inspect_stream(payloads), f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    return inspect_rows(spark.read.parquet(f"{folder}/out"))


def budget_stream(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", budget.STATE_STORE)
    folder = work_folder(spark)
    log = _stream(spark, sf, "events").selectExpr(
        "user_id as task_id", "ts", "event_id", f"{REPLANS} as is_replan"
    )
    query = budget.write_breaches(
        budget.budget_stream(log, UNIT_US), f"{folder}/out", f"{folder}/checkpoint"
    )
    query.awaitTermination()
    return budget.latest_breaches(spark, f"{folder}/out").select(
        "task_id", F.col("step").cast("bigint").alias("step"), "breach"
    )


QUERIES = {"inspect_stream": inspect_stream, "budget_stream": budget_stream}
