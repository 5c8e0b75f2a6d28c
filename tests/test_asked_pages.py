"""Page states of the step queries: only pages that are asked about are sanitized, few large files are dealt."""

import datetime

import pytest
from pyspark.sql import functions as F

from pagewarden.functions.pii import is_credential
from pagewarden.plans import flow_queries, task_queries
from pagewarden.sources import derived as D

ASKED = (3, 5)


@pytest.fixture()
def tables(spark, tmp_path):
    customers = [(n, f"Customer#{n:09d}", "BUILDING") for n in range(1, 40)]
    spark.createDataFrame(customers, "c_custkey bigint, c_name string, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    start = datetime.datetime(2024, 1, 1)
    events = [(n, start, user, "click") for n in range(44) for user in [*ASKED, None] if (n + (user or 0)) % 2]
    spark.createDataFrame(events, "event_id bigint, ts timestamp, user_id bigint, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("query", [task_queries.enforce_requirements, flow_queries.agent_decision_batch])
def test_only_asked_pages_are_sanitized(spark, tables, monkeypatch, query):
    kept, staged = [], task_queries.staged
    monkeypatch.setattr(task_queries, "staged", lambda df: kept.append(staged(df)) or kept[-1])
    rows = query(spark, tables)
    assert {r.page_id for r in kept[0].select("page_id").distinct().collect()} == set(ASKED)
    assert rows.count() == D.read_table(spark, tables, "events").count()
    found = "step_status" if "step_status" in rows.columns else "status"
    assert rows.filter(F.col(found) == "ready").count() > 0


def test_events_of_one_file_are_dealt(spark, tables):
    for rows in (D.tasks(spark, tables), D.model_texts(spark, tables)):
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_words_of_credentials_in_any_spelling(spark):
    labels = ["Pin  Code", "pin-code", "pincode", "api_key", "API\tKEY", "apikey", "my OTP", "opt", "Passwd!", "", None, "code pin"]
    rows = spark.createDataFrame([(x,) for x in labels], "label string").select("label", is_credential(F.lit("text"), "label").alias("c"))
    assert [r.label for r in rows.collect() if r.c] == ["Pin  Code", "pin-code", "api_key", "API\tKEY", "my OTP", "Passwd!"]
