"""Popup targets: the forms of a request are kept with it, and the log is not numbered to be asked about."""

import datetime

from pagewarden.operators import targets
from pagewarden.plans import policy_queries

ELEMENT = "page_id bigint, ord int, type string, tag string, input_type string, text string, aria_label string, placeholder string, name string, id string"


def test_forms_are_kept_with_requests(spark, monkeypatch):
    kept, staged = [], targets.staged
    monkeypatch.setattr(targets, "staged", lambda df: kept.append(staged(df)) or kept[-1])
    elements = spark.createDataFrame(
        [(1, 0, "input", "input", "", "", "", "Your Name", "name", ""), (1, 1, "button", "button", "", "Search  now", "", "", "", "")], ELEMENT
    )
    asked = [(1, "type", "name field"), (1, " Click ", "the button"), (1, "click", " search now button "), (1, "click", None), (1, None, " "), (None, "type", "x")]
    got = targets.canonical_actions(spark.createDataFrame(asked, "page_id bigint, action string, target string"), elements)
    assert {(r.action, r.target): r.canonical for r in got.collect()} == {
        ("type", "name field"): "Your Name", (" Click ", "the button"): "the button", ("click", " search now button "): "Search  now",
        ("click", None): None, (None, " "): " ", ("type", "x"): "",
    }
    assert {"kind", "norm", "needle"} <= set(kept[0].columns)


def test_requests_of_cycles_are_not_numbered(spark, monkeypatch, tmp_path):
    asked, canonical = [], policy_queries.canonical_actions
    monkeypatch.setattr(policy_queries, "canonical_actions", lambda r, e: asked.append(r) or canonical(r, e))
    spark.createDataFrame([(1, "Customer#1", "BUILDING")], "c_custkey bigint, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    events = [(n, datetime.datetime(2024, 1, 1, n % 24), 1, "click") for n in range(30)]
    spark.createDataFrame(events, "event_id bigint, ts timestamp, user_id bigint, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert policy_queries.cycle_status(spark, str(tmp_path)).count() == 30
    assert "Window" not in asked[0]._jdf.queryExecution().optimizedPlan().toString()
