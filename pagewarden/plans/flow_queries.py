"""Registered queries over the composed flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewarden.plans import flows
from pagewarden.plans.policy_queries import _first_action
from pagewarden.plans.target_queries import _elements
from pagewarden.plans.task_queries import context_elements
from pagewarden.sources import derived as D


def inspect_rows(states):
    """Flat view of sanitized states."""
    return states.select(
        "page_id", "url", "page_text", "findings", F.array_join("types", ",").alias("types"),
        F.size("elements").alias("elements"),
        F.size(F.filter("elements", lambda e: e["value"].startswith("["))).alias("masked"),
        F.array_join(F.transform("elements", lambda e: e["text"]), "|").alias("texts"),
    )


def inspect_batch(spark, sf):
    return inspect_rows(flows.inspect_batch(D.payloads(spark, sf)))


def agent_decision_batch(spark, sf):
    asked = D.model_texts(spark, sf)
    rows = flows.agent_decisions(asked, context_elements(spark, sf, asked))
    return rows.select("event_id", "success", "error", "status", "reason", *_first_action("actions"))


def loop_replay(spark, sf):
    return flows.loop_replay(
        D.loop_cycles(spark, sf), _elements(spark, sf), D.LOOP_VALUE_AFTER, D.LOOP_CLICK_VERIFIED
    )


QUERIES = {
    "inspect_batch": inspect_batch,
    "agent_decision_batch": agent_decision_batch,
    "loop_replay": loop_replay,
}
