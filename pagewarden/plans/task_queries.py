"""Registered queries over task texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewarden.functions.joins import only_asked
from pagewarden.functions.staging import staged
from pagewarden.functions.text import text_or_blank
from pagewarden.operators import tasks as O
from pagewarden.operators.privacy import sanitize_elements
from pagewarden.plans.target_queries import _elements
from pagewarden.sources import derived as D


def context_elements(spark, sf, asked):
    """Context elements of the pages that are asked about: sanitized in their row, known by tag only, kept once."""
    return staged(
        sanitize_elements(only_asked(_elements(spark, sf), asked, ["page_id"])).select(
            "page_id", "ord", F.lit("").alias("type"), "tag", "input_type", "text", "aria_label",
            "placeholder", "name", "id", "value",
        )
    )


def infer_task_constraint(spark, sf):
    rows = O.infer_task_constraint(D.tasks(spark, sf))
    return rows.select("event_id", "intent", "type_target", "type_value", "click_target")


def resolve_sequence_targets(spark, sf):
    rows = O.resolve_sequence_targets(O.infer_task_constraint(D.tasks(spark, sf)), _elements(spark, sf))
    rows = rows.filter(F.col("intent") == "sequence")
    return rows.select("event_id", "page_id", "type_target", "type_value", "click_target")


def missing_user_info(spark, sf):
    return D.tasks(spark, sf).select("event_id", O.missing_user_info(text_or_blank("task")).alias("missing"))


def type_requirements(spark, sf):
    rows = D.tasks(spark, sf).select("event_id", F.explode_outer(O.type_requirements_expr("task")).alias("r"))
    return rows.filter(F.col("r").isNotNull()).select("event_id", "r.req_no", "r.value", "r.target")


def click_target(spark, sf):
    return D.tasks(spark, sf).select("event_id", O.click_target(text_or_blank("task")).alias("click_target"))


def enforce_requirements(spark, sf):
    asked = D.tasks(spark, sf)
    rows = O.next_step(asked, context_elements(spark, sf, asked))
    return rows.select(
        "event_id", F.coalesce("step_status", F.lit("plan")).alias("status"), "step_reason", "step_action",
        "step_target", "step_value",
    )


# The action whose finality is asked, by event.
FINAL_ACTION = (
    "case event_id % 5 when 0 then 'click' when 1 then ' CLICK ' when 2 then 'click' when 3 then 'type' else 'click' end"
)
FINAL_TARGET = (
    "case event_id % 4 when 0 then 'Search' when 1 then 'the  search results' when 2 then 'Save' else ' ' end"
)


def final_click_action(spark, sf):
    rows = D.tasks(spark, sf).withColumns({"a": F.expr(FINAL_ACTION), "t": F.expr(FINAL_TARGET)})
    return rows.select("event_id", O.is_final_click("task", "a", "t").alias("is_final"))


def page_shows_success(spark, sf):
    return D.form_pages(spark, sf).select("page_id", O.page_shows_success("page_text").alias("success"))


QUERIES = {
    "infer_task_constraint": infer_task_constraint,
    "resolve_sequence_targets": resolve_sequence_targets,
    "missing_user_info": missing_user_info,
    "type_requirements": type_requirements,
    "click_target": click_target,
    "enforce_requirements": enforce_requirements,
    "final_click_action": final_click_action,
    "page_shows_success": page_shows_success,
}
