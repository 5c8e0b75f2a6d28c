"""Composed flows: protect, decide, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.functions import fixed
from pagewarden.functions.joins import only_asked
from pagewarden.functions.staging import staged
from pagewarden.functions.text import strip, text_or_blank
from pagewarden.operators import policy, privacy, tasks
from pagewarden.sources import pages as P


def sanitized_state(
    elements: DataFrame, pages: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sanitized elements, sanitized pages, findings) of page states.

    Elements are rewritten within their row; only the page text needs values
    from other rows. Address and title pass through unchanged.
    """
    findings = privacy.inspect_page(elements, pages)
    clean_elements = privacy.sanitize_elements(elements)
    clean_pages = privacy.sanitize_page_text(pages, findings)
    return clean_elements, clean_pages, findings


def inspect_batch(payloads: DataFrame) -> DataFrame:
    """JSON page states in; sanitized state and summary out, row by row."""
    return privacy.sanitize_states(P.payload_states(payloads))


def agent_decisions(requests: DataFrame, elements: DataFrame) -> DataFrame:
    """Answer per (task, page, logged model text).

    A blank task is an error, missing details block, the model text is parsed
    and validated, what the task requires overrides it, and the result is
    validated again.
    """
    blank = strip(text_or_blank("task")) == ""
    missing = tasks.missing_user_info(text_or_blank("task")) != ""
    parsed = policy.validate_model_plan(P.parse_plan_object(requests)).drop("plan")
    stepped = tasks.next_step(parsed, elements)
    target = strip("step_target")
    # Second validation of the step: what may fail is a blank target or a token.
    step_fault = F.when(F.coalesce(target, F.lit("")) == "", fixed.PLAN_NO_TARGET).when(
        F.col("step_value").isin(*fixed.TOKENS.values()), fixed.PLAN_TYPES_TOKEN
    )
    step = F.struct(
        F.col("step_action").alias("action"), target.alias("target"), F.col("step_value").alias("value")
    )
    none = F.array().cast(f"array<{policy.PLAN_STEP}>")
    acts = F.col("step_action").isNotNull()
    rows = stepped.withColumn("_fault", F.when(acts, step_fault)).withColumns(
        {
            "_status": F.when(F.col("step_status").isNull(), F.col("plan_status"))
            .when((F.col("step_status") == "blocked") | F.col("_fault").isNotNull(), "blocked")
            .otherwise("ready"),
            "_reason": F.when(F.col("step_status").isNull(), F.col("plan_reason")).otherwise(
                F.coalesce("_fault", "step_reason")
            ),
            "_actions": F.when(F.col("step_status").isNull(), F.col("plan_actions"))
            .when(acts & F.col("_fault").isNull(), F.array(step).cast(f"array<{policy.PLAN_STEP}>"))
            .otherwise(none),
        }
    )
    return rows.select(
        "event_id", "page_id",
        (~blank).alias("success"),
        F.when(blank, fixed.TASK_REQUIRED).alias("error"),
        F.when(blank, None).when(missing, "blocked").otherwise(F.col("_status")).alias("status"),
        F.when(blank, None).when(missing, fixed.PLAN_MISSING_INFO).otherwise(F.col("_reason")).alias("reason"),
        F.when(blank | missing, none).otherwise(F.col("_actions")).alias("actions"),
    )


def planned_actions(cycles: DataFrame) -> DataFrame:
    """Parse the action array of each cycle's model text into ``planned``."""
    parsed = P.parse_plan_array(cycles)
    return parsed.withColumn(
        "planned",
        F.transform(
            "plan",
            lambda a: F.struct(
                F.try_variant_get(a, "$.action", "string").alias("action"),
                F.try_variant_get(a, "$.target", "string").alias("target"),
                F.try_variant_get(a, "$.value", "string").alias("value"),
            ),
        ),
    ).drop("plan")


def decided_cycles(cycles: DataFrame, elements: DataFrame) -> DataFrame:
    """Cycles with the action the loop would take, before validation.

    Each earlier cycle of a running task added exactly one verified action, so
    the step index is the cycle number less one.
    """
    constraints = tasks.resolve_sequence_targets(tasks.infer_task_constraint(cycles), elements)
    ready = planned_actions(constraints).withColumn("step_index", F.col("cycle") - 1)
    return policy.decide_action(ready)


def loop_replay(
    cycles: DataFrame, elements: DataFrame, value_after: str, click_verified: str
) -> DataFrame:
    """Replay logged cycles: one outcome per task.

    Each cycle is judged on its own, given that all before it succeeded; the
    first cycle that ends its task then decides. No state runs over the log.
    A cycle past a limit is decided by that, before its plan is read; of such
    cycles only the place is kept, and their targets are not looked up.
    ``value_after`` (over chosen_value) and ``click_verified`` are expressions
    for what was seen after a type and after a click.
    """
    limit = (
        F.when(F.col("elapsed_s") > fixed.MAX_SECONDS, "runtime_limit")
        .when(F.col("cycle") - 1 >= fixed.MAX_ACTIONS, "action_limit")
        .when(F.col("cycle") - 1 > fixed.MAX_REPLANS, "replan_limit")
    )
    within = F.col("_limit").isNull()
    places = staged(
        cycles.withColumn("_limit", limit).select(
            "task_id", "cycle", "_limit",
            *[F.when(within, F.col(c)).alias(c) for c in cycles.columns if c not in ("task_id", "cycle")],
        )
    )
    limited = places.filter(~within).select("task_id", "cycle", F.col("_limit").alias("outcome"))
    running = places.filter(within).drop("_limit")
    elements = only_asked(elements, running, ["page_id"])
    # Read for its targets and again to be judged by them.
    decided = staged(
        decided_cycles(running, elements).select(
            "event_id", "task_id", "page_id", "cycle", "executed", "intent", "decision",
            F.col("chosen.action").alias("action"), F.col("chosen.target").alias("target"),
            F.col("chosen.value").alias("value"),
        )
    )
    checked = policy.validate_action(decided, elements)
    kind = F.lower(strip(text_or_blank("action")))
    rows = checked.withColumn("chosen_value", F.col("value")).withColumn("_after", F.expr(value_after))
    seen = rows.withColumn(
        "_verified",
        F.when(kind == "type", F.col("_after").eqNullSafe(F.col("chosen_value"))).otherwise(F.expr(click_verified)),
    )
    done_after = F.col("intent").isin("click_only", "type_only") | (
        (F.col("intent") == "sequence") & (F.col("cycle") >= 2)
    )
    outcome = (
        F.when(F.col("decision") == "sequence_done", "completed")
        .when(F.col("decision") != "act", F.col("decision"))
        .when(~F.col("valid"), "invalid_action")
        .when(~kind.isin(*fixed.POLICY_ALLOWED), "policy_block")
        .when(~F.col("executed"), "execution_failed")
        .when(~F.col("_verified"), "verification_failed")
        .when(done_after, "completed")
    )
    ended = seen.select("task_id", "cycle", outcome.alias("outcome")).unionByName(limited)
    return ended.groupBy("task_id").agg(
        F.min(F.when(F.col("outcome").isNotNull(), F.struct("cycle", "outcome"))).alias("e"),
        F.max("cycle").alias("cycles"),
    ).select(
        "task_id",
        F.coalesce("e.outcome", F.lit("unfinished")).alias("ended_by"),
        F.coalesce("e.cycle", "cycles").alias("cycle"),
        F.when(F.col("e.outcome") == "completed", "completed").otherwise("failed").alias("result"),
    )
