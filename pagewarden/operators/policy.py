"""Validation, policy, verification and audit of logged plans and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewarden.functions import fixed
from pagewarden.functions.numbering import number_within
from pagewarden.functions.text import ident, js_trim, strip, text_or_blank
from pagewarden.operators.targets import find_target_dom, resolve_targets, select_options


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# ------------------------------------------------------------ action validation

def validate_action(actions: DataFrame, elements: DataFrame) -> DataFrame:
    """First failing rule of each action as a message, else valid.

    Target resolution runs on distinct requests and is joined back.
    """
    kind = ident("action")
    target = strip(text_or_blank("target"))
    known = kind.isin(*fixed.VALIDATED_ACTIONS) & (target != "")
    resolved = resolve_targets(actions.filter(known), elements)
    rows = actions.join(resolved, ["page_id", "action", "target"], "left")
    final = strip("canonical")
    value = F.coalesce(F.col("value"), F.lit(""))
    message = (
        F.when(~kind.isin(*fixed.VALIDATED_ACTIONS), _join(fixed.MSG_UNSUPPORTED, kind))
        .when(target == "", fixed.MSG_TARGET_MISSING)
        .when(F.col("n").isNull(), _join(fixed.MSG_TARGET_NOT_FOUND, target))
        .when(F.col("canonical_n") == 0, _join(fixed.MSG_NOT_FOUND_AFTER, final))
        .when((kind == "type") & (value == ""), fixed.MSG_VALUE_MISSING)
        .when((kind == "type") & (value == fixed.VALUE_PLACEHOLDER), fixed.MSG_VALUE_PLACEHOLDER)
        .when((kind == "type") & ~F.col("any_input"), _join(fixed.MSG_NOT_TEXT_INPUT, final))
        .when((kind == "click") & ~F.col("any_click"), _join(fixed.MSG_NOT_CLICKABLE, final))
        .otherwise(fixed.MSG_VALID)
    )
    return rows.withColumn("message", message).withColumn("valid", F.col("message") == fixed.MSG_VALID).drop(
        "n", "canonical_n", "any_input", "any_click"
    )


def plan_errors(validated: DataFrame) -> DataFrame:
    """One row per failing step; expects a ``step`` column."""
    return validated.filter(~F.col("valid")).withColumn(
        "error", _join("Step ", F.col("step").cast("string"), ": ", F.col("message"))
    )


def validate_plan(validated: DataFrame, keys: list[str]) -> DataFrame:
    """Verdict per plan by partial aggregation; the errors stay rows of their own."""
    return validated.groupBy(*keys).agg(
        F.bool_and("valid").alias("valid"),
        F.count(F.lit(1)).alias("steps"),
        F.count_if(~F.col("valid")).alias("errors"),
        F.min(F.when(~F.col("valid"), F.struct("step", "message")))["message"].alias("first_error"),
    )


def raw_plan_steps(plans: DataFrame, elements: DataFrame, keys: list[str]) -> DataFrame:
    """Plans as they were parsed to judged steps, one row at least for each plan.

    ``plans``(keys, page_id, plan): ``plan`` is an array of variants, null when
    the answer was no list. A plan that is no list or an empty one has one row
    without a step; a step that is no object fails as such. Members that are no
    strings count as blank.
    """
    size = F.coalesce(F.size("plan"), F.lit(-1))
    rows = plans.select(
        *keys, "page_id",
        F.when(size < 0, fixed.MSG_PLAN_NOT_LIST).when(size == 0, fixed.MSG_PLAN_EMPTY).alias("_fault"),
        F.posexplode_outer("plan").alias("_pos", "_item"),
    )
    member = lambda name: F.when(F.col("_is_object"), _string(_part(F.col("_item"), name)))
    steps = rows.withColumn("_is_object", json_kind(F.col("_item")) == "OBJECT").select(
        *keys, "page_id", "_fault", (F.col("_pos") + 1).cast("bigint").alias("step"), "_is_object",
        F.coalesce(member("action"), F.lit("")).alias("action"), F.coalesce(member("target"), F.lit("")).alias("target"),
        member("value").alias("value"),
    )
    message = F.coalesce("_fault", F.when(~F.col("_is_object"), fixed.MSG_NOT_OBJECT), "message")
    judged = validate_action(steps, elements).withColumn("message", message)
    return judged.select(*keys, "page_id", "step", "action", "target", "message", (message == fixed.MSG_VALID).alias("valid"))


def raw_plan_verdicts(judged: DataFrame, keys: list[str]) -> DataFrame:
    """One verdict for each plan, also where it has no step: valid, steps, errors, first_error."""
    return judged.groupBy(*keys).agg(
        F.bool_and("valid").alias("valid"),
        F.count("step").alias("steps"),
        F.count_if(~F.col("valid")).alias("errors"),
        F.min(F.when(~F.col("valid"), F.struct("step", "message")))["message"].alias("first_error"),
    )


# -------------------------------------------------------- model-plan validation

PLAN_STEP = "struct<action:string,target:string,value:string>"


def json_kind(value: Column) -> Column:
    """JSON type name of a variant, empty when it is missing."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit(""))


def _part(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _string(value: Column) -> Column:
    """Text of a variant that is a JSON string, else null."""
    return F.when(json_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _has_coordinates(value: Column) -> Column:
    result = F.lit(False)
    for key in fixed.COORDINATE_KEYS:
        result = result | _part(value, key).isNotNull()
    return result


def _step_problem(step: Column) -> Column:
    """Reason an action of a plan is refused, null when it passes."""
    kind = _string(_part(step, "action"))
    target = _string(_part(step, "target"))
    raw = _part(step, "value")
    value = _string(raw)
    allowed = F.coalesce(kind.isin(*fixed.PLAN_ACTIONS), F.lit(False))
    return (
        F.when(json_kind(step) != "OBJECT", fixed.PLAN_BAD_ACTION)
        .when(~allowed, fixed.PLAN_BAD_KIND)
        .when(F.coalesce(strip(target), F.lit("")) == "", fixed.PLAN_NO_TARGET)
        .when(_has_coordinates(step), fixed.PLAN_ACTION_COORDINATES)
        .when((kind == "type") & value.isNull(), fixed.PLAN_TYPE_VALUE)
        .when((kind == "type") & value.isin(*fixed.TOKENS.values()), fixed.PLAN_TYPES_TOKEN)
        .when((kind != "type") & raw.isNotNull(), fixed.PLAN_STRAY_VALUE)
    )


def _step_shape(step: Column) -> Column:
    kind = _string(_part(step, "action"))
    return F.struct(
        kind.alias("action"), strip(_string(_part(step, "target"))).alias("target"),
        F.when(kind == "type", _string(_part(step, "value"))).alias("value"),
    )


def validate_model_plan(plans: DataFrame, plan: str = "plan") -> DataFrame:
    """Add plan_status, plan_reason and plan_actions of a parsed model answer."""
    source = F.col(plan)
    actions = _part(source, "actions")
    rows = plans.withColumns(
        {
            "_kind": json_kind(source),
            "_status": _string(_part(source, "status")),
            "_why": F.coalesce(_string(_part(source, "reason")), F.lit("")),
            "_bad_list": actions.isNotNull() & (json_kind(actions) != "ARRAY"),
            "_steps": F.coalesce(
                F.when(json_kind(actions) == "ARRAY", F.try_variant_get(actions, "$", "array<variant>")),
                F.array().cast("array<variant>"),
            ),
            "_xy": _has_coordinates(source),
        }
    )
    problems = F.filter(F.transform("_steps", _step_problem), lambda p: p.isNotNull())
    rows = rows.withColumn("_problem", F.get(problems, F.lit(0)))
    refused = (
        F.when(F.col("_kind") != "OBJECT", fixed.PLAN_INVALID)
        .when(F.col("_xy"), fixed.PLAN_COORDINATES)
        .when(~F.coalesce(F.col("_status").isin(*fixed.PLAN_STATUSES), F.lit(False)), fixed.PLAN_BAD_STATUS)
        .when(F.col("_bad_list"), fixed.PLAN_BAD_ACTIONS)
        .when(F.col("_problem").isNotNull(), F.col("_problem"))
        .when((F.col("_status") == "completed") & (F.size("_steps") > 0), fixed.PLAN_COMPLETED_ACTIONS)
        .when(
            F.col("_status") == "blocked",
            F.when(F.col("_why") == "", fixed.PLAN_BLOCKED).otherwise(F.col("_why")),
        )
    )
    return rows.withColumn("_refused", refused).withColumns(
        {
            "plan_status": F.when(F.col("_refused").isNotNull(), "blocked").otherwise("ready"),
            "plan_reason": F.coalesce("_refused", "_why"),
            "plan_actions": F.when(
                F.col("_refused").isNull(), F.transform("_steps", _step_shape).cast(f"array<{PLAN_STEP}>")
            ).otherwise(F.array().cast(f"array<{PLAN_STEP}>")),
        }
    ).drop("_kind", "_status", "_why", "_bad_list", "_steps", "_xy", "_problem", "_refused")


# ------------------------------------------------------------------ policies

def action_policy(actions: DataFrame) -> DataFrame:
    """Capability policy, by the exact action name."""
    kind = F.coalesce(F.col("action"), F.lit("None"))
    allowed = kind.isin(*fixed.POLICY_ALLOWED)
    return actions.withColumn("allowed", allowed).withColumn(
        "reason",
        F.when(allowed, fixed.MSG_ALLOWED)
        .when(kind.isin(*fixed.POLICY_CONFIRM), _join(fixed.MSG_CONFIRM, kind))
        .otherwise(_join(fixed.MSG_BLOCKED_ACTION, kind)),
    )


def host_of(url: Column | str) -> Column:
    """Lower-cased host name of an address, null when it has none."""
    source = F.col(url) if isinstance(url, str) else url
    netloc = F.regexp_extract(source, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    bare = F.regexp_replace(netloc, r"^.*@", "")
    host = F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(
        F.regexp_replace(bare, r":.*$", "")
    )
    return F.nullif(F.lower(host), F.lit(""))


def domain_policy(pages: DataFrame) -> DataFrame:
    host = host_of("url")
    return pages.withColumn("host", host).withColumn(
        "allowed", F.coalesce(F.col("host").isin(*fixed.ALLOWED_HOSTS), F.lit(False))
    )


def popup_policy_reason(action: Column, target: Column, value: Column) -> Column:
    kind = F.lower(js_trim(F.coalesce(action, F.lit(""))))
    return (
        F.when(kind.isin(*fixed.POLICY_CONFIRM), _join(fixed.POPUP_BLOCKED, kind))
        .when(~kind.isin(*fixed.POLICY_ALLOWED), _join(fixed.POPUP_NOT_ALLOWED, kind))
        .when(js_trim(F.coalesce(target, F.lit(""))) == "", fixed.MSG_TARGET_MISSING)
        .when((kind == "type") & value.isNull(), fixed.POPUP_NEEDS_VALUE)
        .otherwise(fixed.POPUP_ALLOWED)
    )


def popup_policy(actions: DataFrame) -> DataFrame:
    reason = popup_policy_reason(F.col("action"), F.col("target"), F.col("value"))
    return actions.withColumn("reason", reason).withColumn("allowed", F.col("reason") == fixed.POPUP_ALLOWED)


def execution_preconditions(actions: DataFrame, elements: DataFrame, options: DataFrame) -> DataFrame:
    """Why the page script would refuse an action; empty message when it would not."""
    kind = F.coalesce(F.col("action"), F.lit("undefined"))
    runs = kind.isin("click", "type", "select")
    found = find_target_dom(actions.filter(runs), elements).select("page_id", "target", "ord")
    described = elements.select("page_id", "ord", "tag", "input_type", "enabled")
    chosen = select_options(actions.filter(kind == "select"), options).select("page_id", "value", "opt_value")
    rows = (
        actions.join(found.join(described, ["page_id", "ord"]), ["page_id", "target"], "left")
        .join(chosen, ["page_id", "value"], "left")
    )
    target = F.coalesce(F.col("target"), F.lit("undefined"))
    message = (
        F.when(~runs, _join(fixed.EXEC_UNSUPPORTED, kind))
        .when(F.col("ord").isNull(), _join(fixed.EXEC_UNRESOLVED, target))
        .when(~F.col("enabled"), _join(fixed.EXEC_DISABLED, target))
        .when((kind == "select") & F.col("value").isNull(), fixed.EXEC_SELECT_VALUE)
        .when((kind == "select") & (F.col("tag") != "select"), fixed.EXEC_SELECT_ELEMENT)
        .when((kind == "select") & F.col("opt_value").isNull(), _join(fixed.EXEC_SELECT_OPTION, F.col("value")))
        .when((kind == "type") & F.col("value").isNull(), fixed.EXEC_TYPE_VALUE)
        .when((kind == "type") & (F.col("tag") == "input") & (F.lower("input_type") == "password"), fixed.EXEC_CREDENTIAL)
        .when((kind == "type") & ~F.col("tag").isin("input", "textarea"), fixed.EXEC_NOT_EDITABLE)
        .otherwise("")
    )
    return rows.withColumn("message", message).withColumn("ready", F.col("message") == "")


def navigate_url_check(actions: DataFrame) -> DataFrame:
    """Only web addresses may be navigated to."""
    return actions.filter(F.lower("action") == "navigate").withColumn(
        "ok", js_trim(text_or_blank("target")).rlike(r"(?i)^https?://")
    )


# ------------------------------------------------------------------ loop rules

def expected_step(step_index: Column) -> Column:
    """Step of a type-then-click sequence as an action, null past its end."""
    typed = F.struct(F.lit("type").alias("action"), F.col("type_target").alias("target"), F.col("type_value").alias("value"))
    clicked = F.struct(
        F.lit("click").alias("action"), F.col("click_target").alias("target"), F.lit(None).cast("string").alias("value")
    )
    return F.when(step_index == 0, typed.cast(PLAN_STEP)).when(step_index == 1, clicked.cast(PLAN_STEP))


def fallback_action(step_index: Column) -> Column:
    """Action used when the planner returns none, null when there is none."""
    typed = F.struct(F.lit("type").alias("action"), F.col("type_target").alias("target"), F.col("type_value").alias("value"))
    clicked = F.struct(
        F.lit("click").alias("action"), F.col("click_target").alias("target"), F.lit(None).cast("string").alias("value")
    )
    return (
        F.when(F.col("intent") == "sequence", expected_step(step_index))
        .when(F.col("intent") == "click_only", clicked.cast(PLAN_STEP))
        .when(F.col("intent") == "type_only", typed.cast(PLAN_STEP))
    )


def sequence_match(actions: Column, step_index: Column) -> Column:
    """First planned action that is the expected sequence step, else null."""
    want = expected_step(step_index)
    hits = F.filter(
        actions,
        lambda a: (a["action"] == want["action"])
        & (ident(a["target"]) == ident(want["target"]))
        & ((want["action"] != "type") | a["value"].eqNullSafe(want["value"])),
    )
    return F.get(hits, F.lit(0))


def decide_action(cycles: DataFrame) -> DataFrame:
    """Add ``chosen`` (action, target, value) and ``decision`` per cycle.

    Needs intent, type_target, type_value, click_target, ``planned`` (array of
    actions, null when unparsable) and ``step_index`` (verified actions so far).
    """
    index = F.col("step_index")
    is_seq = F.col("intent") == "sequence"
    empty = F.size("planned") == 0
    used = F.when(
        empty, F.array_compact(F.array(fallback_action(index)))
    ).otherwise(F.col("planned"))
    rows = cycles.withColumn("_used", used)
    single = F.get("_used", F.lit(0))
    wanted = F.when(F.col("intent") == "click_only", "click").when(F.col("intent") == "type_only", "type")
    forced = F.struct(
        single["action"].alias("action"),
        F.when(wanted == "click", F.col("click_target")).when(wanted == "type", F.col("type_target")).otherwise(single["target"]).alias("target"),
        F.when(wanted == "type", F.col("type_value")).otherwise(single["value"]).alias("value"),
    ).cast(PLAN_STEP)
    rows = rows.withColumn("_match", sequence_match(F.col("_used"), index))
    decision = (
        F.when(F.col("planned").isNull(), "unparsable")
        .when(is_seq & (index >= 2), "sequence_done")
        .when(empty & (F.size("_used") == 0), "no_action")
        .when(is_seq & F.col("_match").isNull(), "step_mismatch")
        .when(is_seq, "act")
        .when(F.size("_used") != 1, "not_one_action")
        .when(wanted.isNotNull() & ~single["action"].eqNullSafe(wanted), "intent_mismatch")
        .otherwise("act")
    )
    return rows.withColumn("decision", decision).withColumn(
        "chosen", F.when(F.col("decision") == "act", F.when(is_seq, F.col("_match")).otherwise(forced))
    ).drop("_used", "_match")


def budget_breaches(log: DataFrame) -> DataFrame:
    """First limit each task breaks: task_id, step, breach.

    ``log``(task_id, ts, event_id, elapsed_s, is_replan) holds one row per cycle
    start. Limits are tested with the counts so far: time, actions, replans. The
    action limit breaks at the latest at the row after the limit, so only that
    many rows per task are ranked, and the rank limit is applied before the
    exchange; a task with very many rows stays small.
    """
    order = W.partitionBy("task_id").orderBy("ts", "event_id")
    head = log.withColumn("step", F.row_number().over(order)).filter(F.col("step") <= fixed.MAX_ACTIONS + 1)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    counted = head.withColumn(
        "replans", F.coalesce(F.sum(F.col("is_replan").cast("int")).over(before), F.lit(0))
    )
    breach = (
        F.when(F.col("elapsed_s") > fixed.MAX_SECONDS, "runtime")
        .when(F.col("step") - 1 >= fixed.MAX_ACTIONS, "actions")
        .when(F.col("replans") > fixed.MAX_REPLANS, "replans")
    )
    broken = counted.withColumn("breach", breach).filter(F.col("breach").isNotNull())
    return broken.groupBy("task_id").agg(F.min(F.struct("step", "breach")).alias("b")).select(
        "task_id", "b.step", "b.breach"
    )


# ---------------------------------------------------------------- verification

def verify_type(actions: DataFrame, fields_after: DataFrame) -> DataFrame:
    """Type actions: does the first field that answers to the target hold the value?

    ``fields_after``(event_id, ord, tag, placeholder, aria_label, name, id, value).
    Inputs come before text areas.
    """
    typed = actions.filter(F.col("action") == "type").select("event_id", "target", F.col("value").alias("wanted"))
    rows = fields_after.filter(F.col("tag").isin("input", "textarea")).select(
        "event_id",
        F.struct((F.col("tag") == "textarea").alias("later"), "ord", "value").alias("place"),
        F.array_compact(
            F.array(*[F.nullif(F.lower(text_or_blank(c)), F.lit("")) for c in ("placeholder", "aria_label", "name", "id")])
        ).alias("names"),
    )
    hits = (
        typed.join(rows, "event_id")
        .filter(F.array_contains("names", F.lower(text_or_blank("target"))))
        .groupBy("event_id")
        .agg(F.min("place").alias("first"))
    )
    return typed.join(hits, "event_id", "left").select(
        "event_id",
        F.coalesce(F.col("first.value") == F.coalesce("wanted", F.lit("")), F.lit(False)).alias("verified"),
    )


CLICK_FIELDS = ("visible", "enabled", "aria_expanded", "aria_pressed", "class")


def click_targets(requests: DataFrame, elements: DataFrame) -> DataFrame:
    """State of the control a click target names: first button, else first link."""
    label = F.coalesce(F.nullif(strip(text_or_blank("text")), F.lit("")), text_or_blank("aria_label"))
    facts = (
        elements.filter(F.col("type").isin("button", "link"))
        .groupBy("page_id", F.lower(label).alias("key"))
        .agg(F.min(F.struct((F.col("type") == "link").alias("later"), "ord", *CLICK_FIELDS)).alias("s"))
    )
    asked = requests.select("page_id", "target").distinct().withColumn("key", F.lower(text_or_blank("target")))
    return asked.join(facts, ["page_id", "key"], "left").select(
        "page_id", "target", F.col("s").isNotNull().alias("found"), "s.ord", *[f"s.{c}" for c in CLICK_FIELDS]
    )


def _digest(body: Column | str) -> Column:
    """What of a page body travels to the comparison of two phases."""
    return F.sha2(body, 256)


def verify_click(states: DataFrame) -> DataFrame:
    """One row per click: did anything observable change?

    ``states``(event_id, phase, url, body_text, body_html, target struct). Both
    phases of a click meet in one aggregation; the target must have been seen
    before, and may be gone after.
    """
    side = F.struct("url", _digest("body_text").alias("body_text"), _digest("body_html").alias("body_html"), "target")
    pairs = states.groupBy("event_id").agg(
        F.max(F.when(F.col("phase") == "before", side)).alias("b"),
        F.max(F.when(F.col("phase") == "after", side)).alias("a"),
    )
    b, a = F.col("b"), F.col("a")
    changed = F.lit(False)
    for name in ("url", "body_text", "body_html"):
        changed = changed | ~b[name].eqNullSafe(a[name])
    for name in CLICK_FIELDS:
        changed = changed | ~b["target"][name].eqNullSafe(a["target"][name])
    return pairs.select(
        "event_id",
        (~b["url"].eqNullSafe(a["url"])).alias("url_changed"),
        (~b["body_text"].eqNullSafe(a["body_text"])).alias("page_changed"),
        (~b["body_html"].eqNullSafe(a["body_html"])).alias("html_changed"),
        (b["target"].isNotNull() & changed).alias("verified"),
    )


def verify_page_change(states: DataFrame) -> DataFrame:
    """Extension side: address, text or elements differ between the phases."""
    side = F.struct("url", _digest("page_text").alias("page_text"), _digest(F.to_json("elements")).alias("elements"))
    pairs = states.groupBy("event_id").agg(
        F.max(F.when(F.col("phase") == "before", side)).alias("b"),
        F.max(F.when(F.col("phase") == "after", side)).alias("a"),
    )
    flags = {n: ~F.col(f"b.{n}").eqNullSafe(F.col(f"a.{n}")) for n in ("url", "page_text", "elements")}
    return pairs.select(
        "event_id", flags["url"].alias("url_changed"), flags["page_text"].alias("page_changed"),
        flags["elements"].alias("elements_changed"),
        (flags["url"] | flags["page_text"] | flags["elements"]).alias("verified"),
    )


def verify_select(actions: DataFrame, options: DataFrame) -> DataFrame:
    """Select actions: the page's value afterwards is the chosen option's."""
    chosen = select_options(actions, options)
    return actions.join(chosen, ["page_id", "value"], "left").withColumn(
        "verified", F.coalesce(F.col("value_after") == F.col("opt_value"), F.lit(False))
    )


def first_action_per_cycle(actions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first action of each cycle; the rest are dropped by rule."""
    others = [c for c in actions.columns if c not in keys and c not in order]
    first = actions.groupBy(*keys).agg(F.min(F.struct(*order, *others)).alias("_f"))
    return first.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in [*order, *others]])


def cycle_status(cycles: DataFrame) -> DataFrame:
    """Add ``status`` per cycle, by the order in which the loop tests things."""
    status = (
        F.when(F.col("agent_status").isNull(), "error")
        .when(F.col("agent_status") == "blocked", "blocked")
        .when(F.col("n_actions") == 0, "no_actions")
        .when(F.col("policy_reason") != fixed.POPUP_ALLOWED, "blocked")
        .when(~F.coalesce("executed", F.lit(False)), "execution_failed")
        .when(F.col("verified") == F.lit(False), "verification_failed")
        .when(F.col("shows_success"), "completed")
        .otherwise("continue")
    )
    return cycles.withColumn("status", status)


def cycle_outcome(cycles: DataFrame, keys: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """Terminal status per task: the first cycle that ends it, else the cycle limit."""
    rows = cycle_status(cycles).filter(F.col("cycle") <= fixed.MAX_CYCLES)
    per_task = rows.groupBy(*keys).agg(
        F.min(F.when(F.col("status") != "continue", F.struct("cycle", "status"))).alias("end"),
        F.max("cycle").alias("cycles"),
    )
    return per_task.select(
        *keys,
        F.coalesce(
            "end.status", F.when(F.col("cycles") >= fixed.MAX_CYCLES, F.lit("max_cycles")).otherwise("running")
        ).alias("status"),
        F.coalesce("end.cycle", "cycles").alias("cycle"),
    )


def task_outcome(history: DataFrame) -> DataFrame:
    """history(task_id, intent, n_steps, ok, completed): completed or failed per task."""
    per_task = history.groupBy("task_id").agg(
        F.bool_and("ok").alias("all_ok"), F.bool_or("completed").alias("done"),
        F.count_if("ok").alias("verified"), F.max("intent").alias("intent"), F.max("n_steps").alias("n_steps"),
    )
    done = F.col("all_ok") & F.col("done") & (
        (F.col("intent") != "sequence") | (F.col("verified") >= F.col("n_steps"))
    )
    return per_task.select("task_id", "verified", F.when(done, "completed").otherwise("failed").alias("outcome"))


def status_message(status: Column, reason: Column, error: Column) -> Column:
    """What a user is told about a result."""
    state = F.lower(js_trim(F.coalesce(status, F.lit(""))))
    why = F.lower(js_trim(F.coalesce(reason, F.lit(""))))
    told = F.coalesce(reason, F.lit(""))
    login = why.contains("credential") | why.contains("password") | why.contains("login")
    return (
        F.when(state.isin("completed", "done"), fixed.SHOWN_DONE)
        .when((state == "blocked") & login, fixed.SHOWN_LOGIN)
        .when((state == "blocked") & why.contains(fixed.SHOWN_USER_INFO), fixed.SHOWN_MISSING)
        .when((state == "blocked") & (told != ""), _join("Problem: ", told))
        .when(state == "blocked", fixed.SHOWN_BLOCKED)
        .when(state == "no_actions", fixed.SHOWN_NO_ACTIONS)
        .when(state == "agent_not_ready", fixed.SHOWN_NOT_READY)
        .when(state == "execution_failed", fixed.SHOWN_EXEC_FAILED)
        .when(state == "max_cycles_reached", fixed.SHOWN_MAX_CYCLES)
        .when(F.coalesce(error, F.lit("")) != "", _join("Problem: ", error))
        .otherwise("")
    )


def action_history(verified: DataFrame) -> DataFrame:
    """Numbered verified actions per task as display lines."""
    numbered = number_within(
        verified, ["task_id"], F.date_trunc("hour", F.col("ts")), ["ts", "event_id"], "number"
    )
    kind = F.upper(F.coalesce("action", F.lit("")))
    line = F.concat(
        F.col("number").cast("string"), F.lit(". "), kind, F.lit(" "), text_or_blank("target"),
        F.when(kind == "TYPE", F.concat(F.lit(" -> "), text_or_blank("value"))).otherwise(""),
    )
    return numbered.withColumn("line", line)


def task_counters(log: DataFrame) -> DataFrame:
    """Actions, replans and seconds per task."""
    return log.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("actions"),
        F.count_if("is_replan").alias("replans"),
        (
            F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
        ).alias("runtime_us"),
    )
