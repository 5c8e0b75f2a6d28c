"""Parsing of task texts and the next step they require."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.functions import fixed
from pagewarden.functions.text import (
    any_of,
    first_filled,
    group,
    ident,
    js_trim,
    search,
    squash,
    strip,
    task_pattern,
    text_or_blank,
)
from pagewarden.functions.staging import staged
from pagewarden.operators.targets import resolve_bridge


def _without_the(text: Column) -> Column:
    return F.when(F.lower(text).startswith("the "), strip(F.substring(text, 5, 1 << 30))).otherwise(text)


def _unquoted(text: Column) -> Column:
    quoted = text.rlike(r"""(?s)\A(?:'.*'|".*")\z""") & (F.length(text) >= 2)
    return F.when(quoted, strip(F.expr("substring(_raw, 2, length(_raw) - 2)"))).otherwise(text)


def infer_task_constraint(tasks: DataFrame) -> DataFrame:
    """Add intent, type_target, type_value and click_target of each task.

    Rules in order: type-then-click sequence, click only, quoted type, plain
    type, else general.
    """
    goal = F.col("_goal")
    seq, click = search(goal, fixed.TASK_SEQUENCE), search(goal, fixed.TASK_CLICK)
    quoted, plain = search(goal, fixed.TASK_TYPE_QUOTED), search(goal, fixed.TASK_TYPE_PLAIN)
    rows = tasks.withColumn("_goal", strip(text_or_blank("task"))).withColumn(
        "intent",
        F.when(seq, "sequence").when(click, "click_only").when(quoted | plain, "type_only").otherwise("general"),
    )
    rows = rows.withColumn("_raw", strip(group(goal, fixed.TASK_SEQUENCE, 1)))
    is_seq, is_type = F.col("intent") == "sequence", F.col("intent") == "type_only"
    return rows.withColumns(
        {
            "type_value": F.when(is_seq, _unquoted(F.col("_raw"))).when(
                is_type,
                strip(F.when(quoted, group(goal, fixed.TASK_TYPE_QUOTED, 1)).otherwise(group(goal, fixed.TASK_TYPE_PLAIN, 1))),
            ),
            "type_target": F.when(is_seq, _without_the(strip(group(goal, fixed.TASK_SEQUENCE, 2)))).when(
                is_type,
                strip(F.when(quoted, group(goal, fixed.TASK_TYPE_QUOTED, 2)).otherwise(group(goal, fixed.TASK_TYPE_PLAIN, 2))),
            ),
            "click_target": F.when(is_seq, _without_the(strip(group(goal, fixed.TASK_SEQUENCE, 3)))).when(
                F.col("intent") == "click_only", strip(group(goal, fixed.TASK_CLICK, 1))
            ),
        }
    ).drop("_goal", "_raw")


def resolve_sequence_targets(constraints: DataFrame, elements: DataFrame) -> DataFrame:
    """Sequence targets take the spelling of the last element that matches."""
    typed = ("placeholder", "aria_label", "name", "id", "text")
    clicked = ("text", "aria_label", "name", "id")

    def spellings(kind: str, types: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
        rows = elements.filter(F.col("type").isin(*types)).select(
            "page_id", "ord",
            F.inline(F.array(*[F.struct(F.lit(-n).alias("rank"), strip(text_or_blank(c)).alias("spelling")) for n, c in enumerate(columns)])),
        )
        return rows.select("page_id", "ord", "rank", "spelling", F.concat(F.lit(f"{kind}|"), F.lower("spelling")).alias("key"))

    facts = (
        spellings("type", ("input", "textarea"), typed)
        .unionByName(spellings("click", ("button", "link", "a"), clicked))
        .groupBy("page_id", "key")
        .agg(F.max(F.struct("ord", "rank", "spelling")).alias("last"))
        .select("page_id", "key", F.col("last.spelling").alias("spelling"))
    )
    is_seq = F.col("intent") == "sequence"
    keyed = constraints.withColumns(
        {
            "_tk": F.when(is_seq, F.concat(F.lit("type|"), F.lower("type_target"))),
            "_ck": F.when(is_seq, F.concat(F.lit("click|"), F.lower("click_target"))),
        }
    )
    t = facts.select("page_id", F.col("key").alias("_tk"), F.col("spelling").alias("_ts"))
    c = facts.select("page_id", F.col("key").alias("_ck"), F.col("spelling").alias("_cs"))
    return (
        keyed.join(t, ["page_id", "_tk"], "left")
        .join(c, ["page_id", "_ck"], "left")
        .withColumn("type_target", F.coalesce("_ts", "type_target"))
        .withColumn("click_target", F.coalesce("_cs", "click_target"))
        .drop("_tk", "_ck", "_ts", "_cs")
    )


def missing_user_info(task: Column | str) -> Column:
    """First kind of private detail the task leaves to its user, else empty."""
    result = None
    for pattern, what in fixed.MISSING_INFO:
        test = search(task, pattern)
        result = F.when(test, what) if result is None else result.when(test, what)
    return result.otherwise("")


def type_requirements_expr(task: Column | str) -> Column:
    """Array of (req_no, value, target), in pattern order, blanks dropped."""
    source = F.col(task) if isinstance(task, str) else task

    def requirement(number: int, pattern: str, value: int, target: int) -> Column:
        bare = F.regexp_replace(
            strip(group(source, pattern, target)), task_pattern(fixed.REQUIRE_TAIL), ""
        )
        return F.struct(
            F.lit(number).alias("req_no"), strip(group(source, pattern, value)).alias("value"),
            strip(bare).alias("target"),
        )

    found = F.array(
        requirement(0, fixed.REQUIRE_TYPE, 1, 2),
        requirement(1, fixed.REQUIRE_ENTER, 1, 2),
        requirement(2, fixed.REQUIRE_FILL, 2, 1),
    )
    return F.filter(found, lambda r: (r["value"] != "") & (r["target"] != ""))


def click_target(task: Column | str) -> Column:
    """Text after "click", without a leading control noun, else empty."""
    target = strip(group(task, fixed.CLICK_TARGET, 1))
    return strip(F.regexp_replace(target, task_pattern(fixed.CLICK_NOUN), ""))


def next_step(tasks: DataFrame, elements: DataFrame) -> DataFrame:
    """What the task still requires on its page: status, reason and one action.

    ``step_status`` is null where the task requires nothing definite and the
    model plan stands. Only the first type requirement is acted on. ``elements``
    are context elements: sanitized, known by tag.
    """
    first = F.get(type_requirements_expr("task"), F.lit(0))
    asked = tasks.withColumn("_r", first).withColumns(
        {
            "_value": F.col("_r.value"),
            "_field": F.col("_r.target"),
            "_click": F.nullif(click_target("task"), F.lit("")),
        }
    ).drop("_r")
    requests = asked.select(
        "page_id",
        F.inline(
            F.array(
                F.struct(F.lit("type").alias("kind"), F.col("_field").alias("target")),
                F.struct(F.lit("any").alias("kind"), F.col("_click").alias("target")),
            )
        ),
    ).filter(F.col("target").isNotNull())
    described = F.struct(
        F.col("value").alias("current"),
        first_filled("placeholder", "aria_label", "name", "id", "text").alias("type_label"),
        first_filled("text", "aria_label", "placeholder", "name", "id").alias("click_label"),
    )
    # Read by both joins below.
    resolved = staged(resolve_bridge(requests, elements, described).select("page_id", "kind", "target", "payload.*"))
    fields = resolved.filter(F.col("kind") == "type").select(
        "page_id", F.col("target").alias("_field"), F.lit(True).alias("_field_found"), "current", "type_label"
    )
    clicks = resolved.filter(F.col("kind") == "any").select(
        "page_id", F.col("target").alias("_click"), F.lit(True).alias("_click_found"), "click_label"
    )
    rows = asked.join(fields, ["page_id", "_field"], "left").join(clicks, ["page_id", "_click"], "left")
    required = F.col("_field").isNotNull()
    unresolved = required & F.col("_field_found").isNull()
    present = required & (F.col("current") == F.col("_value"))
    can_click = F.col("_click_found").isNotNull()
    do_click = (present | ~required) & can_click
    do_type = required & ~unresolved & ~F.coalesce(present, F.lit(False))
    return rows.select(
        *tasks.columns,
        F.when(unresolved, "blocked").when(do_click | do_type, "ready").when(present, "completed").alias("step_status"),
        F.when(unresolved, fixed.STEP_NO_FIELD)
        .when(do_click & required, fixed.STEP_CLICK_NEXT)
        .when(do_click, fixed.STEP_CLICK)
        .when(present, fixed.STEP_DONE)
        .when(do_type, fixed.STEP_TYPE)
        .alias("step_reason"),
        F.when(unresolved, None).when(do_click, "click").when(do_type, "type").alias("step_action"),
        F.when(unresolved, None)
        .when(do_click, F.coalesce("click_label", "_click"))
        .when(do_type, F.coalesce("type_label", "_field"))
        .alias("step_target"),
        F.when(do_type & ~unresolved, F.col("_value")).alias("step_value"),
    )


def is_final_click(task: Column | str, action: Column | str, target: Column | str) -> Column:
    """Whether the action is the click the task ends with."""
    form = squash(task)
    wanted = F.regexp_replace(
        js_trim(F.regexp_extract(form, fixed.FINAL_CLICK, 1)), r"\s+(?:button|link)$", ""
    )
    wanted = squash(wanted)
    actual = squash(target)
    kind = F.lower(js_trim(text_or_blank(action)))
    return (
        (kind == "click") & (wanted != "") & (actual != "")
        & (wanted.contains(actual) | actual.contains(wanted))
    )


def page_shows_success(text: Column | str) -> Column:
    source = F.col(text) if isinstance(text, str) else text
    return any_of(F.lower(F.coalesce(source, F.lit(""))), fixed.SUCCESS_PHRASES)


__all__ = [
    "click_target", "ident", "infer_task_constraint", "is_final_click", "missing_user_info",
    "next_step", "page_shows_success", "resolve_sequence_targets", "type_requirements_expr",
]
