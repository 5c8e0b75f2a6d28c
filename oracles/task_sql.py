"""SQL of the task queries."""

from __future__ import annotations

from oracles import common as C
from oracles import privacy_sql as V
from oracles import target_sql as T
from pagewarden.functions import fixed
from pagewarden.plans import task_queries as Q


def q(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


def st(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def m(pattern: str, x: str = "goal") -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def g(pattern: str, n: int, x: str = "goal") -> str:
    return st(f"regexp_extract({x}, {q(pattern)}, {n})")


def _the(x: str) -> str:
    return f"case when lower({x}) like 'the %' then {st(f'substr({x}, 5)')} else {x} end"


def constraints(source: str = "tasks") -> str:
    v = g(fixed.TASK_SEQUENCE, 1)
    unquote = f"""case when length({v}) >= 2 and left({v}, 1) = right({v}, 1) and left({v}, 1) in ('''', '"')
      then {st(f'substr({v}, 2, length({v}) - 2)')} else {v} end"""
    return f"""goals as (select *, {st("coalesce(task, '')")} as goal from {source}),
  intents as (select *, case when {m(fixed.TASK_SEQUENCE)} then 'sequence' when {m(fixed.TASK_CLICK)} then 'click_only'
    when {m(fixed.TASK_TYPE_QUOTED)} or {m(fixed.TASK_TYPE_PLAIN)} then 'type_only' else 'general' end as intent from goals),
  constrained as (select * exclude (goal), case intent when 'sequence' then {unquote} when 'type_only' then
      case when {m(fixed.TASK_TYPE_QUOTED)} then {g(fixed.TASK_TYPE_QUOTED, 1)} else {g(fixed.TASK_TYPE_PLAIN, 1)} end end as type_value,
    case intent when 'sequence' then {_the(g(fixed.TASK_SEQUENCE, 2))} when 'type_only' then
      case when {m(fixed.TASK_TYPE_QUOTED)} then {g(fixed.TASK_TYPE_QUOTED, 2)} else {g(fixed.TASK_TYPE_PLAIN, 2)} end end as type_target,
    case intent when 'sequence' then {_the(g(fixed.TASK_SEQUENCE, 3))} when 'click_only' then {g(fixed.TASK_CLICK, 1)} end as click_target
    from intents)"""


def _spell(columns, target: str) -> str:
    cases = " ".join(f"when lower(trim(e.{c})) = lower({target}) then trim(e.{c})" for c in columns)
    return f"case {cases} end"


SEQUENCES = f"""tspell as (select c.event_id, arg_max({_spell(("placeholder", "aria_label", "name", "id", "text"), 'c.type_target')}, e.ord) as s
    from constrained c join elements e using (page_id) where c.intent = 'sequence' and e.type in ('input', 'textarea')
    and {_spell(("placeholder", "aria_label", "name", "id", "text"), 'c.type_target')} is not null group by 1),
  cspell as (select c.event_id, arg_max({_spell(("text", "aria_label", "name", "id"), 'c.click_target')}, e.ord) as s
    from constrained c join elements e using (page_id) where c.intent = 'sequence' and e.type in ('button', 'link', 'a')
    and {_spell(("text", "aria_label", "name", "id"), 'c.click_target')} is not null group by 1),
  resolved_c as (select c.* replace (coalesce(t.s, type_target) as type_target, coalesce(k.s, click_target) as click_target)
    from constrained c left join tspell t using (event_id) left join cspell k using (event_id))"""

_MISSING = "case " + " ".join(f"when {m(p, 'task')} then '{w}'" for p, w in fixed.MISSING_INFO) + " else '' end"


def _req(pattern: str, v: int, t: int, n: int) -> str:
    bare = st(f"regexp_replace({g(pattern, t, 'task')}, {q(fixed.REQUIRE_TAIL)}, '')")
    return f"select event_id, page_id, {n} as req_no, {g(pattern, v, 'task')} as value, {bare} as target from tasks where {m(pattern, 'task')}"


REQS = f"""reqs as (select * from ({_req(fixed.REQUIRE_TYPE, 1, 2, 0)} union all {_req(fixed.REQUIRE_ENTER, 1, 2, 1)}
    union all {_req(fixed.REQUIRE_FILL, 2, 1, 2)}) where value <> '' and target <> '')"""
_CLICK = st(f"regexp_replace({g(fixed.CLICK_TARGET, 1, 'task')}, {q(fixed.CLICK_NOUN)}, '')")

# Next step per task over the sanitized context.
CONTEXT = "ctx as (select e.page_id, e.ord, '' as type, tag, input_type, e.id, c.* exclude (page_id, ord) from elements e join clean_el c using (page_id, ord))"
STEPS = f"""{REQS},
  firsts_r as (select event_id, arg_min(value, req_no) as value, arg_min(target, req_no) as target from reqs group by 1),
  asks as (select t.event_id, t.page_id, r.value as want, r.target as field, nullif(coalesce({_CLICK}, ''), '') as click
    from tasks t left join firsts_r r using (event_id)),
  bask as (select page_id, 'type' as kind, field as target from asks where field is not null
    union all select page_id, 'any', click from asks where click is not null),
  {T.bridge('bask')},
  st0 as (select a.*, fe.ord is not null as field_found, fe.value as current,
      coalesce(nullif(fe.placeholder, ''), nullif(fe.aria_label, ''), nullif(fe.name, ''), nullif(fe.id, ''), nullif(fe.text, '')) as tl,
      ce.ord is not null as click_found,
      coalesce(nullif(ce.text, ''), nullif(ce.aria_label, ''), nullif(ce.placeholder, ''), nullif(ce.name, ''), nullif(ce.id, '')) as cl
    from asks a left join bridge fb on fb.page_id = a.page_id and fb.kind = 'type' and fb.target = a.field
    left join ctx fe on fe.page_id = fb.page_id and fe.ord = fb.ord
    left join bridge cb on cb.page_id = a.page_id and cb.kind = 'any' and cb.target = a.click
    left join ctx ce on ce.page_id = cb.page_id and ce.ord = cb.ord),
  steps as (select event_id, page_id,
    case when field is null then case when click_found then 'ready' else 'plan' end
      when not field_found then 'blocked' when current = want then case when click_found then 'ready' else 'completed' end else 'ready' end as status,
    case when field is null then case when click_found then '{fixed.STEP_CLICK}' end
      when not field_found then '{fixed.STEP_NO_FIELD}' when current = want then case when click_found then '{fixed.STEP_CLICK_NEXT}'
      else '{fixed.STEP_DONE}' end else '{fixed.STEP_TYPE}' end as step_reason,
    case when field is null then case when click_found then 'click' end when not field_found then null
      when current = want then case when click_found then 'click' end else 'type' end as step_action,
    case when field is null then case when click_found then coalesce(cl, click) end when not field_found then null
      when current = want then case when click_found then coalesce(cl, click) end else coalesce(tl, field) end as step_target,
    case when field is not null and field_found and current <> want then want end as step_value from st0)"""

_TASK_FORM = T.squash("task")
_WANT = T.squash(f"regexp_replace(trim(regexp_extract({_TASK_FORM}, '{fixed.FINAL_CLICK}', 1)), '\\s+(?:button|link)$', '')")

SQL = {
    "infer_task_constraint": C.rec(C.TASKS, constraints()) + "select event_id, intent, type_target, type_value, click_target from constrained",
    "resolve_sequence_targets": C.rec(C.ELEMENTS, C.TASKS, constraints(), SEQUENCES)
    + "select event_id, page_id, type_target, type_value, click_target from resolved_c where intent = 'sequence'",
    "missing_user_info": C.rec(C.TASKS) + f"select event_id, {_MISSING} as missing from tasks",
    "type_requirements": C.rec(C.TASKS, REQS) + "select event_id, req_no, value, target from reqs",
    "click_target": C.rec(C.TASKS) + f"select event_id, coalesce({_CLICK}, '') as click_target from tasks",
    "enforce_requirements": C.rec(C.FINDINGS, V.CLEAN_ELEMENTS, C.TASKS, CONTEXT, STEPS)
    + "select event_id, status, step_reason, step_action, step_target, step_value from steps",
    "final_click_action": C.rec(C.TASKS) + f"""select event_id, lower(trim(a)) = 'click' and w <> '' and t <> ''
      and (contains(w, t) or contains(t, w)) as is_final from (select event_id, {Q.FINAL_ACTION} as a, {T.squash(Q.FINAL_TARGET)} as t,
      coalesce({_WANT}, '') as w from tasks)""",
    "page_shows_success": C.rec(C.PAGES) + "select page_id, "
    + "(" + " or ".join(f"contains(lower(page_text), '{p}')" for p in fixed.SUCCESS_PHRASES) + ") as success from form_pages",
}
