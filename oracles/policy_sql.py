"""SQL of the policy queries."""

from __future__ import annotations

from oracles import common as C
from oracles import source_sql as S
from oracles import target_sql as T
from oracles import task_sql as K
from pagewarden.functions import fixed
from pagewarden.plans import policy_queries as Q
from pagewarden.plans import target_queries as TQ
from pagewarden.sources import derived as D


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def validated(source: str = "actions") -> str:
    """CTEs ending in validated(.., canonical, message, valid)."""
    act, tgt = T.ident("coalesce(a.action, '')"), K.st("coalesce(a.target, '')")
    return f"""{T.resolve(f"(select * from {source} where {T.ident('action')} in ('click', 'type') and {K.st('target')} <> '')")},
  validated as (select *, message = {s(fixed.MSG_VALID)} as valid from (select a.*, r.canonical,
    case when {act} not in ('click', 'type') then {s(fixed.MSG_UNSUPPORTED)} || {act}
      when {tgt} = '' then {s(fixed.MSG_TARGET_MISSING)}
      when r.n is null then {s(fixed.MSG_TARGET_NOT_FOUND)} || {tgt}
      when r.canonical_n = 0 then {s(fixed.MSG_NOT_FOUND_AFTER)} || {K.st('r.canonical')}
      when {act} = 'type' and coalesce(a.value, '') = '' then {s(fixed.MSG_VALUE_MISSING)}
      when {act} = 'type' and a.value = {s(fixed.VALUE_PLACEHOLDER)} then {s(fixed.MSG_VALUE_PLACEHOLDER)}
      when {act} = 'type' and not r.any_input then {s(fixed.MSG_NOT_TEXT_INPUT)} || {K.st('r.canonical')}
      when {act} = 'click' and not r.any_click then {s(fixed.MSG_NOT_CLICKABLE)} || {K.st('r.canonical')}
      else {s(fixed.MSG_VALID)} end as message
    from {source} a left join resolved r using (page_id, action, target)))"""


_PLANS = C.rec(
    C.ELEMENTS, C.ACTIONS,
    "day_actions as (select * replace (row_number() over (partition by task_id, day(ts) order by ts, event_id) as step), day(ts) as plan_day from actions)",
    validated("day_actions"),
)

_MEMBER = "coalesce(case when json_type(item) = 'OBJECT' and json_type(item, '$.{n}') = 'VARCHAR' then item ->> '$.{n}' end, '')"
_RAW = C.rec(
    C.ELEMENTS, C.MODELS,
    f"""raw_plans as (select event_id, page_id, case when a <> '' and json_valid(a) then a end as a from (select event_id, page_id, {S._ARRAY} as a from model_texts)),
  raw_items as (select event_id, page_id, unnest(json_extract(a, '$[*]')) as item, unnest(range(json_array_length(a)::int)) + 1 as step from raw_plans where a is not null),
  raw_steps as (select event_id, page_id, step, json_type(item) as kind, {_MEMBER.format(n='action')} as action, {_MEMBER.format(n='target')} as target,
    case when json_type(item) = 'OBJECT' and json_type(item, '$.value') = 'VARCHAR' then item ->> '$.value' end as value from raw_items)""",
    validated("raw_steps"),
    f"""judged as (select event_id, step, case when kind <> 'OBJECT' then {s(fixed.MSG_NOT_OBJECT)} else message end as message from validated
    union all select event_id, null, case when a is null then {s(fixed.MSG_PLAN_NOT_LIST)} else {s(fixed.MSG_PLAN_EMPTY)} end
    from raw_plans where a is null or json_array_length(a) = 0)""",
)

_TOK = T._lst(fixed.TOKENS.values())
_XY = " or ".join("json_type({x}, '$." + k + "') is not null" for k in fixed.COORDINATE_KEYS)
PLANS = f"""pk as (select event_id, page_id, task, plan, case when plan is null then '' else json_type(plan) end as kind from parsed),
  pf as (select *, case when json_type(plan, '$.status') = 'VARCHAR' then plan ->> '$.status' end as status,
    case when json_type(plan, '$.reason') = 'VARCHAR' then plan ->> '$.reason' else '' end as why,
    coalesce(json_type(plan, '$.actions'), '') as akind, coalesce({_XY.format(x='plan')}, false) as xy,
    case when json_type(plan, '$.actions') = 'ARRAY' then json_extract(plan, '$.actions[*]') else [] end as acts from pk),
  ax as (select event_id, unnest(acts) as a, unnest(range(len(acts))) as i from pf),
  ap as (select event_id, i, case when json_type(a, '$.action') = 'VARCHAR' then a ->> '$.action' end as action,
    trim(case when json_type(a, '$.target') = 'VARCHAR' then a ->> '$.target' end) as target,
    case when json_type(a, '$.value') = 'VARCHAR' then a ->> '$.value' end as value, json_type(a) as k,
    json_type(a, '$.value') as vk, coalesce({_XY.format(x='a')}, false) as xy from ax),
  problems as (select event_id, arg_min(p, i) as problem from (select event_id, i, case when k <> 'OBJECT' then {s(fixed.PLAN_BAD_ACTION)}
      when coalesce(action, '') not in {T._lst(fixed.PLAN_ACTIONS)} then {s(fixed.PLAN_BAD_KIND)}
      when coalesce(target, '') = '' then {s(fixed.PLAN_NO_TARGET)} when xy then {s(fixed.PLAN_ACTION_COORDINATES)}
      when action = 'type' and value is null then {s(fixed.PLAN_TYPE_VALUE)} when action = 'type' and value in {_TOK} then {s(fixed.PLAN_TYPES_TOKEN)}
      when action <> 'type' and vk is not null then {s(fixed.PLAN_STRAY_VALUE)} end as p from ap) where p is not null group by 1),
  refusals as (select pf.*, case when kind <> 'OBJECT' then {s(fixed.PLAN_INVALID)} when xy then {s(fixed.PLAN_COORDINATES)}
      when coalesce(status, '') not in {T._lst(fixed.PLAN_STATUSES)} then {s(fixed.PLAN_BAD_STATUS)}
      when akind not in ('', 'ARRAY') then {s(fixed.PLAN_BAD_ACTIONS)} when problem is not null then problem
      when status = 'completed' and len(acts) > 0 then {s(fixed.PLAN_COMPLETED_ACTIONS)}
      when status = 'blocked' then case when why = '' then {s(fixed.PLAN_BLOCKED)} else why end end as refused
    from pf left join problems using (event_id)),
  checked as (select r.event_id, page_id, task, case when refused is null then 'ready' else 'blocked' end as plan_status,
    coalesce(refused, why) as plan_reason, case when refused is null then len(acts) else 0 end as n_actions,
    case when refused is null then f.action end as action, case when refused is null then f.target end as target,
    case when refused is null and f.action = 'type' then f.value end as value from refusals r left join (select * from ap where i = 0) f using (event_id))"""


def popup_reason(action: str, target: str, value: str) -> str:
    k = f"lower(trim(coalesce({action}, '')))"
    return f"""case when {k} in {T._lst(fixed.POLICY_CONFIRM)} then {s(fixed.POPUP_BLOCKED)} || {k}
      when {k} not in {T._lst(fixed.POLICY_ALLOWED)} then {s(fixed.POPUP_NOT_ALLOWED)} || {k}
      when trim(coalesce({target}, '')) = '' then {s(fixed.MSG_TARGET_MISSING)}
      when {k} = 'type' and {value} is null then {s(fixed.POPUP_NEEDS_VALUE)} else {s(fixed.POPUP_ALLOWED)} end"""


_HOST = """nullif(lower(regexp_replace(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1), '^.*@', ''), ':.*$', '')), '')"""

LOOP = f"""loop0 as (select *, row_number() over (partition by user_id order by ts, event_id) as cycle from events),
  loop1 as (select event_id, user_id as task_id, user_id as page_id, ts, cycle, {D.LOOP_TASK} as task, {D.LOOP_PLAN} as model_text,
    {D.LOOP_ELAPSED} as elapsed_s, {D.LOOP_EXECUTED} as executed from loop0),
  {K.constraints('loop1')}, {K.SEQUENCES},
  lp as (select c.*, cycle - 1 as idx, {S._ARRAY} as arr from resolved_c c),
  lq as (select *, arr <> '' and json_valid(arr) as parsed, case when arr <> '' and json_valid(arr) then json_array_length(arr)::bigint end as n_planned from lp),
  lw as (select *, case when idx = 0 then 'type' when idx = 1 then 'click' end as wa, case when idx = 0 then type_target when idx = 1 then click_target end as wt,
    case when idx = 0 then type_value end as wv from lq),
  lact as (select event_id, a ->> '$.action' as action, a ->> '$.target' as target, a ->> '$.value' as value, i from (
    select event_id, unnest(json_extract(arr, '$[*]')) as a, unnest(range(n_planned)) as i from lw where parsed)),
  lmatch as (select l.event_id, arg_min(struct_pack(action := a.action, target := a.target, value := a.value), a.i) as hit
    from lw l join lact a using (event_id) where l.intent = 'sequence' and a.action = l.wa and {T.ident('a.target')} = {T.ident('l.wt')}
    and (l.wa <> 'type' or a.value is not distinct from l.wv) group by 1),
  ldec as (select l.*, f.action as fa, f.target as ft, f.value as fv, m.hit,
    case when not parsed then 'unparsable' when intent = 'sequence' and idx >= 2 then 'sequence_done'
      when n_planned = 0 then case when intent = 'general' then 'no_action' else 'act' end
      when intent = 'sequence' then case when m.hit is null then 'step_mismatch' else 'act' end
      when n_planned <> 1 then 'not_one_action'
      when intent = 'click_only' and f.action is distinct from 'click' then 'intent_mismatch'
      when intent = 'type_only' and f.action is distinct from 'type' then 'intent_mismatch' else 'act' end as decision
    from lw l left join (select * from lact where i = 0) f using (event_id) left join lmatch m using (event_id)),
  decided as (select *, case when decision = 'act' then case when intent = 'sequence' then case when n_planned = 0 then wa else hit.action end
        when intent = 'click_only' then 'click' when intent = 'type_only' then 'type' else fa end end as action,
    case when decision = 'act' then case when intent = 'sequence' then case when n_planned = 0 then wt else hit.target end
        when intent = 'click_only' then click_target when intent = 'type_only' then type_target else ft end end as target,
    case when decision = 'act' then case when intent = 'sequence' then case when n_planned = 0 then wv else hit.value end
        when intent = 'type_only' then type_value else fv end end as value from ldec)"""

_EXPECTED = C.rec(C.ELEMENTS, LOOP)

_CYCLES = ", ".join(f"{v} as {n}" for n, v in D.CYCLE_COLUMNS.items())
POPUP = f"""pc0 as (select * replace (task_id * 100 + day(ts) as task_id) from actions),
  pc1 as (select *, row_number() over (partition by task_id order by ts, event_id) as cycle from pc0),
  pc2 as (select *, {_CYCLES} from (select * replace ((cycle - 1) % 5 + 1 as cycle), (cycle - 1) // 5 as run from pc1)),
  {T.canonical_actions('pc2')},
  pc3 as (select p.*, {popup_reason('p.action', 'c.canonical', 'p.value')} as policy_reason,
    {" or ".join(f"contains(lower(after_text), '{x}')" for x in fixed.SUCCESS_PHRASES)} as shows
    from pc2 p left join canonical c using (page_id, action, target)),
  pc as (select *, case when agent_status is null then 'error' when agent_status = 'blocked' then 'blocked' when n_actions = 0 then 'no_actions'
    when policy_reason <> {s(fixed.POPUP_ALLOWED)} then 'blocked' when not executed then 'execution_failed' when verified = false then 'verification_failed'
    when shows then 'completed' else 'continue' end as status from pc3)"""

_AFTER = "fields_after as (" + " union all ".join(
    f"select event_id, {o} as ord, {t} as tag, {p} as placeholder, {a} as aria_label, {n} as name, {i} as id, {v} as value from events"
    for o, t, p, a, n, i, v in D.FIELD_AFTER_ROWS
) + ")"

_STATES = """st as (select event_id, page_id, event_id % 17 <> 0 as has_b, event_id % 23 <> 0 as has_a, event_id % 7 as r from actions where event_type = 'click')"""

SQL = {
    "validate_action": C.rec(C.ELEMENTS, C.ACTIONS, validated()) + "select event_id, canonical, valid, message from validated",
    "validate_plan": _PLANS + """select task_id, plan_day, bool_and(valid) as valid, count(*) as steps, count(*) filter (where not valid) as errors,
      arg_min(message, step) filter (where not valid) as first_error from validated group by 1, 2""",
    "validate_plan_errors": _PLANS + "select task_id, plan_day, step, 'Step ' || step || ': ' || message as error from validated where not valid",
    "validate_raw_action": _RAW + f"select event_id, step, message = {s(fixed.MSG_VALID)} as valid, message from judged",
    "validate_raw_plan": _RAW + f"""select event_id, bool_and(message = {s(fixed.MSG_VALID)}) as valid, count(step) as steps,
      count(*) filter (where message <> {s(fixed.MSG_VALID)}) as errors,
      arg_min(message, coalesce(step, 0)) filter (where message <> {s(fixed.MSG_VALID)}) as first_error from judged group by 1""",
    "validate_model_plan": C.rec(C.MODELS, S.PARSED, PLANS) + "select event_id, plan_status, plan_reason, n_actions, action, target, value from checked",
    "action_policy": C.rec(C.ACTIONS) + f"""select event_id, action, action in {T._lst(fixed.POLICY_ALLOWED)} as allowed,
      case when action in {T._lst(fixed.POLICY_ALLOWED)} then {s(fixed.MSG_ALLOWED)} when action in {T._lst(fixed.POLICY_CONFIRM)}
      then {s(fixed.MSG_CONFIRM)} || action else {s(fixed.MSG_BLOCKED_ACTION)} || action end as reason from actions""",
    "domain_policy": C.rec(C.PAGES) + f"""select source, page_id, host, coalesce(host in {T._lst(fixed.ALLOWED_HOSTS)}, false) as allowed from (
      select 'form' as source, page_id, {_HOST} as host from form_pages union all select 'page', page_id, {_HOST} from pages)""",
    "popup_policy": C.rec(C.ACTIONS) + f"""select event_id, reason = {s(fixed.POPUP_ALLOWED)} as allowed, reason from (
      select event_id, {popup_reason('action', 'target', 'value')} as reason from actions)""",
    "execution_preconditions": C.rec(C.CAPTURED, C.ACTIONS, T.find_dom("(select * from actions where action in ('click', 'type', 'select'))"), C.OPTIONS,
                                     T.options("(select * from actions where action = 'select')")) + f"""
      select event_id, message = '' as ready, message from (select a.event_id, case when a.action not in ('click', 'type', 'select') then {s(fixed.EXEC_UNSUPPORTED)} || a.action
        when f.ord is null then {s(fixed.EXEC_UNRESOLVED)} || a.target when not e.enabled then {s(fixed.EXEC_DISABLED)} || a.target
        when a.action = 'select' and a.value is null then {s(fixed.EXEC_SELECT_VALUE)} when a.action = 'select' and e.tag <> 'select' then {s(fixed.EXEC_SELECT_ELEMENT)}
        when a.action = 'select' and p.opt_no is null then {s(fixed.EXEC_SELECT_OPTION)} || a.value
        when a.action = 'type' and a.value is null then {s(fixed.EXEC_TYPE_VALUE)} when a.action = 'type' and lower(e.input_type) = 'password' then {s(fixed.EXEC_CREDENTIAL)}
        when a.action = 'type' and e.tag not in ('input', 'textarea') then {s(fixed.EXEC_NOT_EDITABLE)} else '' end as message
      from actions a left join fdom f on f.page_id = a.page_id and f.target = a.target left join captured e on e.page_id = f.page_id and e.ord = f.ord
      left join picked p on p.page_id = a.page_id and p.value = a.value)""",
    "navigate_url_check": C.rec(C.PAGES, C.ACTIONS) + """select event_id, regexp_matches(trim(url), '(?i)^https?://') as ok
      from actions join form_pages using (page_id) where lower(action) = 'navigate'""",
    "sequence_step_match": _EXPECTED + """select event_id, idx as step_index, decision = 'act' as matched, action, target from decided
      where intent = 'sequence' and parsed and n_planned > 0 and idx < 2""",
    "fallback_action": _EXPECTED + "select event_id, intent, decision, action, target, value from decided where n_planned = 0",
    "intent_override": _EXPECTED + "select event_id, intent, decision, action, target, value from decided where intent <> 'sequence' and n_planned > 0",
    "budget_limits": C.rec(C.ACTIONS) + f"""select task_id, min(step) as step, arg_min(breach, step) as breach from (
      select task_id, step, case when {Q.ELAPSED} > 120 then 'runtime' when step - 1 >= 20 then 'actions' when replans > 5 then 'replans' end as breach from (
        select *, coalesce(sum(case when event_type = 'view' then 1 else 0 end) over (partition by task_id order by ts, event_id
          rows between unbounded preceding and 1 preceding), 0) as replans from actions)) where breach is not null group by 1""",
    "verify_type": C.rec(C.ACTIONS, _AFTER) + """select event_id, coalesce(found = wanted, false) as verified from (
      select a.event_id, coalesce(any_value(a.value), '') as wanted, arg_min(f.value, (f.tag = 'textarea', f.ord)) as found from actions a left join fields_after f
      on f.event_id = a.event_id and a.target <> '' and lower(a.target) in (lower(placeholder), lower(aria_label), lower(name), lower(id))
      where a.action = 'type' group by 1)""",
    "click_state_capture": C.rec(C.CAPTURED, C.ACTIONS) + f"""select r.page_id, r.target, e.ord is not null as found, e.ord, visible, enabled, aria_expanded, aria_pressed, class
      from (select distinct page_id, target from actions where action = 'click') r left join (
        select *, {", ".join(f"{v} as {n}" for n, v in D.CLICK_ATTRIBUTES.items())}, lower(coalesce(nullif({K.st('text')}, ''), aria_label)) as lab,
          row_number() over (partition by page_id, lower(coalesce(nullif({K.st('text')}, ''), aria_label)) order by type = 'link', ord) as rn
        from captured where type in ('button', 'link')) e on e.page_id = r.page_id and e.lab = lower(r.target) and e.rn = 1""",
    "verify_click": C.rec(C.ACTIONS, _STATES) + """select event_id, r = 0 as url_changed, r = 1 as page_changed, r = 2 as html_changed,
      has_b and (r in (0, 1, 2) or not has_a or r in (3, 4)) as verified from st""",
    "verify_page_change": C.rec(C.ACTIONS, _STATES) + """select event_id, r = 0 as url_changed, r = 1 as page_changed,
      has_b <> has_a or (has_a and has_b and r in (3, 4)) as elements_changed,
      r in (0, 1) or has_b <> has_a or (has_a and has_b and r in (3, 4)) as verified from st""",
    "verify_select": C.rec(C.OPTIONS, f"sreq as (select event_id, user_id as page_id, {TQ.OPTION_VALUE} as value, {Q.VALUE_AFTER} as value_after from events where event_type = 'signup')",
                           T.options("sreq")) + """select event_id, opt_value, coalesce(value_after = opt_value, false) as verified
      from sreq left join picked using (page_id, value)""",
    "first_action_per_cycle": C.rec(C.ACTIONS) + """select task_id, cycle, event_id, action, target from (select *, day(ts) as cycle,
      row_number() over (partition by task_id, day(ts) order by ts, event_id) as rn from actions) where rn = 1""",
    "cycle_status": C.rec(C.ELEMENTS, C.ACTIONS, POPUP) + "select event_id, task_id, run, cycle, policy_reason, status from pc",
    "cycle_outcome": C.rec(C.ELEMENTS, C.ACTIONS, POPUP) + """select task_id, run, coalesce(arg_min(status, cycle) filter (where status <> 'continue'),
      case when max(cycle) >= 5 then 'max_cycles' else 'running' end) as status,
      coalesce(min(cycle) filter (where status <> 'continue'), max(cycle)) as cycle from pc group by 1, 2""",
    "task_outcome": C.rec(C.ACTIONS) + f"""select task_id, count(*) filter (where ok) as verified, case when bool_and(ok) and bool_or(completed)
      and (max(intent) <> 'sequence' or count(*) filter (where ok) >= max(n_steps)) then 'completed' else 'failed' end as outcome
      from (select task_id, {", ".join(f"{v} as {n}" for n, v in Q.HISTORY.items())} from actions) group by 1""",
    "status_message": C.rec(C.ELEMENTS, C.ACTIONS, POPUP) + f"""select event_id, state as status, case when state = 'completed' then {s(fixed.SHOWN_DONE)}
      when state = 'blocked' then case when regexp_matches(lower(reason), 'credential|password|login') then {s(fixed.SHOWN_LOGIN)}
        when contains(lower(reason), {s(fixed.SHOWN_USER_INFO)}) then {s(fixed.SHOWN_MISSING)} when reason <> '' then 'Problem: ' || reason else {s(fixed.SHOWN_BLOCKED)} end
      when state = 'no_actions' then {s(fixed.SHOWN_NO_ACTIONS)} when state = 'agent_not_ready' then {s(fixed.SHOWN_NOT_READY)}
      when state = 'execution_failed' then {s(fixed.SHOWN_EXEC_FAILED)} when state = 'max_cycles_reached' then {s(fixed.SHOWN_MAX_CYCLES)}
      when event_id % 3 = 0 then 'Problem: lost page' else '' end as message from (select *, case when event_id % 43 = 0 then 'max_cycles_reached'
        when event_id % 47 = 0 then 'agent_not_ready' else status end as state,
        case when agent_status = 'blocked' then agent_reason else policy_reason end as reason from pc)""",
    "action_history": C.rec(C.ACTIONS) + """select task_id, n as number, event_id, n || '. ' || upper(action) || ' ' || target ||
      case when upper(action) = 'TYPE' then ' -> ' || coalesce(value, '') else '' end as line from (select *,
      row_number() over (partition by task_id order by ts, event_id) as n from actions where trim(target) <> '' and event_id % 5 <> 4)""",
    "task_counters": C.rec(C.ACTIONS) + """select task_id, count(*) as actions, count(*) filter (where event_type = 'view') as replans,
      epoch_us(max(ts)) - epoch_us(min(ts)) as runtime_us from actions group by 1""",
}
