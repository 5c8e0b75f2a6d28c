"""SQL of the composed flows."""

from __future__ import annotations

from oracles import common as C
from oracles import policy_sql as Y
from oracles import privacy_sql as V
from oracles import source_sql as S
from oracles import task_sql as K
from pagewarden.functions import fixed

_TOK = Y._TOK

SQL = {
    "inspect_batch": C.rec(V.INGEST, V._FINDINGS_TAIL, V.CLEAN_ELEMENTS, V.CLEAN_PAGES, V.SUMMARY) + """
      select p.page_id, url, c.page_text, s.findings, types, coalesce(n, 0) as elements, coalesce(masked, 0) as masked, coalesce(texts, '') as texts
      from form_pages p join clean_pg c using (page_id) join summary s using (page_id) left join (
        select page_id, count(*) as n, count(*) filter (where value like '[%') as masked,
        string_agg(text, '|' order by ord) as texts from clean_el group by 1) using (page_id)""",
    "agent_decision_batch": C.rec(C.FINDINGS, V.CLEAN_ELEMENTS, C.MODELS, "tasks as (select event_id, page_id, task from model_texts)",
                                  K.CONTEXT, K.STEPS, S.PARSED, Y.PLANS) + f""",
      fin as (select c.event_id, trim(coalesce(c.task, '')) = '' as blank, {K._MISSING.replace('task,', 'c.task,')} <> '' as missing, t.status as ss,
        t.step_reason, t.step_action, trim(t.step_target) as st, t.step_value, c.* exclude (event_id, task),
        case when t.step_action is not null then case when coalesce(trim(t.step_target), '') = '' then {Y.s(fixed.PLAN_NO_TARGET)}
          when t.step_value in {_TOK} then {Y.s(fixed.PLAN_TYPES_TOKEN)} end end as fault from checked c join steps t using (event_id))
      select event_id, not blank as success, case when blank then {Y.s(fixed.TASK_REQUIRED)} end as error,
        case when blank then null when missing then 'blocked' when ss = 'plan' then plan_status
          when ss = 'blocked' or fault is not null then 'blocked' else 'ready' end as status,
        case when blank then null when missing then {Y.s(fixed.PLAN_MISSING_INFO)} when ss = 'plan' then plan_reason else coalesce(fault, step_reason) end as reason,
        case when blank or missing then 0 when ss = 'plan' then n_actions when step_action is not null and fault is null then 1 else 0 end as n_actions,
        case when blank or missing then null when ss = 'plan' then action when fault is null then step_action end as action,
        case when blank or missing then null when ss = 'plan' then target when fault is null and step_action is not null then st end as target,
        case when blank or missing then null when ss = 'plan' then value when fault is null and step_action is not null then step_value end as value from fin""",
    "loop_replay": C.rec(C.ELEMENTS, Y.LOOP, Y.validated("decided")) + f""",
      judged as (select *, case when action = 'type' then (case when event_id % 13 = 0 then 'other' else value end) is not distinct from value
          else event_id % 17 <> 0 and event_id % 5 <> 4 end as seen from validated),
      outcomes as (select task_id, cycle, case when elapsed_s > 120 then 'runtime_limit' when cycle - 1 > 5 then 'replan_limit'
          when decision = 'sequence_done' then 'completed' when decision <> 'act' then decision when not valid then 'invalid_action'
          when not executed then 'execution_failed' when not seen then 'verification_failed'
          when intent in ('click_only', 'type_only') or (intent = 'sequence' and cycle >= 2) then 'completed' end as outcome from judged)
      select task_id, coalesce(arg_min(outcome, cycle) filter (where outcome is not null), 'unfinished') as ended_by,
        coalesce(min(cycle) filter (where outcome is not null), max(cycle)) as cycle,
        case when arg_min(outcome, cycle) filter (where outcome is not null) = 'completed' then 'completed' else 'failed' end as result
      from outcomes group by 1""",
}
