"""SQL of the streams: the same result as over the whole table at once."""

from oracles import flow_sql
from pagewarden.plans.stream_queries import REPLANS

SQL = {
    "inspect_stream": flow_sql.SQL["inspect_batch"],
    "budget_stream": f"""select task_id, min(step) as step, arg_min(breach, step) as breach from (
      select task_id, step, case when epoch_us(ts) - epoch_us(first_ts) > 120 * 3600000000::bigint then 'runtime'
        when step - 1 >= 20 then 'actions' when replans > 5 then 'replans' end as breach from (
        select user_id as task_id, ts, row_number() over w as step, min(ts) over (partition by user_id) as first_ts,
          coalesce(sum(({REPLANS})::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as replans
        from events window w as (partition by user_id order by ts, event_id))) where breach is not null group by 1""",
}
