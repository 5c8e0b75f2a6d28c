"""SQL of the target queries: plain comparisons of requests with page elements."""

from __future__ import annotations

from oracles import common as C
from pagewarden.functions import fixed
from pagewarden.plans import target_queries as Q

_ALL = ("text", "aria_label", "placeholder", "name", "id")


def ident(x: str) -> str:
    return f"lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"


def squash(x: str) -> str:
    return f"regexp_replace({ident(x)}, '\\s+', ' ', 'g')"


def words(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def fields(form, columns=_ALL, alias="e.") -> str:
    return "[" + ", ".join(form(alias + c) for c in columns) + "]"


def selectors(source: str, elements: str = "elements") -> str:
    """CTEs: sel(page_id, target, form, val) parsed selector targets; sel_hit with ord."""
    cases, values, hits = [], [], []
    for form, tag, attribute, types, column in fixed.SELECTOR_FORMS:
        pattern = f"(?i)^{tag}\\s*\\[\\s*{attribute}\\s*=\\s*[''\"]([^''\"]+)[''\"]\\s*\\]$"
        t = "regexp_replace(target, '^\\s+|\\s+$', '', 'g')"
        cases.append(f"when regexp_matches({t}, '{pattern}') then '{form}'")
        values.append(f"when regexp_matches({t}, '{pattern}') then {ident(f'''regexp_extract({t}, '{pattern}', 1)''')}")
        hits.append(f"(s.form = '{form}' and e.type in ({', '.join(repr(x) for x in types)}) and {ident('e.' + column)} = s.val)")
    return f"""sel as (select distinct page_id, target, case {' '.join(cases)} end as form, case {' '.join(values)} end as val from {source}),
  sel_hit as (select s.page_id, s.target, s.form, s.val, e.ord from sel s join {elements} e on e.page_id = s.page_id and ({' or '.join(hits)}))"""


def resolve(source: str, elements: str = "elements") -> str:
    """CTEs ending in resolved(page_id, action, target, n, canonical, canonical_n, any_input, any_click)."""
    exact = f"list_contains({fields(ident)}, {ident('r.target')}) and {ident('r.target')} <> ''"
    return f"""req as (select distinct page_id, action, target from {source}),
  ex_hit as (select distinct r.page_id, r.target, e.ord from (select distinct page_id, target from req) r join {elements} e on e.page_id = r.page_id and {exact}),
  {selectors('req', elements)},
  all_hit as (select * from ex_hit union all select page_id, target, ord from sel_hit s
    where not exists (select 1 from ex_hit x where x.page_id = s.page_id and x.target = s.target)),
  h as (select page_id, target, count(*) as n, min(ord) as ord, bool_or(type in ('input', 'textarea')) as i, bool_or(type in ('button', 'link')) as c
    from all_hit join {elements} using (page_id, ord) group by 1, 2),
  canon as (select r.page_id, r.action, r.target, h.n, h.i, h.c, case {ident('r.action')}
      when 'type' then coalesce(nullif(e.placeholder, ''), nullif(e.aria_label, ''), nullif(e.name, ''), nullif(e.id, ''))
      when 'click' then coalesce(nullif(e.text, ''), nullif(e.aria_label, '')) end as label
    from req r join h using (page_id, target) join {elements} e on e.page_id = r.page_id and e.ord = h.ord),
  again as (select k.page_id, k.label, count(*) as n, bool_or(type in ('input', 'textarea')) as i, bool_or(type in ('button', 'link')) as c
    from (select distinct page_id, label from canon where label is not null) k
    join {elements} e on e.page_id = k.page_id and list_contains({fields(ident)}, {ident('k.label')}) group by 1, 2),
  resolved as (select c.page_id, action, target, c.n, coalesce(c.label, target) as canonical,
    case when c.label is null then c.n else coalesce(a.n, 0) end as canonical_n,
    coalesce(case when c.label is null then c.i else a.i end, false) as any_input,
    coalesce(case when c.label is null then c.c else a.c end, false) as any_click
    from canon c left join again a using (page_id, label))"""


CONTEXT = "ctx as (select * replace ('' as type) from elements)"


def bridge(requests: str, source: str = "ctx", prefix: str = "") -> str:
    """CTEs ending in {prefix}bridge(page_id, kind, target, ord, rule, ...)."""
    p = prefix
    kind_test = """case kind when 'type' then tagname in ('input', 'textarea') when 'select' then tagname = 'select'
      when 'click' then tagname in ('button', 'a') else tagname in ('button', 'input', 'textarea', 'select', 'a') end"""
    aliases = " ".join(
        "when " + words(ident("target")) + " in (" + ", ".join(f"'{n.replace('-', ' ')}'" for n in names)
        + ") then regexp_matches(form, '" + "|".join(n.replace("-", " ") for n in names) + "')"
        for names in fixed.FIELD_ALIASES.values()
    )
    return f"""{p}breq as (select distinct page_id, kind, target from {requests} where {ident('target')} <> ''),
  {p}bcand as (select r.*, e.ord, {fields(ident, _ALL, '')} as vals, lower(coalesce(nullif(type, ''), tag)) as tagname
    from {p}breq r join {source} e on e.page_id = r.page_id where lower(input_type) <> 'password'),
  {p}bform as (select *, {words("array_to_string(vals, ' ')")} as form, {words(ident('target'))} as goal from {p}bcand where {kind_test}),
  {p}bscore as (select *, (case when goal = form then 100 else 0 end) + coalesce(list_sum(list_transform(
      list_filter(string_split(goal, ' '), lambda w: w <> ''), lambda w: case when list_contains(string_split(form, ' '), w) then 20
        when contains(form, w) then 5 else 0 end)), 0) as score,
    case {aliases} else false end as alias_hit, list_contains(vals, {ident('target')}) as exact_hit from {p}bform),
  {p}bagg as (select page_id, kind, target, min(ord) filter (where exact_hit) as e_ord, max(score) as best,
    count(*) filter (where alias_hit) as a_n, min(ord) filter (where alias_hit) as a_ord, count(*) as c_n, min(ord) as c_ord
    from {p}bscore group by 1, 2, 3),
  {p}bbest as (select page_id, kind, target, any_value(score) as score, count(*) as ties, min(s.ord) as ord
    from {p}bscore s join {p}bagg a using (page_id, kind, target) where s.score = a.best and s.score > 0 group by 1, 2, 3),
  {p}bridge as (select page_id, kind, target, case when e_ord is not null then e_ord when ties = 1 then b.ord
      when a_n = 1 then a_ord when c_n = 1 then c_ord end as ord,
    case when e_ord is not null then 'exact' when ties = 1 then 'score' when a_n = 1 then 'alias' when c_n = 1 then 'single' end as rule
    from {p}bagg left join {p}bbest b using (page_id, kind, target))"""


BREQ = f"breqs as (select user_id as page_id, {Q.BRIDGE_KIND} as kind, {Q.BRIDGE_TARGET} as target from events)"
_BRIDGE = C.rec(C.ELEMENTS, CONTEXT, BREQ, bridge("breqs"))

_SUIT_CLICK = "trim(lower(e.type)) in ('button', 'link')"
_SUIT_TYPE = "(trim(lower(e.type)) in ('input', 'textarea') and trim(lower(e.input_type)) <> 'password')"


def _lst(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def needle(target: str, action: str) -> str:
    suffix = "|".join(fixed.CONTROL_SUFFIXES)
    return f"""case when {squash(target)} in {_lst(fixed.NAME_FIELD_PHRASES)} then case when {action} = 'type' then 'name' end
      when {squash(target)} in {_lst(fixed.SEARCH_FIELD_PHRASES)} then case when {action} = 'type' then 'search' end
      when {squash(target)} in {_lst(fixed.SEARCH_CLICK_PHRASES)} then case when {action} = 'click' then 'search' end
      when regexp_matches({squash(target)}, ' ({suffix})$') then nullif(trim(regexp_replace({squash(target)}, '\\s+({suffix})$', '')), '') end"""


def canonical_actions(source: str, elements: str = "elements") -> str:
    act = ident("coalesce(action, '')")
    return f"""creq as (select distinct page_id, action, target, {act} as act, {needle("coalesce(target, '')", act)} as needle,
    {squash("coalesce(target, '')")} as norm from {source}),
  cpair as (select r.page_id, r.action, r.target, r.act, e.ord, {_SUIT_TYPE} as can_type, {_SUIT_CLICK} as can_click,
    list_contains({fields(squash)}, r.norm) as x, r.needle is not null and len(list_filter({fields(squash)}, lambda v: v <> '' and contains(v, r.needle))) > 0 as s,
    coalesce(nullif(trim(e.placeholder), ''), nullif(trim(e.aria_label), ''), nullif(trim(e.name), ''), nullif(trim(e.id), '')) as tl,
    coalesce(nullif(trim(e.text), ''), nullif(trim(e.aria_label), ''), nullif(trim(e.placeholder), ''), nullif(trim(e.name), ''), nullif(trim(e.id), '')) as cl
    from creq r left join {elements} e using (page_id)),
  cagg as (select page_id, action, target, any_value(act) as act,
    count(*) filter (where can_type and x) as tx, max(tl) filter (where can_type and x) as txl,
    count(*) filter (where can_type and s) as ts, max(tl) filter (where can_type and s) as tsl,
    count(*) filter (where not can_type and x) as ox, count(*) filter (where can_type) as tn, max(tl) filter (where can_type) as tnl,
    count(*) filter (where can_click and x) as cx, max(cl) filter (where can_click and x) as cxl,
    count(*) filter (where can_click and s) as cs, max(cl) filter (where can_click and s) as csl from cpair group by 1, 2, 3),
  canonical as (select page_id, action, target, case when target is null or trim(target) = '' then target
    when act = 'type' then case when tx = 1 and txl is not null then txl when ts = 1 and tsl is not null then tsl
      when ox > 0 and tn = 1 and tnl is not null then tnl else '' end
    when act = 'click' then case when cx = 1 and cxl is not null then cxl when cs = 1 and csl is not null then csl else target end
    else target end as canonical from cagg)"""


def find_dom(source: str, elements: str = "captured") -> str:
    drop = "(?i)\\b(?:dropdown|drop-down|select|selector|menu)\\b"
    field = "(?i)\\b(?:field|input|textbox|text box)\\b"
    with_text = "(?i)^(?:button|input|textarea|select|link)\\s+with\\s+text\\s+[''\"](.+)[''\"]$"
    plain = "(?i)^(?:button|input|textarea|select|link)\\s+(.+)$"
    return f"""freq as (select distinct page_id, target, trim(target) as t, lower(trim(target)) as l from {source} where trim(target) <> ''),
  fwords as (select *, regexp_matches(l, '{drop}') as is_drop, regexp_matches(t, '{field}') as is_field,
    list_filter(string_split(trim(regexp_replace(regexp_replace(l, '{drop}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') as ws,
    trim(regexp_replace(l, '{field}', '', 'g')) as phrase,
    case when regexp_matches(t, '{with_text}') then trim(regexp_extract(t, '{with_text}', 1)) end as text4,
    case when regexp_matches(t, '{plain}') then trim(regexp_extract(t, '{plain}', 1)) end as text5 from freq),
  fpair as (select f.*, e.ord, e.tag,
    is_drop and e.tag = 'select' and len(ws) > 0 and len(list_filter(ws, lambda w: not contains(
      regexp_replace(lower(e.name || ' ' || e.id || ' ' || e.aria_label || ' ' || e.placeholder || ' ' || e.label || ' ' || e.text), '[^a-z0-9]+', ' ', 'g'), w))) = 0 as r0,
    is_drop and e.tag = 'select' and len(list_filter(ws, lambda w: contains(lower(e.name || ' ' || e.id || ' ' || e.aria_label || ' ' || e.label || ' ' || e.text), w))) > 0 as r1,
    is_field and phrase <> '' and ((e.tag = 'input' and lower(e.input_type) <> 'password') or e.tag = 'textarea')
      and (contains(lower(e.name), phrase) or contains(lower(e.id), phrase) or contains(lower(e.placeholder), phrase) or contains(lower(e.aria_label), phrase)) as r2,
    list_contains({fields(ident)}, l) as r3, coalesce(trim(e.text) = text4, false) as r4, coalesce(trim(e.text) = text5, false) as r5
    from fwords f join {elements} e using (page_id)),
  fagg as (select page_id, target, {", ".join(f"count(*) filter (where r{i}) as n{i}, min(ord) filter (where r{i}) as o{i}" for i in range(6))},
    count(*) filter (where tag = 'select') as n_sel from fpair group by 1, 2),
  fdom as (select * from (select page_id, target, case when n0 = 1 then 0 when n_sel = 1 and n1 = 1 then 1 when n2 = 1 then 2 when n3 = 1 then 3
      when n4 = 1 then 4 when n5 = 1 then 5 end as rule_no,
    case when n0 = 1 then o0 when n_sel = 1 and n1 = 1 then o1 when n2 = 1 then o2 when n3 = 1 then o3 when n4 = 1 then o4 when n5 = 1 then o5 end as ord
    from fagg) where ord is not null)"""


def options(source: str) -> str:
    return f"""oreq as (select distinct page_id, value from {source} where value is not null),
  opick as (select r.page_id, r.value, o.opt_no, o.opt_text, o.opt_value, row_number() over (partition by r.page_id, r.value
      order by case when lower(trim(opt_text)) = lower(trim(r.value)) then 0 else 1 end, opt_no) as rn
    from oreq r join options o on o.page_id = r.page_id
      and lower(trim(r.value)) in (lower(trim(opt_text)), lower(trim(opt_value)))),
  picked as (select page_id, value, opt_no, opt_text, opt_value from opick where rn = 1)"""


SQL = {
    "match_exact": C.rec(C.ELEMENTS, C.ACTIONS) + f"""select distinct r.page_id, r.target, e.ord from
      (select distinct page_id, {ident('target')} as target from actions) r join elements e
      on e.page_id = r.page_id and r.target <> '' and list_contains({fields(ident)}, r.target)""",
    "match_selector": C.rec(C.ELEMENTS, C.ACTIONS, selectors("actions")) + f"""select distinct page_id, {ident('target')} as target,
      form || '|' || val as key, ord from sel_hit s where not exists (select 1 from elements e where e.page_id = s.page_id
        and list_contains({fields(ident)}, {ident('s.target')}))""",
    "canonical_target": C.rec(C.ELEMENTS, C.ACTIONS, resolve("(select * from actions where trim(target) <> '')")) + "select * from resolved",
    "eligible_elements": C.rec(C.ELEMENTS) + """select page_id, ord, kind from elements, (values ('any'), ('type'), ('select'), ('click')) k(kind)
      where lower(input_type) <> 'password' and case kind when 'type' then tag in ('input', 'textarea') when 'select' then tag = 'select'
        when 'click' then tag in ('button', 'a') else tag in ('button', 'input', 'textarea', 'select', 'a') end""",
    "match_scored": _BRIDGE + "select page_id, kind, target, score, ties, ord from bbest",
    "match_alias": _BRIDGE + "select page_id, kind, target, a_ord as ord from bagg where a_n = 1",
    "match_fallback_single": _BRIDGE + "select page_id, kind, target, c_ord as ord from bagg where c_n = 1",
    "resolve_bridge_target": _BRIDGE + "select page_id, kind, target, ord, rule from bridge where ord is not null",
    "suitable_for_action": C.rec(C.ELEMENTS) + f"""select page_id, ord, {_SUIT_CLICK} as for_click, {_SUIT_TYPE} as for_type,
      false as for_select from elements e""",
    "match_semantic": C.rec(C.ELEMENTS, C.ACTIONS, canonical_actions("actions")) + f"""select distinct p.page_id, r.act as action, r.needle, p.ord
      from cpair p join creq r on r.page_id = p.page_id and r.action = p.action and r.target = p.target
      where p.s and r.act in ('type', 'click') and case r.act when 'type' then can_type else can_click end""",
    "canonicalize_action": C.rec(C.ELEMENTS, C.ACTIONS, canonical_actions("actions")) + "select * from canonical",
    "find_target_dom": C.rec(C.CAPTURED, C.ACTIONS, find_dom("actions")) + "select * from fdom",
    "select_option": C.rec(C.OPTIONS, f"oreqs as (select user_id as page_id, {Q.OPTION_VALUE} as value from events)", options("oreqs")) + "select * from picked",
    "normalize_target_text": f"select conv_id, turn, {squash('text')} as squashed, {words('text')} as words from conversations",
}
