"""SQL of the source and sink queries."""

from __future__ import annotations

from oracles import common as C
from oracles import privacy_sql as V
from pagewarden.functions import fixed

_HIDE = "regexp_replace({}, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g')"


def _decode(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def _text(x: str) -> str:
    x = f"regexp_replace({x}, '(?i)<br\\s*/?>|</(?:p|div|li|h[1-6]|tr|td|option|title)\\s*>', chr(10), 'g')"
    x = _decode(f"regexp_replace({x}, '<[^>]*>', '', 'g')")
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({x}, ' ?\\n[ \\n]*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


def _attr(name: str) -> str:
    return _decode(f"regexp_extract(t, '(?i)\\s{name}\\s*=\\s*\"([^\"]*)\"', 1)")


def _scan(source: str) -> str:
    kinds = (("button", "button"), ("input", "input"), ("textarea", "textarea"), ("select", "select"), ("link", "a"))
    parts = []
    for n, (kind, tag) in enumerate(kinds):
        end = "" if tag == "input" else f".*?</{tag}\\s*>"
        parts.append(
            f"select page_id, {n} as kn, '{kind}' as type, '{tag}' as tag, regexp_extract_all(h, '(?is)<{tag}\\b[^>]*>{end}') as ms from shown"
        )
    return f"""shown as (select page_id, {_HIDE.format('html')} as h from {source}),
      per_kind as ({' union all '.join(parts)}),
      tags as (select page_id, kn, type, tag, unnest(ms) as m, unnest(range(len(ms))) as i from per_kind),
      scanned as (select *, regexp_extract(m, '(?s)^<[^>]*>') as t,
        row_number() over (partition by page_id order by kn, i) - 1 as ord from tags)"""


_INNER = _text("regexp_replace(m, '(?s)^<[^>]*>|</[a-zA-Z]+\\s*>$', '', 'g')")
_ELEMENT_TEXT = f"case when tag = 'input' then '' else {_INNER} end as text"
_TABLE = f"""tb as (select page_id, array_to_string(regexp_extract_all({_HIDE.format('html')}, '(?is)<tbody\\b[^>]*>(.*?)</tbody\\s*>', 1), '') as b from form_html),
  tr as (select page_id, regexp_extract_all(b, '(?is)<tr\\b[^>]*>(.*?)</tr\\s*>', 1) as rs from tb),
  td as (select page_id, unnest(rs) as r, unnest(range(len(rs))) as i from tr),
  cells as (select page_id, i, list_filter(list_transform(regexp_extract_all(r, '(?is)<td\\b[^>]*>(.*?)</td\\s*>', 1),
    lambda c: {_text('c')}), lambda c: c <> '') as cs from td),
  table_rows as (select page_id, row_number() over (partition by page_id order by i) as row_no, array_to_string(cs, '|') as cells
    from cells where len(cs) > 0)"""
_BODY_TEXT = _text(f"regexp_replace({_HIDE.format('html')}, '(?is)<head\\b.*?</head\\s*>', '', 'g')")

# Validity of model texts.
_ARRAY = "regexp_extract(model_text, '(?s)\\[.*\\]')"
PARSED = f"""stripped as (select event_id, page_id, task, model_text, regexp_replace(regexp_replace(regexp_replace(model_text, '^\\s+|\\s+$', '', 'g'),
    '(?i)^```(?:json)?\\s*', ''), '\\s*```$', '') as s from model_texts),
  cand as (select event_id, s, unnest(list_filter(range(1, length(s) + 1), lambda i: s[i] = '{{')) as i from stripped
    where not coalesce(json_valid(s), false)),
  pref as (select event_id, i, substr(s, i, j - i + 1) as piece, j from (
    select event_id, s, i, unnest(list_filter(range(i, length(s) + 1), lambda j: s[j] = '}}')) as j from cand)),
  firsts as (select event_id, arg_min(piece, i * 100000 + j) as piece from pref where json_valid(piece) group by 1),
  parsed as (select event_id, page_id, task, model_text, case when json_valid(s) then s else piece end as plan
    from stripped left join firsts using (event_id))"""

SQL = {
    "scan_page_elements": C.rec(_scan("pages")) + f"select page_id, ord, type, tag, {_ELEMENT_TEXT}, {_attr('href')} as href from scanned",
    "scan_form_elements": C.rec(C.HTML, _scan("form_html")) + f"""select page_id, ord, type, tag, {_ELEMENT_TEXT},
      {_attr('aria-label')} as aria_label, {_attr('placeholder')} as placeholder, {_attr('type')} as input_type, {_attr('name')} as name,
      {_attr('id')} as id, {_attr('value')} as value, {_attr('href')} as href,
      not regexp_matches(t, '(?i)\\sdisabled[\\s>=/]') as enabled,
      case when tag = 'select' then trim(regexp_extract(h, '<label>([^<]*)<select', 1))
        when {_attr('id')} <> '' then regexp_extract(h, '<label for="' || {_attr('id')} || '">([^<]*)</label>', 1) else '' end as label
      from scanned join shown using (page_id)""",
    "filter_visible_enabled": C.rec(C.ELEMENTS) + "select page_id, ord, type, enabled, box_y from elements",
    "page_text": f"""select page_id, {_decode(f"regexp_extract({_HIDE.format('html')}, '(?is)<title[^>]*>(.*?)</title\\s*>', 1)")} as title,
      {_BODY_TEXT} as page_text from pages""",
    "page_state": C.rec(C.ELEMENTS, C.PAGES) + """select p.*, e.elements from form_pages p left join (
      select page_id, string_agg(ord || ':' || type || ':' || name || ':' || text || ':' || value, '|' order by ord) as elements
      from elements group by 1) e using (page_id)""",
    "ingest_page_state_json": C.rec(V.INGEST) + """select page_id, url, title, page_text, ord, tag, text, name, input_type, value, enabled, box_width
      from form_pages left join elements using (page_id)""",
    "scan_ocr_tokens": C.rec(C.OCR) + "select image_id, line_num, word_no, text, conf, block_num, par_num, x, w from ocr_tokens",
    "ocr_page_text": C.rec(C.OCR) + "select image_id, string_agg(text, ' ' order by line_num, word_no) as ocr_text from ocr_tokens group by 1",
    "parse_plan_array": C.rec(C.MODELS) + f"""select event_id, coalesce(json_valid(a) and a <> '', false) as parsed,
      case when a <> '' and json_valid(a) then json_array_length(a) end as n_items,
      case when a <> '' and json_valid(a) then a ->> '$[0].action' end as first_action,
      case when a <> '' and json_valid(a) then a ->> '$[0].target' end as first_target
      from (select event_id, {_ARRAY} as a from model_texts)""",
    "parse_plan_object": C.rec(C.MODELS, PARSED) + """select event_id, lower(json_type(plan)) as kind,
      case when json_type(plan) = 'OBJECT' then plan ->> '$.status' end as status,
      case when json_type(plan) = 'OBJECT' then plan ->> '$.reason' end as reason from parsed""",
    "html_table_rows": C.rec(C.HTML, _TABLE) + "select page_id, row_no, cells from table_rows",
    "html_rows_top3": C.rec(C.HTML, _TABLE) + "select page_id, row_no, cells from table_rows where row_no <= 3",
    "transaction_lines_fallback": C.rec(C.HTML, _TABLE) + f""",
      tx as (select page_id, list_filter(list_transform(string_split({_BODY_TEXT}, chr(10)), lambda t: trim(t)),
        lambda t: t <> '' and regexp_matches(t, '(?i){fixed.TRANSACTION_LINE}')) as ls from form_html
        where page_id not in (select page_id from table_rows))
      select page_id, unnest(range(1, len(ls) + 1)) as row_no, unnest(ls) as cells from (select page_id, ls[1:3] as ls from tx)""",
    "transaction_cards_fallback": C.rec(C.HTML, _TABLE) + f""",
      tx as (select page_id, list_filter(list_transform(regexp_extract_all({_HIDE.format('html')},
        '(?s)<(?:div|p|li)\\b[^>]*\\sclass="[^"]*[tT]ransaction[^"]*"[^>]*>(.*?)</(?:div|p|li)\\s*>', 1),
        lambda c: array_to_string(list_filter(list_transform(string_split({_text('c')}, chr(10)), lambda t: trim(t)), lambda t: t <> ''), '|')),
        lambda c: c <> '') as ls from form_html where page_id not in (select page_id from table_rows))
      select page_id, unnest(range(1, len(ls) + 1)) as row_no, unnest(ls) as cells from (select page_id, ls[1:3] as ls from tx)""",
    "sink_results": C.rec(C.ACTIONS) + """select task_id,
      coalesce(arg_max(case when event_type = 'error' then 'idle' else event_type end, (ts, event_id)), 'idle') as status,
      arg_max(target, (ts, event_id)) as target from actions group by 1""",
    "sink_merged": C.rec(C.ACTIONS) + """select task_id, coalesce(arg_max(status, part) filter (where status is not null), 'idle') as status,
      arg_max(target, part) filter (where target is not null) as target from (
        select task_id, dayofyear(ts) % 3 as part, target, case when event_type <> 'error' then event_type end as status from actions
        qualify row_number() over (partition by task_id, dayofyear(ts) % 3 order by ts desc, event_id desc) = 1) group by 1""",
    "prompt_dataset": C.rec(C.FINDINGS, V.CLEAN_ELEMENTS, V.CLEAN_PAGES, C.TASKS) + """,
      js as (select page_id, '[' || string_agg(to_json({'ord': ord, 'type': e.type, 'text': c.text, 'name': c.name, 'value': c.value})::varchar, ',' order by ord) || ']' as j
        from clean_el c join elements e using (page_id, ord) group by 1)
      select event_id, t.page_id, 'Task: ' || task || chr(10) || 'Address: ' || url || chr(10) || 'Title: ' || title || chr(10) ||
        'Elements: ' || j || chr(10) || 'Text: ' || c.page_text || chr(10) ||
        'Answer with one JSON object holding status, reason and actions.' as prompt
      from tasks t join form_pages p using (page_id) join clean_pg c using (page_id) join js using (page_id)
      where trim(task) <> ''""",
}
