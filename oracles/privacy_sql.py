"""SQL of the privacy queries."""

from __future__ import annotations

from oracles import common as C
from pagewarden.functions import fixed

_DOC_PII = C.pii_cte("doc_pii", "(select doc_id, lang, text as txt from documents)", "doc_id, lang")


def _numbered(findings: str, keys: str, order: str) -> str:
    return f"(select *, row_number() over (partition by {keys} order by {order}) as n from {findings})"


_DOC_CLEAN = C.folded(
    "doc_clean",
    "(select doc_id, type, value, row_number() over (partition by doc_id order by start_, pattern_no) as n from doc_pii)",
    "doc_id", "documents", ["text"],
)
_DOC = C.rec(_DOC_PII, _DOC_CLEAN)


def _detect(name: str) -> str:
    return C.rec(
        C.ELEMENTS,
        "all_texts as (select 'document' as source, doc_id as id, text as txt from documents union all "
        "select 'field', page_id * 100 + ord, value from elements)",
        C.pii_cte("found", "all_texts", "source, id"),
    ) + f"""select source, id, row_number() over (partition by source, id order by start_) - 1 as seq, value,
      start_ as start, end_ as "end" from found where type = '{name}'"""


_ELEMENT_NUMBERED = (
    "(select page_id, elem_ord as ord, type, value, row_number() over (partition by page_id, elem_ord order by seq) as n "
    "from findings where is_text = 0)"
)
CLEAN_ELEMENTS = C.folded("clean_el", _ELEMENT_NUMBERED, "page_id, ord", "elements", list(fixed.INSPECTED_FIELDS))
CLEAN_PAGES = C.folded("clean_pg", "(select page_id, type, value, seq as n from findings)", "page_id", "form_pages", ["page_text"])

SUMMARY = """first_seen as (select page_id, type, min(seq) as s, count(*) as n from findings group by 1, 2),
summary as (select p.page_id, coalesce(sum(n), 0) as findings,
  coalesce(sum(n) filter (where type <> 'credential'), 0) as pii_findings,
  coalesce(sum(n) filter (where type = 'credential'), 0) as credential_findings,
  coalesce(string_agg(type, ',' order by s), '') as types
  from form_pages p left join first_seen f using (page_id) group by 1)"""

# The same page steps over ingested payloads instead of forms.
_J = "try_cast(payload as json)"
INGEST = f"""{C.PAYLOADS},
form_pages as (select page_id,
  case when json_type(payload, '$.url') is null then '' when json_type(payload, '$.url') = 'NULL' then 'None'
    when json_type(payload, '$.url') = 'BOOLEAN' then upper(left(payload ->> '$.url', 1)) || substr(payload ->> '$.url', 2)
    else payload ->> '$.url' end as url,
  case when json_type(payload, '$.title') is null then '' else payload ->> '$.title' end as title,
  case when json_type(payload, '$.page_text') = 'VARCHAR' then payload ->> '$.page_text' else '' end as page_text
  from payloads),
raw_items as (select page_id, json_extract(payload, '$.elements[*]') as es from payloads
  where json_type(payload, '$.elements') = 'ARRAY'),
items as (select page_id, unnest(es) as e, unnest(range(len(es))) as raw_no from raw_items),
elements as (select page_id, row_number() over (partition by page_id order by raw_no) - 1 as ord,
  coalesce(e ->> '$.tag', '') as tag, coalesce(e ->> '$.text', '') as text, coalesce(e ->> '$.aria_label', '') as aria_label,
  coalesce(e ->> '$.placeholder', '') as placeholder, coalesce(e ->> '$.name', '') as name, coalesce(e ->> '$.id', '') as id,
  coalesce(e ->> '$.input_type', '') as input_type, coalesce(e ->> '$.value', '') as value,
  coalesce(cast(e ->> '$.enabled' as boolean), true) as enabled, cast(e ->> '$.box.width' as double) as box_width
  from items where json_type(e) = 'OBJECT')"""
_FINDINGS_TAIL = C.FINDINGS[C.FINDINGS.index("field_rows as"):]

_LEAKS = """vals as (select distinct page_id, value from (
    select page_id, value from findings where value is not null
    union all select e.page_id, e.value from findings f join elements e on f.page_id = e.page_id and f.elem_ord = e.ord
    where f.type = 'credential' and e.value <> '') v),
  leaks as (select page_id, value, unnest(list_filter([
    case when contains(c.page_text, value) then 'page_text' end, case when contains(p.url, value) then 'url' end,
    case when contains(p.title, value) then 'title' end], lambda x: x is not null)) as place
  from vals join {pg} c using (page_id) join form_pages p using (page_id)
  union all select distinct page_id, v.value, f.place from vals v join (
    select page_id, 'text' as place, text as hay from {el} union all select page_id, 'value', value from {el}
    union all select page_id, 'placeholder', placeholder from {el} union all select page_id, 'aria_label', aria_label from {el}
    union all select page_id, 'name', name from {el}) f using (page_id) where contains(f.hay, v.value))"""

_RED = C.redacted

SQL = {
    "pii_by_language": _DOC + """select lang, type, count(*) as findings,
      count(*) filter (where contains(c.text, p.value)) as left_over
      from doc_pii p join doc_clean c using (doc_id) group by 1, 2""",
    "detect_pii": C.rec(_DOC_PII) + """select doc_id, row_number() over (partition by doc_id order by start_, pattern_no) - 1 as seq,
      type, value, start_ as start, end_ as "end" from doc_pii""",
    **{f"detect_{n}": _detect(n) for n in ("email", "phone", "credit_card", "aadhaar", "pan")},
    "credential_elements": C.rec(C.ELEMENTS) + f"select page_id, ord as elem_ord from elements where {C.credential_test()}",
    "inspect_element": C.rec(C.FINDINGS) + """select page_id, elem_ord, is_pii, field_no, start_ as start, pattern_no,
      field, type, value from findings where is_text = 0""",
    "inspect_text": C.rec(C.FINDINGS) + "select page_id, start_ as start, type, value from findings where is_text = 1",
    "inspect_page": C.rec(C.FINDINGS) + "select page_id, seq, elem_ord, field, type, value from findings",
    "sanitize_elements": C.rec(C.FINDINGS, CLEAN_ELEMENTS) + "select * from clean_el",
    "sanitize_page_text": C.rec(C.FINDINGS, CLEAN_PAGES) + "select * from clean_pg",
    "sanitize_documents": _DOC + "select doc_id, text from doc_clean",
    "privacy_summary": C.rec(C.FINDINGS, SUMMARY) + "select * from summary",
    "replacement_lookup": C.rec(C.FINDINGS) + f"select type, {C.token('type')} as token, count(*) as n from findings group by 1, 2",
    "redact_display_text": f"select doc_id, {_RED('text')} as text from documents",
    "sanitize_nested": C.rec(C.PAGES) + f"""select page_id, {_RED('url')} as url, {_RED('page_text')} as part_text,
      length(page_text) as part_n, 'mail user@example.com' as attr_key,
      {_RED("string_split(page_text, chr(10))[2]")} as attr_value,
      array_to_string(list_transform(string_split(page_text, chr(10)), lambda x: {_RED('x')}), '|') as lines from form_pages""",
    "mask_password_values": C.rec(C.ELEMENTS) + """select page_id, ord,
      case when lower(input_type) = 'password' then '[REDACTED]' else value end as value from elements""",
    "sanitize_context": C.rec(INGEST, _FINDINGS_TAIL, CLEAN_ELEMENTS, CLEAN_PAGES, SUMMARY) + """
      select s.page_id, s.findings, pii_findings, credential_findings, types, url, title, c.page_text, e.elements
      from summary s join form_pages using (page_id) join clean_pg c using (page_id)
      left join (select page_id, string_agg(b.tag || ':' || x.text || ':' || x.name || ':' || x.value, '|' order by ord) as elements
        from clean_el x join elements b using (page_id, ord) group by 1) e using (page_id)""",
    "residual_leak_audit": C.rec(C.FINDINGS, CLEAN_ELEMENTS, CLEAN_PAGES, _LEAKS.format(el="clean_el", pg="clean_pg")) + """
      select v.page_id, v.n as raw_values, coalesce(l.n, 0) as leaks
      from (select page_id, count(*) as n from vals group by 1) v
      left join (select page_id, count(*) as n from leaks group by 1) l using (page_id)""",
    "leak_audit_unprotected": C.rec(
        C.FINDINGS,
        "masked as (select * replace (case when lower(input_type) = 'password' then '[REDACTED]' else value end as value) from elements)",
        _LEAKS.format(el="masked", pg="form_pages"),
    ) + "select * from leaks",
    "residual_leak_documents": _DOC + f"""select type, count(*) as n, count(*) filter (where contains(c.text, p.value)) as leaks,
      count(*) filter (where contains(c.text, {C.token('type')})) as with_token
      from doc_pii p join doc_clean c using (doc_id) group by 1""",
    "detector_scorecard": C.rec(
        C.CAPTURED,
        "cases as (select page_id, name as kind, value as text, case name when 'email' then '[EMAIL]' when 'phone' then '[PHONE]' "
        "when 'card' then '[CREDIT_CARD]' when 'aadhaar' then '[AADHAAR]' else '[PAN]' end as expected "
        "from captured where name in ('email', 'phone', 'card', 'aadhaar', 'pan'))",
        C.pii_cte("case_pii", "(select page_id, kind, text as txt from cases)", "page_id, kind"),
        C.folded("case_clean", "(select page_id, kind, type, value, row_number() over (partition by page_id, kind order by start_, pattern_no) as n from case_pii)",
                 "page_id, kind", "cases", ["text"]),
    ) + """select kind, count(*) filter (where ok) as passed, count(*) as total,
      round(100.0 * count(*) filter (where ok) / count(*), 2) as accuracy from (
      select kind, contains(c.text, expected) and not contains(c.text, s.text) as ok from cases s join case_clean c using (page_id, kind))
      group by 1""",
}
