"""SQL building blocks of the check side (DuckDB).

PII matches are found here by a different method than in the jobs: the regular
expressions of this engine know no look-behind, so every character that is not
of the guarded kind is wrapped in a guard character, and a pattern must sit
between two guards. Matches are then marked and the text split at the marks.
"""

from __future__ import annotations

from pagewarden.functions import fixed
from pagewarden.sources import derived as D

G, L, R = "\ue000", "\ue001", "\ue002"

_BODY = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": rf"(?:{G}\+{G}91(?:{G}[\s-]{G})?)?[6-9][0-9]{{9}}",
    "credit_card": rf"(?:[0-9](?:{G}[ -]{G})?){{13,19}}",
    "aadhaar": rf"[0-9]{{4}}{G}[\s-]{G}[0-9]{{4}}{G}[\s-]{G}[0-9]{{4}}",
    "pan": r"[A-Za-z]{5}[0-9]{4}[A-Za-z]",
}


def replaced(type_: str, text: str, before: str, after: str, keep: bool = True) -> str:
    """Text with each match of a type rewritten."""
    body = "\\1" if keep else ""
    if type_ == "email":
        return (
            f"regexp_replace({text}, '(\\b{_BODY['email']}\\b)', '{before}{body}{after}', 'g')"
        )
    outside = "[^A-Za-z0-9]" if type_ == "pan" else "[^0-9]"
    guarded = f"'{G}' || regexp_replace({text}, '({outside})', '{G}\\1{G}', 'g') || '{G}'"
    return (
        f"replace(regexp_replace({guarded}, '{G}({_BODY[type_]}){G}', "
        f"'{G}{before}{body}{after}{G}', 'g'), '{G}', '')"
    )


def pii_cte(name: str, source: str, keys: str, text: str = "txt") -> str:
    """CTEs ending in ``name``(keys, pattern_no, type, value, start_, end_)."""
    marked = " union all ".join(
        f"select {keys}, {n} as pattern_no, '{t}' as type, "
        f"{replaced(t, text, L, R)} as marked from {source}"
        for n, (t, _) in enumerate(fixed.PII_PATTERNS)
    )
    return f"""
{name}_m as ({marked}),
{name}_p as (select {keys}, pattern_no, type, string_split(replace(marked, '{R}', '{L}'), '{L}') as parts
  from {name}_m where contains(marked, '{L}')),
{name}_i as (select {keys}, pattern_no, type, parts, unnest(range(1, len(parts) // 2 + 1)) as i from {name}_p),
{name} as materialized (select {keys}, pattern_no, type, parts[2 * i] as value,
  list_sum(list_transform(parts[1:2 * i - 1], lambda x: length(x)))::bigint as start_,
  list_sum(list_transform(parts[1:2 * i], lambda x: length(x)))::bigint as end_ from {name}_i)"""


def redacted(text: str) -> str:
    result = text
    for type_, _ in fixed.PII_PATTERNS:
        result = replaced(type_, result, fixed.TOKENS[type_], "", keep=False)
    return result


def token(type_: str) -> str:
    cases = " ".join(f"when '{t}' then '{v}'" for t, v in fixed.TOKENS.items())
    return f"(case {type_} {cases} end)"


_FORM_ROWS = " union all ".join(
    f"select c_custkey as page_id, {n} as ord, '{f[0]}' as type, '{f[1]}' as tag, "
    f"'{f[2]}' as input_type, '{f[3]}' as name, '{f[4]}' as id, '{f[5]}' as placeholder, "
    f"'{f[6]}' as aria_label, {f[7]} as text, {f[8]} as value from customer"
    for n, f in enumerate(D.FORM_FIELDS)
)
CAPTURED = f"""captured as (select *, '' as role, {D.FORM_LABEL} as label, (page_id + ord) % 17 <> 0 as visible,
  (page_id + ord) % 11 <> 0 as enabled, 10.0::double as box_x, (30 * ord)::double as box_y,
  (case when (page_id + ord) % 13 = 0 then 0 else 200 end)::double as box_w, 24.0::double as box_h
  from ({_FORM_ROWS}))"""
ELEMENTS = CAPTURED + """,
elements as (select * from captured where visible and box_w > 0 and box_h > 0)"""
PAGES = f"""form_pages as (select c_custkey as page_id, {D.PAGE_URL} as url, {D.PAGE_TITLE} as title,
  {D.PAGE_TEXT} as page_text from customer)"""
HTML = f"form_html as (select c_custkey as page_id, {D.FORM_HTML} as html from customer)"
PAYLOADS = f"payloads as (select c_custkey as page_id, {D.PAYLOAD} as payload from customer)"
ACTIONS = f"""actions as (select event_id, user_id as task_id, user_id as page_id, ts, event_type,
  {D.ACTION_KIND} as action, {D.ACTION_TARGET} as target, {D.ACTION_VALUE} as value,
  row_number() over (partition by user_id order by ts, event_id) as step from events)"""
TASKS = f"""tasks as (select event_id, user_id as page_id, {D.TASK_TEXT} as task from events)"""
MODELS = f"""model_texts as (select event_id, user_id as page_id, {D.TASK_TEXT} as task,
  {D.MODEL_TEXT} as model_text from events)"""
OPTIONS = "options as (" + " union all ".join(
    f"select c_custkey as page_id, {n} as opt_no, {t} as opt_text, {v} as opt_value from customer"
    for n, (t, v) in enumerate(D.OPTION_ROWS)
) + ")"
OCR_RAW = """ocr_l as (select doc_id as image_id, string_split(text, chr(10)) as ls from documents),
ocr_ln as (select image_id, unnest(ls) as line, unnest(range(len(ls))) as line_num from ocr_l),
ocr_w as (select image_id, line_num, string_split(line, ' ') as ws from ocr_ln),
ocr_raw as (select image_id, line_num, unnest(range(len(ws))) as word_no, unnest(ws) as text from ocr_w),
ocr_words as (select image_id, line_num, word_no, text,
  case when (37 * word_no + line_num) % 23 = 0 then 'n/a'
    else cast((37 * word_no + line_num) % 110 - 10 as varchar) end as conf,
  line_num // 40 as block_num,
  case when line_num % 9 = 0 then null else line_num // 5 end as par_num,
  10 * word_no as x, 20 * line_num as y, 10 * length(text) as w, 18 as h from ocr_raw)"""
OCR = OCR_RAW + """,
ocr_tokens as (select image_id, line_num, word_no, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as text,
  coalesce(try_cast(conf as double), -1) as conf, block_num, par_num, x, y, w, h
  from ocr_words where regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''
  and coalesce(try_cast(conf as double), -1) >= 0)"""


def field_rows(source: str = "elements", keys: str = "page_id, ord") -> str:
    """Rows (keys, field_no, field, txt) of the inspected fields."""
    parts = " union all ".join(
        f"select {keys}, {n} as field_no, '{f}' as field, {f} as txt from {source}"
        for n, f in enumerate(fixed.INSPECTED_FIELDS)
    )
    return f"field_rows as (select * from ({parts}) where txt <> '')"


def credential_test() -> str:
    words = "|".join(fixed.CREDENTIAL_WORDS)
    labels = " or ".join(
        f"regexp_matches(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), '{words}')"
        for c in ("name", "id", "placeholder", "aria_label")
    )
    return f"(lower(trim(input_type)) = 'password' or {labels})"


# Findings of all form pages with their order and a dense number per page.
FINDINGS = f"""{ELEMENTS}, {PAGES}, {field_rows()},
{pii_cte('el_pii', 'field_rows', 'page_id, ord, field_no, field')},
{pii_cte('tx_pii', '(select page_id, page_text as txt from form_pages)', 'page_id')},
unnumbered as (
  select page_id, 0 as is_text, ord as elem_ord, 0 as is_pii, -1 as field_no, 0 as start_, 0 as pattern_no,
    null as field, 'credential' as type, null as value from elements where {credential_test()}
  union all select page_id, 0, ord, 1, field_no, start_, pattern_no, field, type, value from el_pii
  union all select page_id, 1, null, 1, -1, start_, pattern_no, 'page_text', type, value from tx_pii),
findings as materialized (select *, row_number() over (partition by page_id
  order by is_text, elem_ord, is_pii, field_no, start_, pattern_no) as seq from unnumbered)"""


def folded(target: str, findings: str, keys: str, base: str, columns: list[str]) -> str:
    """Recursive CTE ``target``: replace values in ``columns`` of ``base`` in order n.

    ``findings``(keys, n, type, value) must be numbered 1.. per key; a finding
    without a value rewrites a filled ``value`` column.
    """
    key_list = [k.strip() for k in keys.split(",")]
    on = " and ".join(f"f.{k} = r.{k}" for k in key_list)
    sets = ", ".join(
        (
            f"case when f.value is not null then replace(r.{c}, f.value, {token('f.type')}) "
            + (f"when r.{c} <> '' then {token('f.type')} " if c == "value" else "")
            + f"else r.{c} end as {c}"
        )
        for c in columns
    )
    rkeys = ", ".join(f"r.{k}" for k in key_list)
    cols = ", ".join(columns)
    return f"""{target}_r as (
  select {keys}, 0::bigint as n, {cols} from {base}
  union all select {rkeys}, f.n, {sets} from {target}_r r join {findings} f on {on} and f.n = r.n + 1),
{target} as (select {keys}, {", ".join(f"arg_max({c}, n) as {c}" for c in columns)} from {target}_r group by {keys})"""


def rec(*ctes: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n"
