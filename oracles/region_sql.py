"""SQL of the region queries."""

from __future__ import annotations

from oracles import common as C

_KEYS = "image_id, block_num, par_num, line_num"
LINES = f"""{C.OCR},
keyed as (select image_id, coalesce(block_num, 0) as block_num, coalesce(par_num, 0) as par_num,
  coalesce(line_num, 0) as line_num, line_num as scan_line, word_no as scan_word, text, x, y, w, h from ocr_tokens),
placed as (select *, row_number() over lw - 1 as word_no,
  coalesce(sum(length(text) + 1) over (partition by {_KEYS} order by x, scan_line, scan_word
    rows between unbounded preceding and 1 preceding), 0)::bigint as start_
  from keyed window lw as (partition by {_KEYS} order by x, scan_line, scan_word)),
lines as (select {_KEYS}, min(scan_line) as first_line, min(scan_word) as first_word, count(*) as n_words,
  string_agg(text, ' ' order by word_no) as txt from placed group by {_KEYS})"""
HITS = f"""{LINES}, {C.pii_cte('line_pii', 'lines', _KEYS)},
found as (select *, row_number() over (partition by {_KEYS} order by start_, pattern_no) - 1 as finding_no from line_pii),
hits as (select f.*, p.word_no, p.text, p.start_ as w_start, p.start_ + length(p.text) as w_end, x, y, w, h
  from found f join placed p using ({_KEYS}) where f.end_ > p.start_ and f.start_ < p.start_ + length(p.text)),
regions as (select {_KEYS}, finding_no, type, any_value(value) as value, min(x) as x, min(y) as y, max(x + w) - min(x) as width,
  max(y + h) - min(y) as height from hits group by {_KEYS}, finding_no, type)"""
_BOXES = """boxes as (select e.page_id, e.ord, box_x, box_y, box_w, box_h from elements e
  where exists (select 1 from findings f where f.page_id = e.page_id and f.elem_ord = e.ord and f.is_text = 0))"""

SQL = {
    "ocr_lines": C.rec(LINES) + f"select {_KEYS}, n_words, txt as line_text from lines",
    "ocr_word_offsets": C.rec(LINES) + f"""select {_KEYS}, word_no, text, start_ as start, start_ + length(text) as "end" from placed""",
    "ocr_span_words": C.rec(HITS) + f"""select {_KEYS}, finding_no, type, text, w_start as start, w_end as "end" from hits""",
    "ocr_sensitive_regions": C.rec(HITS) + f"select {_KEYS}, finding_no, type, value, x, y, width, height from regions",
    "sensitive_element_boxes": C.rec(C.FINDINGS, _BOXES)
    + "select page_id, ord, box_x as x, box_y as y, box_w as width, box_h as height from boxes",
    "pad_clamp_boxes": C.rec(C.CAPTURED) + """select page_id, ord, greatest(0, box_x::int - 4) as x1, greatest(0, box_y::int - 4) as y1,
      least(page_id % 300, box_x::int + box_w::int + 4) as x2, least(250, box_y::int + box_h::int + 4) as y2
      from captured where box_w > 0 and box_h > 0""",
    "redaction_plan": C.rec(HITS, C.FINDINGS, _BOXES) + f""",
      rects as (select page_id as image_id, 0 as source_no, ord as a, 0 as b, 0 as c, box_x as x, box_y as y, box_w as width, box_h as height
        from boxes
        union all select image_id, 1, first_line, first_word, finding_no, x, y, width, height
        from regions join (select {_KEYS}, first_line, first_word from lines) l using ({_KEYS}))
      select image_id, row_number() over (partition by image_id order by source_no, a, b, c) as seq, source_no,
        greatest(0, x::int - 4) as x1, greatest(0, y::int - 4) as y1, least(case when sized then 500 end, x::int + width::int + 4) as x2,
        least(case when sized then 1200 end, y::int + height::int + 4) as y2
      from (select r.*, d.doc_id is not null as sized from rects r left join documents d on d.doc_id = r.image_id) where width > 0 and height > 0""",
}
