"""The same results in SQL, found by plain comparison; for DuckDB."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

HYPERMINHASH = f"""
with recursive words as (
  select doc_id, list_filter(string_split_regex({_LOW}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as ws from documents
), shingles as (
  select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as shingle
  from words, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as u(i) where len(ws) > 0
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as n
  from shingles a join shingles b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id
), links as (
  select s.a, s.b from shared s join sizes x on x.doc_id = s.a join sizes y on y.doc_id = s.b
  where 100 * s.n >= 85 * (x.n + y.n - s.n)
), reached as (
  select a, b from links union select r.a, l.b from reached r join links l on l.a = r.b
), least as (
  select a, min(b) as b from reached group by a
)
select d.doc_id, coalesce(s.n, 0) as n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) as component_id,
       least(d.doc_id, coalesce(l.b, d.doc_id)) = d.doc_id as kept
from documents d left join sizes s on s.doc_id = d.doc_id left join least l on l.a = d.doc_id
"""

_ROUND = """, assigned{r} as (
  select vec_id, p, x, min(d * 256 + e) % 256 as e, min(d * 256 + e) // 256 as d from (
    select v.vec_id, v.p, v.x, b.e, cast(list_sum(list_transform(list_zip(v.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) as bigint) as d
    from parts v join book{r} b on b.p = v.p
  ) group by vec_id, p, x
)"""
_MEANS = """, book{n} as (
  select b.p, b.e, coalesce(m.x, b.x) as x from book{r} b left join (
    select p, e, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as x from (
      select p, e, i, cast(sum(x[i]) as bigint) as s, count(*) as n from assigned{r}, unnest(range(1, len(x) + 1)) as u(i) group by p, e, i
    ) group by p, e
  ) m on m.p = b.p and m.e = b.e
)"""
METRIC_TREES = """
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as (
  select vec_id, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] as x from kept, unnest(range(4)) as u(p)
), book0 as (
  select p, row_number() over (partition by p order by vec_id) - 1 as e, x from parts qualify e < 256
)""" + "".join(_ROUND.format(r=r) + _MEANS.format(r=r, n=r + 1) for r in range(4)) + _ROUND.format(r=4) + """, digest as (
  select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as codebooks_sha256 from book4
), coded as (
  select vec_id, string_agg(lower(printf('%02x', e)), '' order by p) as code, cast(sum(d) as bigint) as error from assigned4 group by vec_id
)
select k.vec_id, k.label, c.code, c.error, cast(sum(c.error) over (partition by k.label) as bigint) as label_error, codebooks_sha256
from kept k join coded c on c.vec_id = k.vec_id, digest
"""

COLLOCATIONS = f"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex({_LOW}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents
), words as (
  select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') as ws from pieces
), counts as (
  select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase, count(*) as f
  from words, unnest(range(1, 4)) as t(k), unnest(range(1, len(ws) - k + 2)) as u(i) group by all
), totals as (
  select lang, cast(sum(f) as bigint) as n from counts where k = 1 group by lang
), candidates as (
  select lang, k, phrase, string_split(phrase, ' ') as ws, f as a from counts where k > 1 and f >= 10
), cuts as (
  select c.lang, c.k, c.phrase, c.a, j, x.f as l, y.f as r,
         cast((1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f) as bigint) as score
  from (select *, unnest(range(1, k)) as j from candidates) c
  join counts x on x.lang = c.lang and x.phrase = array_to_string(ws[1:j], ' ')
  join counts y on y.lang = c.lang and y.phrase = array_to_string(ws[j + 1:], ' ')
), worst as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1
), cover as (
  select lang, phrase, max(a) as a from (
    select lang, array_to_string(ws[1:2], ' ') as phrase, a from candidates where k = 3
    union all select lang, array_to_string(ws[2:3], ' '), a from candidates where k = 3
  ) group by lang, phrase
)
select w.lang, row_number() over (partition by w.lang order by score desc, w.a desc, w.phrase) as rank, w.phrase, w.a, l, r, n, score
from worst w join totals t on t.lang = w.lang left join cover c on c.lang = w.lang and c.phrase = w.phrase
where c.a is null or 100 * c.a < 50 * w.a qualify rank <= 2000
"""

SQL: dict[str, str] = {
    "op11_hyperminhash": HYPERMINHASH,
    "op12_metric_tree_codes": METRIC_TREES,
    "op13_stripe_collocations": COLLOCATIONS,
}
