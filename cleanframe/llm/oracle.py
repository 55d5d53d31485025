"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .merkle import PIECE
from .mixing import BLOCK_ROWS, QUANTA, TEMPER

MERKLE = rf"""
with ordered as (
  select doc_id, coalesce(text, '') as text, row_number() over (order by doc_id desc) as i, count(*) over () as n from documents),
near as (
  select a.doc_id, a.text, b.text as following, length(a.text) as n_chars, length(a.text) // 3 as third
  from ordered a join ordered b on b.i = a.i % a.n + 1),
texts as (select *, left(text, n_chars - third) || left(following, third) as edited from near),
sides as (
  select doc_id, 'a' as side, text as t from texts union all select doc_id, 'b', edited from texts union all select doc_id, 'c', following from texts),
paragraphs as (
  select doc_id, side, unnest(string_split(t, chr(10))) as p, generate_subscripts(string_split(t, chr(10)), 1) as k from sides),
cut as (select doc_id, side, k, p, list_transform(regexp_extract_all(p, '{PIECE}'), lambda x: {{'node': sha256(x), 'letters': length(x)}}) as l from paragraphs),
nodes as (select doc_id, side, k, p, sha256(coalesce(array_to_string(list_transform(l, lambda x: x.node), ''), '')) as node from cut where side <> 'c'),
leaves as (select doc_id, side, l.node as node, l.letters as letters, count(*) as n from (select doc_id, side, unnest(l) as l from cut) group by all),
totals as (select doc_id, side, sum(n * letters) as letters from leaves group by all),
shared as (
  select a.doc_id, b.side, sum(least(a.n, b.n) * a.letters) as letters
  from leaves a join leaves b on a.side = 'a' and b.side <> 'a' and a.doc_id = b.doc_id and a.node = b.node group by all),
placed as (
  select *, coalesce(sum((left(node, 1) in ('0', '1') or length(p) = 0)::int)
    over (partition by doc_id, side order by k rows between unbounded preceding and 1 preceding), 0) as section from nodes),
sections as (select doc_id, side, section, sha256(string_agg(node, '' order by k)) as node from placed group by all),
roots as (select doc_id, side, sha256(string_agg(node, '' order by section)) as root, count(*)::int as n_sections, list(distinct node) as own from sections group by all),
changes as (
  select a.doc_id, min(case when a.node is distinct from b.node then coalesce(a.k, b.k) - 1 end)::bigint as first_change
  from (select * from nodes where side = 'a') a full join (select * from nodes where side = 'b') b on a.doc_id = b.doc_id and a.k = b.k
  group by 1),
letters as (
  select t.doc_id, t.text, t.edited, t.following, t.n_chars, coalesce(ta.letters, 0) as la, coalesce(tb.letters, 0) as lb, coalesce(tc.letters, 0) as lc,
    coalesce(sb.letters, 0) as lab, coalesce(sc.letters, 0) as lac
  from texts t left join totals ta on ta.doc_id = t.doc_id and ta.side = 'a' left join totals tb on tb.doc_id = t.doc_id and tb.side = 'b'
  left join totals tc on tc.doc_id = t.doc_id and tc.side = 'c' left join shared sb on sb.doc_id = t.doc_id and sb.side = 'b'
  left join shared sc on sc.doc_id = t.doc_id and sc.side = 'c'),
changed as (
  select s.doc_id, count(*) filter (where not list_contains(r.own, s.node))::int as changed_sections
  from (select distinct doc_id, node from sections where side = 'b') s join (select * from roots where side = 'a') r on r.doc_id = s.doc_id group by 1)
select l.doc_id, n_chars::bigint as n_chars, sha256(edited) as edited_sha256, ra.root as fingerprint, rb.root as edited_fingerprint,
  case when la + lb > 0 then 2.0::double * lab / (la + lb) when text = edited then 1.0::double else 0.0::double end as near_edited,
  case when la + lc > 0 then 2.0::double * lac / (la + lc) when text = following then 1.0::double else 0.0::double end as near_next,
  ra.n_sections, changed_sections, first_change
from letters l join roots ra on ra.doc_id = l.doc_id and ra.side = 'a' join roots rb on rb.doc_id = l.doc_id and rb.side = 'b'
join changes on changes.doc_id = l.doc_id join changed on changed.doc_id = l.doc_id
"""

MIXING = f"""
with recursive sizes as (select coalesce(source, '') as source, count(*) as n from documents group by 1),
weights as (select source, pow(n::double, {TEMPER}::double) as w from sizes),
quanta as (select source, greatest(round(w / (sum(w) over ()) * {QUANTA}), 1)::int as q from weights),
cycle as (select list(source order by source) as s, list(q order by source) as q, sum(q)::int as len from quanta),
schedule as (
  select 0 as slot, list_transform(q, lambda x: 0) as done, null::bigint as k, null::int as turn from cycle
  union all
  select slot + 1, list_transform(done, lambda x, i: case when i - 1 = chosen.k then x + 1 else x end), chosen.k, done[chosen.k + 1]
  from (
    select slot, done, list_min(list_filter(list_transform(range(len(q)), lambda k: case when floor(done[k + 1] * len / q[k + 1]) <= slot
      then {{'due': ceil((done[k + 1] + 1) * len / q[k + 1]), 'minus': -q[k + 1], 'k': k}} end), lambda x: x is not null)) as chosen
    from schedule, cycle where slot < len)),
slots as (select s[k + 1] as source, turn, slot - 1 as slot, q[k + 1] as q, len from schedule, cycle where k is not null),
numbered as (
  select doc_id, source, coalesce(source, '') as mixed, row_number() over (partition by coalesce(source, '')
    order by md5(coalesce(doc_id::varchar, '')), doc_id nulls first, md5(coalesce(text, ''))) - 1 as place from documents)
select doc_id, numbered.source, place // {BLOCK_ROWS} as mix_block, (place // {BLOCK_ROWS}) // q * len + slot as mix_slot, (place % {BLOCK_ROWS})::int as mix_offset
from numbered join slots on slots.source = mixed and turn = (place // {BLOCK_ROWS}) % q
"""

_WORDS = "string_split_regex(trim(lower(coalesce(text, '')), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x09-\\x0D\\x20]+')"


#: Of 6 words or more, 80 % agree only where three words in a row do.
DECONTAMINATION = f"""
with docs as (select row_number() over () as row, doc_id, {_WORDS} as w from documents),
every as (select row_number() over () as item, item_id, {_WORDS} as w from benchmark),
items as (select * from every where len(w) >= 6),
threes_docs as (select row, p, w[p + 1:p + 3] as three from (select row, w, unnest(range(len(w) - 2)) as p from docs)),
threes_items as (select item, p, w[p + 1:p + 3] as three from (select item, w, unnest(range(len(w) - 2)) as p from items)),
met as (select distinct d.row, i.item, d.p - i.p as start from threes_docs d join threes_items i on d.three = i.three),
laid as (
  select met.row, items.item_id, len(items.w)::int as item_words, len(list_filter(range(len(items.w)), lambda k:
    start + k >= 0 and start + k < len(docs.w) and docs.w[start + k + 1] = items.w[k + 1]))::int as agree
  from met join docs on docs.row = met.row join items on items.item = met.item
  union all
  select docs.row, item_id, len(every.w)::int, len(every.w)::int from docs join every on docs.w = every.w where len(every.w) < 6 and every.w[1] <> ''),
best as (select row, item_id, max({{'agree': agree, 'item_words': item_words}}) as b from laid where 100 * agree >= 80 * item_words group by all),
found as (select row, count(*) as n_items, max(b) as b from best group by 1)
select doc_id, n_items is not null as contaminated, coalesce(n_items, 0) as n_items, b.agree as agree, b.item_words as item_words
from docs left join found on found.row = docs.row
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NGRAM_JOIN = f"""
with recursive split as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') as w from documents),
grams as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) as i from split)),
sizes as (select split.doc_id, count(g) as n from split left join grams on grams.doc_id = split.doc_id group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as common from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on l.a = r.b)
select s.doc_id, s.n as n_shingles, min(r.b) as component_id from sizes s join reach r on r.a = s.doc_id group by 1, 2
"""

HARD_NEGATIVES = """
with usable as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scores as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as own, list_inner_product(a.v, b.v)::bigint as score
  from usable a join usable b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scores where own
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id,
  (row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id))::int as rank,
  s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scores s on s.anchor_id = p.anchor_id and not s.own
  and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) <= 5
"""

#: For pages that hold one article without forms, notices and the like in it.
MAIN_TEXT = r"""
with articles as (select page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*?)(</article>|$)', 1, 's') as body from pages),
parts as (select page_id, url, string_split(regexp_replace(body, '</?(h[1-6]|p|div|ul|ol|li|section|blockquote)(>|\s[^>]*>)', chr(1), 'g'), chr(1)) as part from articles),
blocks as (select page_id, url, unnest(part) as block, generate_subscripts(part, 1) as k from parts),
plain as (
  select page_id, url, k, replace(replace(regexp_replace(regexp_replace(regexp_replace(block, '<br ?/?>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'),
    '&lt;', '<'), '&gt;', '>') as t from blocks),
decoded as (select page_id, url, k, trim(regexp_replace(regexp_replace(t, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) as t from plain),
texts as (select page_id, url, coalesce(string_agg(t, chr(10) order by k) filter (where t <> ''), '') as text from decoded group by page_id, url)
select page_id, url, text, length(text)::bigint as n_chars from texts
"""
