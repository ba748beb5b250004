"""DuckDB SQL for the operators that SQL can say."""

from string import ascii_lowercase, ascii_uppercase


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{pattern}')"


_ITEM_WORDS = _words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BLANK_WORDS = _words(r"[^\x20\x09-\x0D]+")

OP2 = f"""
with d as (select row_number() over () as r, doc_id, {_ITEM_WORDS} as ws from documents),
i as (select cast(item_id as varchar) as name, {_ITEM_WORDS} as ws from benchmark),
iw as (
  select distinct name, cast(10 as bigint) as k, array_to_string(ws[p:p+9], ' ') as gram
  from (select name, ws, unnest(range(1, len(ws) - 8)) as p from i where len(ws) >= 10)
  union select name, len(ws), array_to_string(ws, ' ') from i where len(ws) between 1 and 9),
dw as (
  select r, k, p, array_to_string(ws[p:p+k-1], ' ') as gram
  from (select r, ws, k, unnest(range(1, len(ws) - k + 2)) as p from d join (select distinct k from iw) s on len(ws) >= k)),
h as (select r, k, p, name from dw join iw using (k, gram)),
n as (select r, count(*) as n_hit from (select distinct r, unnest(range(p, p + k)) as q from h) group by r),
m as (select r, count(distinct name) as n_items, string_agg(distinct name, ',' order by name) as names from h group by r)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (r) left join m using (r)
"""

OP4 = f"""
with recursive d as (select doc_id, {_BLANK_WORDS} as ws from documents),
s as (
  select distinct doc_id, ws[p] || ' ' || ws[p+1] as gram
  from (select doc_id, ws, unnest(range(1, len(ws))) as p from d where len(ws) > 1)
  union all select doc_id, ws[1] from d where len(ws) = 1),
n as (select doc_id, count(*) as n from s group by doc_id),
pair as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
link as (
  select x, y from pair join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 80 * (a.n + b.n - shared)),
way as (select x, y from link union all select y, x from link),
reach as (select doc_id as a, doc_id as b from d union select a, y from reach join way on b = x),
least as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from d left join n using (doc_id) join least using (doc_id)
"""

_CRC_TABLE = "list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"

OP11 = f"""
with recursive crc as materialized (select {_CRC_TABLE} as t),
d as (
  select row_number() over () as r, doc_id, lang, text, n_chars,
    case when doc_id is null then '-' else strlen(doc_id::varchar) || ':' || doc_id end
      || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as tail,
    coalesce(xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i::int, 1))::bigint)),
      lambda c, b: xor(c >> 8, t[xor(c % 256, b) + 1]))) % 7 = 0, false) as tampered
  from documents, crc),
leaf as (
  select r, doc_id, lang, tampered, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as h,
    sha256(head || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || tail) as h2 from d),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, h) - 1 as pos, count(*) over (partition by lang) as n from leaf),
tree as (
  select lang, 0 as level, pos, h, n from placed
  union all
  select lang, level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (max(n) + 1) // 2 from tree where n > 1 group by lang, level, pos // 2),
sub as (select lang, level, h, row_number() over (order by lang nulls first) - 1 as g, count(*) over () as gs from tree where n = 1),
top as (
  select 0 as level, g as pos, h, gs as n from sub
  union all
  select level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (max(n) + 1) // 2 from top where n > 1 group by level, pos // 2),
height as (select max(level) as levels, max_by(h, level) as root from top),
way as (
  select p.r, t.level, (p.pos >> t.level) % 2 as side, s.h
  from placed p join tree t on t.lang is not distinct from p.lang and t.pos = p.pos >> t.level and t.n > 1
    left join tree s on s.lang is not distinct from p.lang and s.level = t.level and s.pos = xor(t.pos, 1)
  union all
  select p.r, 1000 + t.level, (u.g >> t.level) % 2, s.h
  from placed p join sub u on u.lang is not distinct from p.lang join top t on t.pos = u.g >> t.level and t.n > 1
    left join top s on s.level = t.level and s.pos = xor(t.pos, 1)),
list as (
  select r, list(struct_pack(side, h := coalesce(h, '')) order by level) as steps, string_agg(h, '' order by level) as proof from way group by r),
folded as (
  select r, 0 as k, case when tampered then h2 else h end as h, coalesce(steps, []) as steps, proof from placed left join list using (r)
  union all
  select r, k + 1, sha256(case when steps[k + 1].side = 1 then steps[k + 1].h || h else h || steps[k + 1].h end), steps, proof from folded where k < len(steps))
select doc_id, p.h as leaf, u.h as subroot, root, sha256(coalesce(proof, '')) as proof_sha256, f.h as folded_root, f.h = root as verified
from placed p join folded f on f.r = p.r and f.k = len(f.steps) join sub u on u.lang is not distinct from p.lang, height
"""

_TERMS = _words(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

OP13 = f"""
with d as (select row_number() over () as r, doc_id, {_TERMS} as ws from documents),
whole as (select count(*)::hugeint as n, sum(len(ws))::hugeint as l from d where len(ws) > 0),
m as (select r, doc_id, ws, 75 + (25 * len(ws) * n) // l as m from d, whole where len(ws) > 0),
tf as (select r, term, count(*) as tf from (select r, unnest(ws) as term from m) group by r, term),
w as (select term, floor(1000 * ln((2 * n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, whole group by term, n),
q as (select distinct item_id, text from benchmark),
i as (select item_id, text, unnest({_TERMS}) as term from q),
s as (
  select i.item_id, i.text, r, m.doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from i join w using (term) join tf using (term) join m using (r) group by all),
p as (select *, row_number() over (partition by item_id, text order by score desc, doc_id nulls last) as place from s where score > 0)
select item_id, place::int as rank, doc_id, score from p where place <= 20
"""

ORACLES = {"op2_suffix_automaton": OP2, "op4_super_minhash": OP4, "op11_bitmap_rank_manifest": OP11, "op13_length_strata_search": OP13}
