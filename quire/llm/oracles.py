"""DuckDB SQL for the operators' queries, written without regard to how the operators work."""

from __future__ import annotations

import math
import re

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_ALNUM = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANK = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"

JACCARD = f"""
with recursive d as (select doc_id, {_BLANK} w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) g from d),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
r as (select doc_id at_, doc_id m from d union select l.y, r.m from r join l on l.x = r.at_)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(m) from r where r.at_ = d.doc_id) as component_id from d left join n on n.doc_id = d.doc_id"""

CHAT = r"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, length(regexp_replace(r, '([<\[])(\\*(?:/?s>|/?INST\]))', '\1\\\2', 'g')) + length(regexp_replace(t, '([<\[])(\\*(?:/?s>|/?INST\]))', '\1\\\2', 'g')) + 20 n from c)
select conv_id, count(*) as n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) as turns_sha256,
  length(coalesce(string_agg(t, '' order by turn, r, t) filter (r = 'assistant'), '')) as loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (r = 'assistant'), '')) as loss_sha256, sum(n)::bigint as formatted_chars
from e group by conv_id"""

TOPK = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) e, row_number() over () k from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and vec_id is not null),
s as (select q.vec_id query_id, q.k, v.vec_id, list_dot_product(q.e, v.e)::bigint score from v q join v on q.k <> v.k and len(q.e) = len(v.e) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id, k order by score desc, vec_id) rn from s)
select query_id, rn::integer as rank, vec_id, score from r where rn <= 5"""

DECONTAMINATION = f"""
with d as (select doc_id, {_ALNUM} w from documents),
b as (select item_id::varchar i, {_ALNUM} w from benchmark where item_id is not null),
x as (select distinct i, least(10, len(w)) n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda a: array_to_string(w[a:a + least(10, len(w)) - 1], ' '))) t from b where len(w) > 0),
p as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) a from d, (select distinct n from x) where len(w) >= n),
h as (select distinct doc_id, a, p.n, i from p join x on x.n = p.n and x.t = array_to_string(p.w[a:a + p.n - 1], ' ')),
k as (select doc_id, count(distinct z) n_hit from (select doc_id, unnest(range(a, a + n)) z from h) group by 1),
y as (select doc_id, count(*) n_items, string_agg(i, ',' order by i) s from (select distinct doc_id, i from h) group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join k on k.doc_id = d.doc_id left join y on y.doc_id = d.doc_id"""


def licenses(templates: list[tuple[str, str]], phrases: dict[str, str], threshold: float) -> str:
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(str.maketrans(_UPPER, _LOWER)))
    row = lambda label, w: f"('{label}', {len(w)}, {math.ceil(threshold * len(set(w)) - 1e-9)}, {sorted(set(w))})"
    known = ", ".join(row(label, words(t)) for label, t in templates)
    named = ", ".join(f"('{label}', {len(p.split())}, '{p}')" for p, label in phrases.items())
    return f"""
with d as (select doc_id, {_ALNUM} w from documents),
t(label, n, need, tokens) as (values {known}),
f(label, n, phrase) as (values {named}),
p as (select doc_id, f.label, a - 1 a from (select doc_id, w, unnest(range(1, len(w) + 1)) a from d), f where w[a] = string_split(phrase, ' ')[1] and array_to_string(w[a:a + n - 1], ' ') = phrase),
k as (select doc_id, t.label, len(list_distinct(list_intersect(w[a:a + 2 * n - 1], tokens))) / len(tokens) c, need / len(tokens) least_
      from (select doc_id, w, label, n, need, tokens, unnest(range(1, len(w) + 1, n)) a from d, t) t),
m as (select doc_id, label, c from k where c >= least_),
o as (select doc_id, count(*) n_base, min(a) first_word, max(a) last_word from p group by 1),
u as (select doc_id, string_agg(distinct label, ',' order by label) s from p group by 1),
v as (select doc_id, string_agg(distinct label, ',' order by label) s from (select doc_id, label from p union select doc_id, label from m) group by 1),
z as (select doc_id, max(c) c from m group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(u.s, '') as base_labels, coalesce(v.s, '') as labels,
  case when n_base > 0 then 1.0::double else coalesce(z.c, 0)::double end as score
from d left join o on o.doc_id = d.doc_id left join u on u.doc_id = d.doc_id left join v on v.doc_id = d.doc_id left join z on z.doc_id = d.doc_id"""
