"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

FILTER_AUDIT = r"""
with texts as (select doc_id, coalesce(source, '') part, coalesce(text, '') t from documents),
words as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w, min(doc_id) over (partition by t) first_id from texts),
flags as (select doc_id, bool_or(coalesce(quality = 1, false)) good, bool_or(coalesce(toxic = 1, false)) toxic from labels group by doc_id),
failed as (
  select part, coalesce(good, false) good, coalesce(toxic, false) toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first_id, false)] f
  from words left join flags using (doc_id)),
kinds as (select part, f, count(*) n, count(*) filter (good) g, count(*) filter (toxic) x from failed group by part, f),
letter as (select unnest([1, 2, 3, 4, 5]) i, unnest(['A', 'B', 'C', 'D', 'E']) l),
orders as (
  select a.l || b.l || c.l || d.l || e.l filter_order, [a.i, b.i, c.i, d.i, e.i] o
  from letter a, letter b, letter c, letter d, letter e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps as (select filter_order, o, unnest([1, 2, 3, 4, 5]) step from orders),
removal as (
  select part, n, g, x, f, filter_order, o,
    case when f[o[1]] then 1 when f[o[2]] then 2 when f[o[3]] then 3 when f[o[4]] then 4 when f[o[5]] then 5 else 6 end r
  from kinds, orders),
rows as (
  select part, filter_order, cast(step as integer) step, o[step] l, sum(case when r > step then n else 0 end) kept,
    sum(case when r = step then n else 0 end) removed, sum(case when f[o[step]] and r < step then n else 0 end) redundant,
    sum(case when f[o[step]] and len(list_filter(f, lambda y: y)) = 1 then n else 0 end) unique_fails,
    sum(case when r = step then g else 0 end) good_lost, sum(case when r = step then x else 0 end) toxic_lost
  from removal join steps using (filter_order, o) group by all)
select part, filter_order, step, cast(kept as bigint) kept, cast(removed as bigint) removed, cast(redundant as bigint) redundant,
  cast(unique_fails as bigint) unique_fails, cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost,
  cast(sum(removed) over (partition by part, l) as bigint) shapley
from rows
"""

PREFIX_TRIE = r"""
with turns as (
  select conv_id c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) d,
    coalesce(role, '') role, coalesce(text, '') text from conversations where conv_id is not null),
bits as (  -- CRC-32 of the decimal id, byte by byte and bit by bit
  select distinct conv_id c, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
    lambda s, x: list_reduce(list_prepend(xor(s, x), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))) v
  from conversations where conv_id is not null),
crc as (select c, xor(v, 4294967295) % 4 h from bits),
convs as (select c, max(d) n from turns group by c),
own as (select x.c, x.n, x.c - x.c % 20 base, crc.h, least(crc.h, coalesce(y.n, 0)) k from convs x join crc using (c) left join convs y on y.c = x.c - x.c % 20),
rebuilt as (
  select c, d - h + k d, role, text from turns join own using (c) where d > h
  union all select own.c, d, role, text from own join turns on turns.c = own.base where d <= k),
named as (
  select c, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) words,
    sha256(string_agg(sha256(len(role) || ':' || role || text), ',') over (partition by c order by d)) p from rebuilt
  union all select c, 0, 0, '' from own),
nodes as (select p, d depth, min(c) conv_id, count(*) n_convs, max(words) words from named group by p, d),
owner as (select c, d, conv_id from named join nodes using (p)),
linked as (select nodes.*, owner.conv_id parent_conv_id from nodes left join owner on owner.c = nodes.conv_id and owner.d = nodes.depth - 1),
children as (select parent_conv_id conv_id, depth - 1 depth, count(*) n_children from linked where depth > 0 group by all),
own_totals as (select linked.*, coalesce(n_children, 0) n_children, (n_convs - 1) * words saved from linked left join children using (conv_id, depth)),
totals as (
  select owner.conv_id, owner.d depth, count(*) filter (n_children = 0) n_leaves, sum(saved) saved_tokens
  from own_totals t join owner on owner.c = t.conv_id and owner.d <= t.depth group by all),
ends as (
  select owner.conv_id, size depth, sha256(string_agg(cast(s.c as varchar), ',' order by s.c)) ends_sha256
  from (select c, max(d) size from named group by c) s join owner on owner.c = s.c and owner.d = size group by all)
select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, cast(saved_tokens as bigint) saved_tokens, coalesce(ends_sha256, sha256('')) ends_sha256
from own_totals join totals using (conv_id, depth) left join ends using (conv_id, depth)
"""
