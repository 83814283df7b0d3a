"""DuckDB SQL of the queries that SQL can express on whole tables.

The others have none: byte-level tokenization (op1, op4), XXH64 fingerprints
(op2), Luhn sums and pattern bootstrapping (op3), counts over all byte strings
(op6) and trees (op9) are tested against brute force in tests/llm.
"""

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

OP7 = rf"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
f as (
  select rid, doc_id, t, regexp_extract_all(t, '{WORD}') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines from d),
win as (
  select rid, unnest(range(1, len(w) - 1)) as i,
    unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g
  from f where len(w) > 2),
often as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from win) where n > 1),
inside as (
  select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from often) group by rid),
c as (
  select doc_id, cast(len(w) as bigint) as n_words,
    cast(length(regexp_replace(t, '{SPACE}+', '', 'g')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(n, 0) as bigint) as n_repeat_words, len(lines) as n_lines,
    len(list_filter(w, lambda x: not regexp_matches(x, '\p{{L}}'))) as n_wordless
  from f left join inside using (rid)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (5 * n_symbols > n_words or 2 * n_dup_lines > n_lines
    or word_chars > 25 * n_words or 2 * n_wordless > n_words) as kept
from b"""

OP8 = rf"""
with d as (
  select row_number() over () as rid, doc_id, source, coalesce(text, '') as t,
    case when doc_id is null then md5(coalesce(text, '')) else '' end as salt from documents),
z as (
  select rid, doc_id, salt, source, cast(len(regexp_extract_all(t, '{WORD}')) as bigint) as size,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as symbols from d),
y as (
  select *, cast(1 as double) / (cast(1 as double) + cast(4 as double) * symbols / greatest(size, 1)) as weight from z),
s0 as (select source, cast(sum(size) as bigint) as source_size from z group by source),
s as (
  select *, cast([1, 2, 3][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as integer)]
    as double) as w, 3 * source_size as cap from s0),
o as (
  select *, sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, source
      rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(w) over (order by cap / w, source rows between current row and unbounded following) as open_w from s),
level as (select rest, open_w from o where w * cast(rest as double) / open_w <= cap
          order by cap / w, source limit 1),
t as (
  select source, source_size, least(cast(cap as double), w * cast(rest as double) / open_w) as target
  from s, (select rest, open_w from level)),
p as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from t),
u as (
  select doc_id, salt, source, size, count(*) as n,
    -ln((cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null' || salt)), 1, 13) as bigint)
      + cast(0.5 as double)) / cast(4503599627370496 as double)) / min(weight) as k
  from y group by doc_id, salt, source, size),
r as (
  select u.doc_id, u.salt, u.source, u.size, p.source_size, p.target, p.epochs,
    case when 2 * sum(u.size * u.n) over (partition by u.source order by k, u.doc_id nulls first, u.salt, u.size) - u.size * u.n
      <= 2 * (p.target - p.epochs * p.source_size) then 1 else 0 end as extra
  from u join p on u.source is not distinct from p.source)
select y.doc_id, y.size, r.source_size, r.target, cast(y.size * (r.epochs + r.extra) as bigint) as taken
from y join r on y.doc_id is not distinct from r.doc_id and y.salt = r.salt and y.source is not distinct from r.source
  and y.size = r.size"""

OP10 = """
with recursive v as (
  select row_number() over () as rid, vec_id, label, cast(embedding as double[]) as x from embeddings),
usable as (
  select rid, vec_id, label, list_transform(x, lambda y: y / list_max(list_transform(x, lambda z: abs(z)))) as x
  from v where label is not null and len(x) > 0
    and len(list_filter(x, lambda y: y is null or not isfinite(y))) = 0 and len(list_filter(x, lambda y: y <> 0)) > 0),
link as (
  select a.rid as a, b.rid as b from usable a join usable b
    on a.label = b.label and a.rid <> b.rid and len(a.x) = len(b.x)
  where list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98),
reach as (
  select rid, rid as other from v
  union select reach.rid, link.b from reach join link on reach.other = link.a),
least as (select reach.rid, min(v.vec_id) as component_id from reach join v on v.rid = reach.other group by reach.rid),
n as (select a as rid, count(*) as n from link group by a)
select v.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, least.component_id,
  coalesce(v.vec_id = least.component_id, false) as kept
from v join least using (rid) left join n using (rid)"""

#: Merkle trees level by level; a crc32 table made by its rule (polynomial EDB88320).
OP13 = r"""
with recursive bits as (
  select i, 0 as k, i as c from range(256) r(i)
  union all
  select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
crc as (select list(c order by i) as tab from bits where k = 8),
d as (
  select row_number() over () as rid, doc_id, lang, source, n_chars, text,
    doc_id is not null and xor(4294967295, list_reduce(list_transform(range(1, length(cast(doc_id as varchar)) + 1),
      lambda i: cast(ascii(substr(cast(doc_id as varchar), cast(i as integer), 1)) as bigint)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), cast(4294967295 as bigint))) % 3 = 0 as hit
  from documents, crc),
v as (
  select rid, doc_id, lang, case when hit then 1 else 0 end as hit,
    coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as tail,
    coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') as low
  from d),
leaf0 as (
  select rid, doc_id, case when lang is null then '0' else '1' || lang end as grp, sha256(head || tail) as leaf,
    sha256(head || case when hit = 1 then low else tail end) as given from v),
leaf as (
  select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as pos,
    count(*) over (partition by grp) as n from leaf0),
tree as (
  select 0 as lvl, grp, pos, n, leaf as h from leaf
  union all
  select lvl + 1, grp, pos // 8, any_value(n + 7) // 8, sha256(string_agg(h, '' order by pos))
  from tree where n > 1 group by lvl, grp, pos // 8),
subroots as (
  select grp, h, row_number() over (order by grp) - 1 as pos, count(*) over () as n from tree where n = 1),
upper_tree as (
  select 0 as lvl, pos, n, h from subroots
  union all
  select lvl + 1, pos // 8, any_value(n + 7) // 8, sha256(string_agg(h, '' order by pos))
  from upper_tree where n > 1 group by lvl, pos // 8),
sib as (
  select 0 as part, lvl, grp, pos, coalesce(string_agg(h, '') over (partition by lvl, grp, pos // 8 order by pos
      rows between unbounded preceding and 1 preceding), '') as l,
    coalesce(string_agg(h, '') over (partition by lvl, grp, pos // 8 order by pos
      rows between 1 following and unbounded following), '') as r
  from tree where n > 1
  union all
  select 1, lvl, '', pos, coalesce(string_agg(h, '') over (partition by lvl, pos // 8 order by pos
      rows between unbounded preceding and 1 preceding), ''),
    coalesce(string_agg(h, '') over (partition by lvl, pos // 8 order by pos
      rows between 1 following and unbounded following), '')
  from upper_tree where n > 1),
up as (
  select rid, part, lvl, l, r from leaf join sib on sib.part = 0 and sib.grp = leaf.grp
    and sib.pos = leaf.pos // cast(pow(8, lvl) as bigint)
  union all
  select rid, part, lvl, l, r from leaf join subroots s on s.grp = leaf.grp join sib on sib.part = 1
    and sib.pos = s.pos // cast(pow(8, lvl) as bigint)),
path as (select rid, list({'l': l, 'r': r} order by part, lvl) as p from up group by rid),
out as (
  select doc_id, leaf, s.h as subroot, (select h from upper_tree where n = 1) as root,
    sha256(coalesce(list_aggregate(list_transform(p, lambda x: x.l || x.r), 'string_agg', ''), '')) as proof_sha256,
    list_reduce(coalesce(p, []), lambda a, x: {'l': sha256(x.l || a.l || x.r), 'r': ''}, {'l': given, 'r': ''}).l as folded_root
  from leaf join subroots s on s.grp = leaf.grp left join path using (rid))
select *, folded_root = root as verified from out"""

#: Every phrase of 1 to 5 words counted, every cut scored in 128-bit integers.
OP12 = r"""
with p as (
  select row_number() over () as pid, lang, w from (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from (
      select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents))
  where len(w) > 0),
occ as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from (
    select lang, k, w, unnest(range(1, len(w) - k + 2)) as i from p, range(1, 6) r(k) where len(w) >= k)),
f as (select lang, phrase, any_value(k) as k, count(*) as c from occ group by lang, phrase),
tot as (select lang, cast(sum(len(w)) as bigint) as n from p group by lang),
cand as (select lang, phrase, k, c as a, string_split(phrase, ' ') as w from f where k > 1 and c >= 100),
sub as (
  select lang, a, array_to_string(w[i:j], ' ') as phrase from (
    select *, unnest(range(i + 1, k + 1)) as j from (select *, unnest(range(1, k)) as i from cand)) where j - i + 1 < k),
gone as (select distinct c.lang, c.phrase from cand c join sub s on s.lang = c.lang and s.phrase = c.phrase
         where 100 * s.a >= 100 * c.a),
cut as (
  select lang, phrase, a, j, array_to_string(w[1:j], ' ') as head, array_to_string(w[j + 1:k], ' ') as rest
  from (select *, unnest(range(1, k)) as j from cand anti join gone using (lang, phrase))),
scored as (
  select cut.lang, cut.phrase, a, j, h.c as l, t.c as r, n,
    cast((cast(1000 as hugeint) * a * n) // (cast(h.c as hugeint) * t.c) as bigint) as score
  from cut join f h on h.lang = cut.lang and h.phrase = head join f t on t.lang = cut.lang and t.phrase = rest
  join tot on tot.lang = cut.lang),
low as (select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from low qualify rank <= 2000"""
