"""DuckDB SQL that gives the rows of the queries, where SQL can express them."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5 = rf"""
with sized as (
  select doc_id, source is null as no_source, coalesce(source, '') as src,
         len({WORDS})::bigint as size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint as place
  from documents),
sources as (
  select no_source, src, sum(size)::bigint as source_size,
         case (row_number() over (order by no_source, src) - 1) % 3
              when 0 then 3 when 1 then 1 else 2 end as w
  from sized group by 1, 2),
ordered as (
  select *, sum(2 * source_size) over before as clamped, sum(w) over before as spent,
         1.5::double * sum(source_size) over () as budget, sum(w) over () as weights
  from sources
  window before as (order by 2.0::double * source_size / w, no_source, src
                    rows between unbounded preceding and 1 preceding)),
judged as (
  select *, 2.0::double * source_size * (weights - coalesce(spent, 0))
            <= w * (budget - coalesce(clamped, 0)) as over
  from ordered),
level as (
  select max(budget) - coalesce(sum(2 * source_size) filter (over), 0) as room,
         sum(w) filter (not over) as open
  from judged),
targets as (
  select no_source, src, source_size,
         case when over then 2.0::double * source_size
              else w * room::double / open::double end as target
  from judged, level),
parted as (
  select *, coalesce(least(floor(target / nullif(source_size, 0)), 2), 0)::bigint as whole
  from targets),
dealt as (
  select d.*, source_size, target, whole, target - whole * source_size as rest,
         sum(size) over (partition by no_source, src order by place % 4096, place, doc_id, size
                         rows between unbounded preceding and current row) as upto
  from sized d join parted using (no_source, src))
select doc_id, size, source_size, target,
       (size * (whole + (2 * upto - size <= 2 * rest)::int))::bigint as taken
from dealt
"""

OP6 = rf"""
with docs as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text, source as host
  from documents),
words as (select rid, {WORDS} as w from docs),
windows as (
  select rid, i, w[i:i + 4] as five
  from (select rid, w, unnest(range(1, len(w) - 3)) as i from words)),
twice as (
  select rid, i from windows
  where (rid, five) in (select (rid, five) from windows group by rid, five having count(*) > 1)),
repeats as (
  select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 5)) as p from twice)
  group by rid),
lines as (
  select rid, host, text, unnest(string_split(text, chr(10))) as line from docs),
dup as (
  select rid, count(*) - count(distinct line) as n from lines
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
normal as (
  select rid, host, text, line,
         lower(trim(regexp_replace(regexp_replace(line, '[0-9]', '0', 'g'),
              '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) as norm
  from lines),
frequent as (
  select host, norm from normal where norm <> '' group by host, norm
  having count(distinct text) > 20),
remaining as (
  select rid, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) as n
  from normal l left join frequent f on l.host is not distinct from f.host and l.norm = f.norm
  where f.norm is null group by rid),
base as (
  select d.rid, doc_id, len(w)::bigint as n_words,
         coalesce(len(array_to_string(w, '')), 0)::bigint as word_chars,
         len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         coalesce(dup.n, 0)::bigint as n_dup_lines,
         coalesce(repeats.n, 0)::bigint as n_repeat_words,
         coalesce(remaining.n, 0)::bigint as n_words_left
  from docs d join words using (rid) left join dup using (rid)
  left join repeats using (rid) left join remaining using (rid)),
judged as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and n_words_left >= 10 and n_words_left >= 0.3::double * n_words as kept,
       n_words_left
from judged
"""

TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP7 = rf"""
with docs as (
  select row_number() over () as rid, doc_id, {TERMS} as w from documents),
items as (
  select coalesce(item_id::varchar, 'null') as item, {TERMS} as w from benchmark),
sized as (select *, least(10, len(w)) as n from items where len(w) > 0),
windows as (
  select distinct item, n, w[i:i + n - 1] as phrase
  from (select *, unnest(range(1, len(w) - n + 2)) as i from sized)),
lengths as (select distinct n from windows),
places as (
  select rid, i, n, w[i:i + n - 1] as phrase
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, lengths)),
found as (select rid, i, p.n, item from places p join windows using (n, phrase)),
hits as (
  select rid, count(distinct p) as n_hit
  from (select rid, unnest(range(i, i + n)) as p from found) group by rid),
named as (
  select rid, count(distinct item) as n_items,
         string_agg(distinct item, ',' order by item) as ids
  from found group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from docs left join hits using (rid) left join named using (rid)
"""



def leaf_sql(text: str) -> str:
    """The digest of a row, with ``text`` in the place of its text."""
    values = ["doc_id::varchar", "source", "lang", "n_chars::varchar", text]
    return f"sha256({' || '.join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values)})"


def tree_sql(name: str, leaves: str) -> str:
    """Recursive views: the nodes over ``leaves`` (tree, place, h), and their families."""
    return f"""
{name}(level, tree, place, h) as (
  select 0, tree, place, h from {leaves}
  union all
  select level + 1, tree, place // 8, sha256(string_agg(h, '' order by place))
  from (select *, count(*) over (partition by tree) as wide from {name}) where wide > 1
  group by level, tree, place // 8),
{name}_families as (
  select level, tree, place // 8 as parent, list(h order by place) as hs
  from (select *, count(*) over (partition by level, tree) as wide from {name}) where wide > 1
  group by level, tree, place // 8)"""


def walk_sql(name: str, tree: str, start: str) -> str:
    """Recursive views: the rows of ``start`` (rid, tree, place, now, proof) on their way up."""
    return f"""
{name}(level, rid, tree, place, now, proof) as (
  select 0, rid, tree, place, now, proof from {start}
  union all
  select w.level + 1, rid, w.tree, parent,
         sha256(array_to_string(list_transform(hs, lambda h, i:
             case when i = place % 8 + 1 then now else h end), '')),
         proof || array_to_string(list_filter(hs, lambda h, i: i <> place % 8 + 1), '')
  from {name} w join {tree}_families f
    on f.level = w.level and f.tree = w.tree and f.parent = w.place // 8),
{name}_ends as (
  select rid, arg_max(now, level) as now, arg_max(proof, level) as proof from {name} group by rid)"""


ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12 = f"""
with recursive
crc_table as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, range(8)),
      lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)) as crcs),
docs as (
  select row_number() over () as rid, *, xor(4294967295::bigint, list_reduce(
      list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda crc, b: xor(crc >> 8, crcs[(xor(crc, b) & 255) + 1]))) as crc
  from documents, crc_table),
digests as (
  select rid, doc_id, lang, {leaf_sql("text")} as h,
         case when crc % 3 = 0 then {leaf_sql(ASCII_LOWER)} else {leaf_sql("text")} end as changed
  from docs),
leaves as (
  select *, dense_rank() over (order by lang nulls first) - 1 as tree,
         row_number() over (partition by lang order by doc_id nulls first, h) - 1 as place
  from digests),
{tree_sql("nodes", "leaves")},
subroots as (select tree, arg_max(h, level) as h from nodes group by tree),
over as (select -1 as tree, tree as place, h from subroots),
{tree_sql("tops", "over")},
root as (select arg_max(h, level) as root from tops),
begun as (select rid, tree, place, changed as now, '' as proof from leaves),
{walk_sql("walk", "nodes", "begun")},
higher as (
  select e.rid, -1 as tree, l.tree as place, now, proof from walk_ends e join leaves l using (rid)),
{walk_sql("climb", "tops", "higher")}
select doc_id, l.h as leaf, s.h as subroot, root, sha256(proof) as proof_sha256, now as folded_root,
       now = root as verified
from leaves l join climb_ends using (rid) join subroots s on s.tree = l.tree, root
"""

OP11 = f"""
with words as (
  select rid, piece, lang, w, row_number() over (partition by rid, piece order by i) as i from (
    select rid, piece, lang, unnest(ws) as w, generate_subscripts(ws, 1) as i from (
      select rid, lang, generate_subscripts(pieces, 1) as piece,
             regexp_extract_all(unnest(pieces), '[^\\x20\\x09]+') as ws
      from (select row_number() over () as rid, coalesce(lang, 'und') as lang,
                   regexp_split_to_array({ASCII_LOWER}, '[.,;:!?\\x0A-\\x0D]') as pieces
            from documents where text is not null)))),
totals as (select lang, count(*)::bigint as n from words group by lang),
runs as (
  select lang, [w] as p1, [w, lead(w, 1) over s] as p2, [w, lead(w, 1) over s, lead(w, 2) over s] as p3,
         [w, lead(w, 1) over s, lead(w, 2) over s, lead(w, 3) over s] as p4
  from words window s as (partition by rid, piece order by i)),
counted as (
  select lang, p, count(*)::bigint as f from (
    select lang, unnest([p1, p2, p3, p4], max_depth := 1) as p from runs)
  where p[-1] is not null and not list_contains(list_transform(p, lambda x: x is null), true)
  group by lang, p having count(*) >= 30),
candidates as (select lang, p, f as a from counted where len(p) > 1),
cuts as (
  select c.lang, c.p, a, k, l.f as l, r.f as r, (2000000::hugeint * a) // (l.f + r.f)::hugeint as score
  from (select *, unnest(range(1, len(p))) as k from candidates) c
  join counted l on l.lang = c.lang and l.p = c.p[:k]
  join counted r on r.lang = c.lang and r.p = c.p[k + 1:]),
scored as (
  select lang, p, a, arg_min(l, (score, k)) as l, arg_min(r, (score, k)) as r, min(score)::bigint as score
  from cuts group by lang, p, a),
inner_parts as (
  select lang, a, unnest([p[:len(p) - 1], p[2:]], max_depth := 1) as part from candidates where len(p) > 2
  union all select lang, a, unnest([p[1:2], p[2:3], p[3:4]], max_depth := 1) from candidates where len(p) = 4),
displaced as (
  select distinct s.lang, s.p from scored s join inner_parts i on i.lang = s.lang and i.part = s.p
  where 100 * i.a >= 80 * s.a),
ranked as (
  select lang, array_to_string(p, ' ') as phrase, a, l, r, score,
         row_number() over (partition by lang order by score desc, a desc, array_to_string(p, ' ')) as rank
  from scored where (lang, p) not in (select (lang, p) from displaced))
select lang, rank::bigint as rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""

ORACLES = {"op7_decontamination": OP7, "op5_mixing": OP5, "op6_quality_rules": OP6, "op11_collocations": OP11, "op12_merkle_manifest": OP12}
