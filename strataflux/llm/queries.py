"""The corpus queries and, where SQL can say them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataflux.llm import binary, conversations, decontaminate, exact, language, licenses, near, packing, phrases, pii, quality, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_anchor_pii": pii.op1_anchor_pii,
    "op2_cost_packing": packing.op2_cost_packing,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_redirect_urls": urls.op4_redirect_urls,
    "op5_license_digests": licenses.op5_license_digests,
    "op6_centroid_language": language.op6_centroid_language,
    "op7_rule_quality": quality.op7_rule_quality,
    "op8_token_files": binary.op8_token_files,
    "op9_block_naming_dedup": exact.op9_block_naming_dedup,
    "op10_sketch_near_dedup": near.op10_sketch_near_dedup,
    "op11_subword_toxicity": toxicity.op11_subword_toxicity,
    "op12_son_collocations": phrases.op12_son_collocations,
    "op13_bigint_conversation_repair": conversations.op13_bigint_conversation_repair,
}

ORACLES: dict[str, str] = {}

ORACLES["op9_block_naming_dedup"] = r"""
with norm as (
    select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id,
       min(doc_id) over (partition by t) as keep_id,
       count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept,
       sha256(t) as text_sha256
from norm
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op3_benchmark_decontamination"] = rf"""
with docs as (
    select doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
    select item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
    select distinct item_id, size, array_to_string(w[i : i + size - 1], ' ') as win
    from (select item_id, w, least(10, len(w)) as size from items where len(w) > 0), unnest(range(1, len(w) - size + 2)) as r(i)),
sizes as (select distinct size from windows),
runs as (
    select doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') as win
    from docs, sizes, unnest(range(1, len(w) - size + 2)) as r(i)),
found as (select doc_id, i, size, item_id from runs join windows using (size, win)),
hit as (select doc_id, count(distinct p) as n from found, unnest(range(i, i + size)) as q(p) group by doc_id),
names as (
    select doc_id, count(*) as n, string_agg(item, ',' order by item) as list
    from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(h.n, 0) as n_hit, coalesce(m.n, 0) as n_items,
       sha256(coalesce(m.list, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from docs d left join hit h using (doc_id) left join names m using (doc_id)
"""

ORACLES["op10_sketch_near_dedup"] = rf"""
with recursive words as (
    select doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
sh as (
    select distinct doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') as s
    from words, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) as r(i)),
size as (select doc_id, count(*) as n from sh group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as k from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (
    select a, b from pair join size x on x.doc_id = a join size y on y.doc_id = b
    where 100 * k >= 80 * (x.n + y.n - k)),
edge as (select a, b from link union all select b, a from link),
reach(doc_id, seen) as (
    select doc_id, doc_id from words
    union
    select r.doc_id, e.b from reach r join edge e on e.a = r.seen)
select w.doc_id, coalesce(z.n, 0) as n_shingles, c.component_id, w.doc_id = c.component_id as kept
from words w left join size z using (doc_id)
join (select doc_id, min(seen) as component_id from reach group by doc_id) c using (doc_id)
"""

ORACLES["op5_license_digests"] = licenses.SQL

# The host and path of a url, by its first "://".
HOST = "translate(regexp_extract({u}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
REST = "case when instr({u}, '://') > 0 then substr({u}, instr({u}, '://') + 3) else '' end"

ORACLES["op4_redirect_urls"] = rf"""
with recursive rules(host, path, verdict) as (values
    ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
raw as (select page_id, html, {REST.format(u="url")} as rest from pages),
parsed as (
    select page_id, html, {HOST.format(u="rest")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
           regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) as query from raw),
named as (select *, case when host <> '' then host || case when path = '' then '/' else path end || query end as address from parsed),
tags as (
    select address, host, path, replace(regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?\s*([^"''\s<>]+)', 1), '&amp;', '&') as link
    from named, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<link\b([^<>]*\brel\s*=\s*["'']?canonical\b[^<>]*)>', 1)) as t(tag)
    union all
    select address, host, path, replace(regexp_extract(tag, '(?i)\burl\s*=\s*["'']?\s*([^"''\s<>]+)', 1), '&amp;', '&')
    from named, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<meta\b([^<>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^<>]*)>', 1)) as t(tag)),
goals as (
    select address, case
        when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link
        when starts_with(link, '//') then 'http:' || link
        when starts_with(link, '/') then 'http://' || host || link
        when starts_with(link, '#') or regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') then null
        else 'http://' || host || regexp_replace(case when path = '' then '/' else path end, '[^/]*$', '') || link end as goal
    from tags where link <> ''),
ends as (select address as a, {REST.format(u="goal")} as rest from goals where goal is not null),
link as (
    select a, {HOST.format(u="rest")} || case when regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) end
              || regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) as b from ends where rest <> ''),
edge as (select a, b from link where a <> b union select b, a from link where a <> b),
reach(node, seen) as (select a, a from edge union select r.node, e.b from reach r join edge e on e.a = r.seen),
judged as (
    select n.address, arg_max(r.verdict, length(r.host || r.path)) as verdict
    from (select distinct seen as address from reach) n
    join rules r on (regexp_extract(n.address, '^[^/?#]*') = r.host or ends_with(regexp_extract(n.address, '^[^/?#]*'), '.' || r.host))
        and starts_with(regexp_extract(n.address, '^[^/?#]*([^?#]*)', 1), r.path)
    group by n.address),
fate as (
    select r.node as address, bool_or(j.verdict = 'block') and not bool_or(j.verdict = 'allow') as blocked
    from reach r join judged j on j.address = r.seen group by r.node),
fitting as (
    select p.page_id, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) as fit
    from parsed p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
    group by p.page_id)
select p.page_id, p.host, p.path, f.fit.rule as rule,
       coalesce(f.fit.verdict, case when t.blocked then 'block' end, 'allow') as verdict
from named p left join fitting f using (page_id) left join fate t using (address)
"""

ORACLES["op13_bigint_conversation_repair"] = r"""
with recursive crc(t) as (
    select list(list_reduce([cast(i as bigint), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) order by i) from range(256) as r(i)),
keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
           coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations),
marked as (
    select conv_id, turn, role, text, xor(list_reduce(
        [4294967295] || list_transform(string_split(key, ''), lambda c: cast(ascii(c) as bigint)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 as kind
    from keyed, crc),
damaged as (
    select conv_id, turn, case when kind = 4 then 'user' else role end as role,
           case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
    from marked, unnest(range(case when kind = 3 then 2 else 1 end)) where kind <> 0),
placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as i,
           regexp_replace(text, '[\x20\x09-\x0D]+$', '') as body from damaged),
faults as (
    select *, case when body = '' then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
                   when right(body, 1) not in ('.', '!', '?') then 't' else '' end as fault,
           role[1:1] as c, lag(role[1:1]) over (partition by conv_id order by i) as p from placed),
counts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
           count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
           count(*) filter (i > 1 and p || c not in ('su', 'ua', 'au')) as illegal, max(i) as last from faults group by conv_id),
step(conv_id, i, v0, v1, v2, v3) as (
    select conv_id, cast(0 as bigint), {'c': 0, 'a': ''}, cast(null as struct(c integer, a varchar)), cast(null as struct(c integer, a varchar)), cast(null as struct(c integer, a varchar)) from counts
    union all
    select s.conv_id, f.i,
        struct_pack(c := v0.c + 3, a := v0.a || 'D'),
        list_sort(list_filter([
            case when v1.c is not null then struct_pack(c := v1.c + 3, a := v1.a || 'D') end,
            case when k and f.c = 's' then struct_pack(c := v0.c + e, a := v0.a || 'K') end], lambda x: x is not null))[1],
        list_sort(list_filter([
            case when v2.c is not null then struct_pack(c := v2.c + 3, a := v2.a || 'D') end,
            case when k and f.c = 'u' then struct_pack(c := v0.c + e, a := v0.a || 'K') end,
            case when k and f.c = 'u' and v1.c is not null then struct_pack(c := v1.c + e, a := v1.a || 'K') end,
            case when k and f.c = 'u' and v3.c is not null then struct_pack(c := v3.c + e, a := v3.a || 'K') end,
            case when k and f.c = 'u' and v2.c is not null then struct_pack(c := v2.c + 2 + e, a := v2.a || 'IK') end,
            case when k then struct_pack(c := v0.c + 2 + e, a := v0.a || 'R') end,
            case when k and v1.c is not null then struct_pack(c := v1.c + 2 + e, a := v1.a || 'R') end,
            case when k and v3.c is not null then struct_pack(c := v3.c + 2 + e, a := v3.a || 'R') end,
            case when k and v2.c is not null then struct_pack(c := v2.c + 4 + e, a := v2.a || 'IR') end], lambda x: x is not null))[1],
        list_sort(list_filter([
            case when v3.c is not null then struct_pack(c := v3.c + 3, a := v3.a || 'D') end,
            case when k and f.c = 'a' and v2.c is not null then struct_pack(c := v2.c + e, a := v2.a || 'K') end,
            case when k and v2.c is not null then struct_pack(c := v2.c + 2 + e, a := v2.a || 'R') end,
            case when k and f.c = 'a' then struct_pack(c := v0.c + 2 + e, a := v0.a || 'IK') end,
            case when k and f.c = 'a' and v1.c is not null then struct_pack(c := v1.c + 2 + e, a := v1.a || 'IK') end,
            case when k and f.c = 'a' and v3.c is not null then struct_pack(c := v3.c + 2 + e, a := v3.a || 'IK') end,
            case when k then struct_pack(c := v0.c + 4 + e, a := v0.a || 'IR') end,
            case when k and v1.c is not null then struct_pack(c := v1.c + 4 + e, a := v1.a || 'IR') end,
            case when k and v3.c is not null then struct_pack(c := v3.c + 4 + e, a := v3.a || 'IR') end], lambda x: x is not null))[1]
    from step s join (select *, fault not in ('b', 'd') as k, case when fault = 't' then 1 else 0 end as e from faults) f
        on f.conv_id is not distinct from s.conv_id and f.i = s.i + 1),
chosen as (
    select s.conv_id, list_sort(list_filter([v0,
            case when v1.c is not null then struct_pack(c := v1.c + 4, a := v1.a || 'II') end,
            case when v2.c is not null then struct_pack(c := v2.c + 2, a := v2.a || 'I') end, v3], lambda x: x is not null and x.c is not null))[1] as best
    from step s join counts c on c.conv_id is not distinct from s.conv_id and c.last = s.i),
letters as (
    select conv_id, p, best.a[p : p] as l, count(*) filter (l <> 'I') over (partition by conv_id order by p) as i
    from chosen, unnest(range(1, len(best.a) + 1)) as r(p)),
made as (
    select l.conv_id, l.p, l.l, l.i, f.role, f.text,
           count(*) filter (l.l <> 'D' and not (l.l = 'K' and f.c = 's')) over (partition by l.conv_id order by l.p) as turns
    from letters l left join faults f on f.conv_id is not distinct from l.conv_id and f.i = l.i),
lines as (
    select conv_id, string_agg(case when l = 'K' then role when turns % 2 = 1 then 'user' else 'assistant' end || ':' || case when l = 'I' then '' else text end, chr(10) order by p) as body
    from made where l <> 'D' group by conv_id)
select o.conv_id, coalesce(c.gaps, 0) as gaps, coalesce(c.blank, 0) as blank, coalesce(c.duplicate, 0) as duplicate, coalesce(c.truncated, 0) as truncated,
       coalesce(c.illegal, 0) as illegal, cast(coalesce(h.best.c, 0) as bigint) as cost, coalesce(h.best.a, '') as audit, sha256(coalesce(b.body, '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counts c on c.conv_id is not distinct from o.conv_id
left join chosen h on h.conv_id is not distinct from o.conv_id
left join lines b on b.conv_id is not distinct from o.conv_id
"""

ORACLES["op12_son_collocations"] = r"""
with docs as (
    select coalesce(lang, 'und') as lang, row_number() over () as d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
    from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from docs)),
totals as (select lang, cast(sum(len(w)) as bigint) as n from pieces group by lang),
f as (
    select lang, k as size, array_to_string(w[i : i + k - 1], ' ') as phrase, count(*) as a
    from pieces, unnest([1, 2, 3, 4, 5]) as s(k), unnest(range(1, len(w) - k + 2)) as r(i)
    group by all having count(*) >= 100),
cuts as (
    select f.lang, f.phrase, f.a, k, l.a as l, r.a as r, t.n, cast(1000 * f.a::hugeint * t.n::hugeint // (l.a::hugeint * r.a::hugeint) as bigint) as score
    from (select *, string_split(phrase, ' ') as w from f where size >= 2) f, unnest(range(1, size)) as c(k)
    join f l on l.lang = f.lang and l.phrase = array_to_string(w[1 : k], ' ')
    join f r on r.lang = f.lang and r.phrase = array_to_string(w[k + 1 :], ' ')
    join totals t on t.lang = f.lang),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_parts as (
    select lang, array_to_string(w[i : i + m - 1], ' ') as phrase, max(a) as around
    from (select *, string_split(phrase, ' ') as w from f where size >= 3), unnest(range(2, size)) as p(m), unnest(range(1, size - m + 2)) as q(i)
    group by all)
select b.lang, row_number() over (partition by b.lang order by score desc, b.a desc, b.phrase) as rank, b.phrase, b.a, b.l, b.r, b.n, b.score
from best b left join inner_parts p using (lang, phrase)
where p.around is null or 100 * p.around < 100 * b.a
qualify rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
