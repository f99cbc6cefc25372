"""Reference SQL of the training-data operators, for an independent engine."""

WORDS = r"[^\x20\x09-\x0D]+"

OP5 = rf"""
with recursive d as materialized (
  select doc_id, coalesce(source, '') as source,
    len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) as n_tokens
  from documents),
s as (select source, cast(sum(n_tokens) as bigint) as size, count(*) as n_rows from d group by source having sum(n_tokens) > 0),
t as (select list(cast(size as double)) as sizes, cast(sum(size) as double) as total, ln(count(*)) * 0.95 as target from s),
spread(lo, hi) as (
  select 0, 1000000
  union all
  select case when ok then mid else lo end, case when ok then hi else mid - 1 end
  from (
    select lo, hi, mid,
      ln(list_sum(list_transform(sizes, lambda x: pow(x / total, mid / 1000000.0))))
        - mid / 1000000.0 * list_sum(list_transform(sizes, lambda x: pow(x / total, mid / 1000000.0) * ln(x / total)))
          / list_sum(list_transform(sizes, lambda x: pow(x / total, mid / 1000000.0))) >= target as ok
    from (select lo, hi, (lo + hi + 1) // 2 as mid from spread where lo < hi), t)),
repeated(lo, hi) as (
  select 0, 1000000
  union all
  select case when ok then lo else mid + 1 end, case when ok then mid else hi end
  from (
    select lo, hi, mid,
      list_max(list_transform(sizes, lambda x: pow(x / total, mid / 1000000.0) / x))
        / list_sum(list_transform(sizes, lambda x: pow(x / total, mid / 1000000.0))) * total <= 4 as ok
    from (select lo, hi, (lo + hi) // 2 as mid from repeated where lo < hi), t)),
e as (select greatest((select max(lo) from spread), (select max(lo) from repeated)) / 1000000.0 as a),
z as (select sum(pow(size / total, a)) as z from s, t, e),
b as (
  select source, size, cast(floor(pow(size / total, a) / z * total + 0.5) as bigint) as budget,
    cast(ceil(n_rows / 4096.0) as bigint) as blocks
  from s, t, e, z),
dealt as (
  select *, key % blocks as block from (
    select doc_id, d.source, n_tokens, size, budget, blocks, epoch,
      cast('0x' || substr(md5(epoch || ':' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as key
    from d join b on d.source = b.source, lateral (select unnest(range(cast(ceil(budget / size) as bigint))) as epoch) x
    where n_tokens <= budget and budget > 0)),
placed as (
  select *, sum(n_tokens) over (partition by source order by epoch, block, key, doc_id, n_tokens
    rows unbounded preceding) - n_tokens as start_token
  from dealt)
select doc_id, source, n_tokens, epoch, block, cast(start_token as bigint) as start_token, start_token / budget as position
from placed where start_token + n_tokens <= budget
"""

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_JWT = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"


def _secret_matches(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    return rf"""
  select doc_id, '{kind}' as kind, {rank} as rank, {least} as least,
    list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) as gaps,
    list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x)) as lengths,
    list_transform(regexp_extract_all(t, '{pattern}', {group}), lambda x: length(x)) as vals
  from d where regexp_matches(t, '{pattern}')"""


OP6 = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as ({" union all ".join(_secret_matches(*rule) for rule in (
    ("assign", 0, _ASSIGN, 2, 12), ("access", 1, "AKIA[A-Z0-9]+", 0, 0), ("hex", 2, "[0-9a-f]+", 0, 0),
    ("pem", 3, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0), ("jwt", 4, _JWT, 0, 0)))}),
u as (select doc_id, kind, rank, gaps, lengths, vals, unnest(range(1, len(lengths) + 1)) as i from m),
f as (
  select doc_id, kind, rank, list_sum(gaps[1:i]) + coalesce(list_sum(lengths[1:i - 1]), 0) as start, lengths[i] as n
  from u where case kind when 'assign' then vals[i] >= 12 when 'access' then lengths[i] >= 18 when 'hex' then lengths[i] >= 16 else true end),
s as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
    count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || cast(start as bigint) || ':' || cast(start + n as bigint), ',' order by start, rank) as spans,
    string_agg(kind || ':' || cast(start as bigint) || ':' || cast(start + n as bigint), ',' order by start, rank)
      filter (kind in ('assign', 'access', 'hex')) as base
  from f group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join s on d.doc_id = s.doc_id
"""

OP10 = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
  from documents),
k as (
  select doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
r as (select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
f as (select k.doc_id, i, line, r.first is not null and k.doc_id <> r.first as gone from k left join r on k.key = r.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from f group by doc_id
"""

OP1 = """
with p as (select page_id, coalesce(html, '') as h from pages),
f as (select h, min(page_id) as first, sha1(h) as hex from p group by h)
select page_id, cast(strlen(p.h) as bigint) as payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((cast('0x' || substr(hex, 1 + 5 * (i // 4), 5) as integer) >> (15 - 5 * (i % 4))) & 31), 1)), 'string_agg', '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from p join f on p.h = f.h
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11 = rf"""
with recursive d as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) as run from documents),
r as (select doc_id, run, count(*) as n from d where len(run) >= 7 group by all),
table_(t) as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, i))),
b as (select *, hex(encode(doc_id || ':' || run)) as h from r),
c as (select run, n, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: cast('0x' || substr(h, i * 2 + 1, 2) as bigint)),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) as crc from b, table_),
w as (select word, cast(sum(n) as bigint) as n from (
  select case when crc % 31 = 0 then substr(run, 1, crc % len(run)) || substr(run, crc % len(run) + 2) else run end as word, n from c)
  where len(word) >= 7 group by word having sum(n) >= 2),
e as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as less from w, lateral (select unnest(range(len(word))) as i)),
near as (
  select a.word, b.word as other, b.n as m from e a join e b on a.i = b.i and a.less = b.less and a.word <> b.word and len(a.word) = len(b.word)
  union select w.word, e.word, e.n from w join e on e.less = w.word
  union select e.word, w.word, w.n from w join e on e.less = w.word),
best as (select word, count(*) as n_near, max(m) as m from near group by word),
formed as (select best.word, n_near, best.m, min(other) as other from best join near on near.word = best.word and near.m = best.m group by all),
known as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 10 * n then other end as form, case when m >= 10 * n then m end as form_n
  from w left join formed using (word)),
path(word, here, step) as (
  select word, word, 0 from known
  union all select path.word, known.form, step + 1 from path join known on known.word = path.here where known.form is not null),
last as (select word, max_by(here, step) as root from path group by word)
select word, form, root, n, n_near, form_n from known join last using (word)
"""

OP12 = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
  lambda i: array_to_string(w[i : i + 4], ' '))) end as shingles from d),
x as (select doc_id, len(shingles) as n, unnest(shingles) as shingle from s),
pairs as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as common
  from x a join x b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs where 100 * common >= 80 * (na + nb - common)),
ways as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from s union select reach.doc_id, ways.b from reach join ways on ways.a = reach.other)
select s.doc_id, cast(any_value(len(shingles)) as bigint) as n_shingles, min(other) as component_id from s join reach using (doc_id) group by s.doc_id
"""

OP3 = f"select *, doc_id = component_id as kept from ({OP12.replace('100 * common >= 80', '100 * common >= 75')}) z"

OP13 = rf"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
totals as (select lang, cast(sum(len(ws)) as bigint) as n from w group by lang),
g as (select lang, k, array_to_string(ws[i : i + k - 1], ' ') as phrase
  from w, lateral (select unnest(range(1, 5)) as k), lateral (select unnest(range(1, len(ws) - k + 2)) as i)),
f as (select lang, k, phrase, string_split(phrase, ' ') as x, count(*) as a from g group by all having count(*) >= 30),
cuts as (select f.lang, f.phrase, f.a, j, h.a as l, t.a as r, (cast(2000000 as hugeint) * f.a) // (h.a + t.a) as score
  from f, lateral (select unnest(range(1, k)) as j)
  join f h on h.lang = f.lang and h.phrase = array_to_string(f.x[1 : j], ' ') join f t on t.lang = f.lang and t.phrase = array_to_string(f.x[j + 1 :], ' ')),
weakest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inner_ as (select lang, array_to_string(x[i : i + m - 1], ' ') as phrase, max(a) as longer
  from f, lateral (select unnest(range(2, k)) as m), lateral (select unnest(range(1, k - m + 2)) as i) group by all),
kept as (select weakest.* from weakest left join inner_ using (lang, phrase) where longer is null or 100 * longer < 80 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, cast(score as bigint) as score
from kept join totals using (lang) qualify rank <= 2000
"""
