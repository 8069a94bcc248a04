"""DuckDB SQL of the registered queries that SQL can express, written from the contracts."""

from __future__ import annotations

from .chat_format import CLOSE, END, OPEN
from .license_scan import ANCHORS, BASE, MORE
from .quality_rules import DOUBLED, NOTICES, SEPARATORS, TERMINAL

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP1 = f"""
with w as (select doc_id, regexp_extract_all({_LOW}, {_SPACED}) w from documents),
s as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) end) k from w),
n as (select doc_id, count(distinct k) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from (select distinct * from s) a
      join (select distinct * from s) b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
l as (select a, b from e union all select b, a from e),
r as (with recursive t(i, j) as (select doc_id, doc_id from documents union select t.i, l.b from t join l on l.a = t.j)
      select i, min(j) component_id from t group by 1),
f as (select w.doc_id, coalesce(n.n, 0) n_shingles, r.component_id from w left join n using (doc_id) join r on r.i = w.doc_id)
select doc_id, cast(n_shingles as bigint) n_shingles, component_id, doc_id = component_id kept,
  cast(case when n_shingles = 0 then 1 else c.n end as bigint) n_copies
from f join (select i, count(*) n from (select a.doc_id i, b.doc_id from
     (select doc_id, list_sort(list_distinct(list(k))) k from s group by 1) a
     join (select doc_id, list_sort(list_distinct(list(k))) k from s group by 1) b on a.k = b.k) group by 1
     union all select doc_id, 1 from w where len(w) = 0) c on c.i = f.doc_id
"""

_TURN = (f"concat({_quoted(OPEN)}, replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '[', '%5B'), chr(10), '%0A'), "
         f"{_quoted(CLOSE)}, replace(replace(replace(text, '%', '%25'), '<', '%3C'), '[', '%5B'), {_quoted(END)})")

OP4 = f"""
with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o as (select *, length({_TURN}) n, row_number() over (partition by conv_id order by turn, role, text) i,
  count(*) over (partition by conv_id) k from c),
x as (select *, sum(n) over (partition by conv_id order by i) upto from o)
select conv_id, count(*) n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by i)) turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum(upto) filter (role = 'assistant' or i = k) as bigint) formatted_chars
from x group by conv_id
"""

OP7 = rf"""
with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), {_SPACED}) w,
  string_split(coalesce(text, ''), chr(10)) l from documents),
g as (select doc_id, unnest(range(1, len(w) - 3)) p, w from d where len(w) >= 5),
h as (select doc_id, p, array_to_string(list_slice(w, p, p + 4), chr(10)) k from g),
r as (select doc_id, unnest(range(p, p + 5)) q from (select *, count(*) over (partition by doc_id, k) n from h) where n > 1),
rep as (select doc_id, count(distinct q) n_repeat_words from r group by 1),
ln as (select doc_id, unnest(l) x, generate_subscripts(l, 1) i from d),
lj as (select *, len(regexp_extract_all(x, {_SPACED})) n,
  length(x) - length(translate(x, '#*$%&|<>', '')) s from ln),
lv as (select *, n > 0 and ((n >= 3 and not regexp_matches(x, {_quoted(TERMINAL)})) or 10 * s > length(x)
  or 2 * len(regexp_extract_all(x, {_quoted(DOUBLED)})) >= greatest(n, 2)
  or (regexp_matches(x, {_quoted(SEPARATORS)}) and 4 * len(regexp_extract_all(x, {_quoted(SEPARATORS)})) >= n)
  or (n <= 20 and regexp_matches(lower(x), {_quoted(NOTICES)}))) bad from lj),
lg as (select doc_id, count(*) filter (n > 0) - count(distinct x) filter (n > 0) n_dup_lines,
  count(*) filter (bad) n_failed_lines,
  coalesce(sum(length(translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))) filter (not bad), 0) left_chars
  from lv group by 1),
m as (select doc_id, cast(len(w) as bigint) n_words,
  cast(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as bigint) word_chars,
  cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) n_symbols, n_dup_lines,
  coalesce(n_repeat_words, 0) n_repeat_words, n_failed_lines, left_chars
  from d join lg using (doc_id) left join rep using (doc_id)),
v as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines, base_failed,
  not base_failed and not (100 * (word_chars - left_chars) > 50 * word_chars) kept from v
"""

OP8 = f"""
with d as (select doc_id, regexp_extract_all({_LOW}, {_ALNUM}) w from documents),
i as (select cast(item_id as varchar) item_id, regexp_extract_all({_LOW}, {_ALNUM}) w from benchmark),
win as (select distinct item_id, 10 m, array_to_string(list_slice(w, p, p + 9), ' ') k
    from (select item_id, w, unnest(range(1, len(w) - 8)) p from i where len(w) >= 10)
  union select item_id, len(w), array_to_string(w, ' ') from i where len(w) between 1 and 9),
dw as (select doc_id, m, unnest(range(1, len(w) - m + 2)) p, w from d, (select distinct m from win) where len(w) >= m),
occ as (select doc_id, p, dk.m, item_id from (select doc_id, p, m, array_to_string(list_slice(w, p, p + m - 1), ' ') k from dw) dk
  join win on win.m = dk.m and win.k = dk.k),
hit as (select doc_id, count(distinct q) n from (select doc_id, unnest(range(p, p + m)) q from occ) group by 1),
it as (select doc_id, count(distinct item_id) n, array_to_string(list_sort(list_distinct(list(item_id))), ',') s from occ group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(hit.n, 0) n_hit, coalesce(it.n, 0) n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(hit.n, 0) > 0 contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""


def _templates() -> str:
    rows = []
    for k, t in enumerate([*BASE, *MORE]):
        for j, w in enumerate(t.words):
            key = any(a <= j < a + n for a, n in t.keys)
            rows.append(f"({k}, '{t.label}', {str(t.base).lower()}, {t.share}, {j}, '{w}', {str(key).lower()})")
    return ", ".join(rows)


OP9 = f"""
with d as (select doc_id, regexp_extract_all({_LOW}, {_ALNUM}) w from documents),
tw(k, label, base, share, j, word, key) as (values {_templates()}),
x as (select doc_id, unnest(w) word, generate_subscripts(w, 1) - 1 p from d),
df as (select word, count(distinct doc_id) n from x where word in (select word from tw) group by 1),
idf as (select tw.*, ln(((select count(*) from d) + 1.0) / (coalesce(df.n, 0) + 1.0)) + 1.0 v from tw left join df using (word)),
rk as (select *, row_number() over (partition by k order by round(v, 9) desc, j) r from idf),
vote as (select doc_id, k, p - j s, max(label) label, bool_or(base) base, max(share) need,
  sum(v) found, count(*) filter (key) keys, count(*) filter (r <= {ANCHORS}) rare, count(*) filter (r = 1) first
  from x join rk using (word) group by 1, 2, 3),
tot as (select k, sum(v) total, count(*) filter (key) keys, least(count(*), {ANCHORS}) rare from idf group by 1),
pl as (select doc_id, s, label, base, least(1.0, found / total) share,
  vote.keys = tot.keys and least(1.0, found / total) >= need - 1e-9 holds
  from vote join tot using (k) where vote.rare = tot.rare),
a as (select doc_id, count(*) filter (base and holds) n_base, min(s) filter (base and holds) first_word,
  max(s) filter (base and holds) last_word,
  array_to_string(list_sort(list_distinct(list(label) filter (base and holds))), ',') base_labels,
  array_to_string(list_sort(list_distinct(list(label) filter (holds))), ',') labels, max(share) score from pl group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_base, 0) n_base, cast(first_word as bigint) first_word,
  cast(last_word as bigint) last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels,
  round(coalesce(score, 0.0), 6) score from d left join a using (doc_id)
"""

OP11 = f"""
with w as (select doc_id, regexp_extract_all({_LOW}, {_SPACED}) w from documents),
s as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
      else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) end) k from w),
u as (select distinct * from s),
n as (select doc_id, count(*) n from u group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from u a join u b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
l as (select a, b from e union all select b, a from e),
r as (with recursive t(i, j) as (select doc_id, doc_id from documents union select t.i, l.b from t join l on l.a = t.j)
      select i, min(j) component_id from t group by 1)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, r.component_id
from w left join n using (doc_id) join r on r.i = w.doc_id
"""

_CRC = """list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(s, ''), lambda x: ascii(x)::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda x: 0::bigint)),
  lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"""

# The grammar as a table of steps: inserts before a turn, the turn's edit, then the inserts at the end.
# States: 0 nothing yet, 1 after system, 2 a user waits for the assistant, 3 after a pair.
OP13 = f"""
with recursive c as (select *, concat(coalesce(cast(conv_id as varchar), ' '), ':', coalesce(cast(turn as varchar), ' ')) s
  from (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') txt from conversations)),
h as (select *, xor({_CRC}, 4294967295) % 20 k from c),
d as (select conv_id, turn, case when k = 4 then 'user' else role end role,
  case k when 1 then '' when 2 then translate(txt, '.!?', '') else txt end txt,
  unnest(case k when 0 then [] when 3 then [1, 2] else [1] end) cp from h),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(txt)) p,
  trim(txt, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) body from d),
f as (select *, left(role, 1) i, case when body = '' then 'b'
  when row_number() over (partition by conv_id, role, txt order by p) > 1 then 'd'
  when right(body, 1) not in ('.', '!', '?') then 't' else '' end fault,
  lag(left(role, 1)) over (partition by conv_id order by p) before from o),
g as (select conv_id, cast(coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as bigint) gaps,
  count(*) filter (fault = 'b') blank, count(*) filter (fault = 'd') duplicate, count(*) filter (fault = 't') truncated,
  count(*) filter (before is not null and concat(before, i) not in ('su', 'ua', 'au')) illegal, count(*) n from f group by 1),
ins(a, b, x, cost, ed, lines) as (values (0, 0, 0, 0, '', ''), (1, 1, 0, 0, '', ''), (2, 2, 0, 0, '', ''), (3, 3, 0, 0, '', ''),
  (0, 2, 1, 2, 'I', 'user:' || chr(10)), (1, 2, 1, 2, 'I', 'user:' || chr(10)), (3, 2, 1, 2, 'I', 'user:' || chr(10)),
  (2, 3, 1, 2, 'I', 'assistant:' || chr(10)), (0, 3, 2, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
  (1, 3, 2, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
  (3, 3, 2, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
  (2, 2, 2, 4, 'II', 'assistant:' || chr(10) || 'user:' || chr(10))),
takes(b, sym, e, name) as (values (0, 's', 1, ''), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (3, 'u', 2, 'user'), (2, 'a', 3, 'assistant')),
acts as (select f.conv_id, p, b, b e, 3 cost, 'D' ed, '' line from f, (select distinct b from takes)
  union all select conv_id, p, b, e, case when fault = 't' then 1 else 0 end, 'K', concat(role, ':', txt, chr(10))
    from f join takes on sym = i where fault not in ('b', 'd')
  union all select conv_id, p, b, e, case when fault = 't' then 3 else 2 end, 'R', concat(name, ':', txt, chr(10))
    from f join takes on sym <> i and sym <> 's' where fault not in ('b', 'd')),
walk(conv_id, p, st, best) as (
  select conv_id, cast(0 as bigint), 0, row(cast(0 as bigint), '', '') from g
  union all
  select v.conv_id, v.p, v.e, min(row(v.cost, v.audit, v.lines)) from (
    select a.conv_id, a.p, a.e, w.best[1] + ins.cost + a.cost as cost, concat(w.best[2], ins.ed, a.ed) audit,
      concat(w.best[3], ins.lines, a.line) as lines
    from walk w join ins on ins.a = w.st join acts a on a.conv_id is not distinct from w.conv_id and a.p = w.p + 1 and a.b = ins.b) v
  group by 1, 2, 3),
fin as (select w.conv_id, min(row(best[1] + ins.cost, concat(best[2], ins.ed), concat(best[3], ins.lines))) r
  from walk w join g on g.conv_id is not distinct from w.conv_id and w.p = g.n join ins on ins.a = w.st
  where ins.b in (0, 3) group by 1)
select i.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate,
  coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, coalesce(r[1], 0) as "cost", coalesce(r[2], '') audit,
  sha256(coalesce(left(r[3], greatest(length(r[3]) - 1, 0)), '')) repaired_sha256
from (select distinct conv_id from conversations) i left join g on g.conv_id is not distinct from i.conv_id
left join fin on fin.conv_id is not distinct from i.conv_id
"""

ORACLE_SQL = {
    "op1_minhash_near_dedup": OP1,
    "op4_chat_formatting": OP4,
    "op7_quality_rules": OP7,
    "op8_benchmark_decontamination": OP8,
    "op9_license_scans": OP9,
    "op11_ngram_jaccard_join": OP11,
    "op13_conversation_repair": OP13,
}
