"""DuckDB SQL for the queries that SQL can express, over the whole tables."""

from __future__ import annotations

from . import license_scan, quality_rules

_WORDS = (r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')")
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = ("list_filter(regexp_split_to_array(" + _LOWER
          + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')")


def _words(text: str = "coalesce(text, '')", lower: bool = False) -> str:
    return _WORDS.format(text=_LOWER.format(text=text) if lower else text)


def _alnum(text: str = "coalesce(text, '')") -> str:
    return _ALNUM.format(text=text)


def _rule(rule: quality_rules.Rule) -> str:
    per = rule.per or "1"
    tests = [f"{rule.measure} {op} {limit}::double * {per}"
             for op, limit in (("<", rule.least), (">", rule.most)) if limit is not None]
    failed = "(" + " or ".join(tests) + ")"
    return f"({failed} and n_words >= {rule.from_words})" if rule.from_words else failed


def quality() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))
    named = ", ".join(f"case when {_rule(r)} then '{r.name}' end" for r in quality_rules.RULES)
    base = " or ".join(_rule(r) for r in quality_rules.RULES if r.name in quality_rules.BASE)
    any_rule = " or ".join(_rule(r) for r in quality_rules.RULES)
    return rf"""
with d as (
  select doc_id, coalesce(text, '') as t, {_words()} as w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
windows as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
twice as (select doc_id, i from windows qualify count(*) over (partition by doc_id, g) > 1),
covered as (select doc_id, count(distinct i + k) as n from twice, range(3) r(k) group by doc_id),
measured as (
  select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
         len(l)::bigint as n_lines, len(list_filter(w, lambda x: x in ({stop})))::bigint as n_stop_words,
         len(regexp_extract_all(t, '!'))::bigint as n_marks
  from d left join covered c on c.doc_id = d.doc_id)
select *, ({base}) as base_failed, not ({any_rule}) as kept, concat_ws(',', {named}) as failed_rules
from measured"""


LEAKS = f"""
with items as (select item_id, {_alnum()} as w from benchmark where text is not null),
widths as (select distinct least(5, len(w)) as k from items where len(w) > 0),
wanted as (
  select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as g
  from (select item_id, w, least(5, len(w)) as k, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i
        from items where len(w) > 0)),
d as (select doc_id, {_alnum()} as w from documents),
there as (
  select distinct doc_id, k, array_to_string(w[i:i + k - 1], ' ') as g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, widths)),
sizes as (select item_id, count(*) as n_item from wanted group by item_id)
select t.doc_id, item_id, count(*)::bigint as n_shared, any_value(n_item)::bigint as n_item,
       count(*)::double / any_value(n_item) as containment
from there t join wanted using (k, g) join sizes using (item_id)
group by t.doc_id, item_id having 100 * count(*) >= 80 * any_value(n_item)"""

NEAR = f"""
with recursive d as (select doc_id, {_words(lower=True)} as w from documents),
shingles as (
  select distinct doc_id, w[i] || ' ' || w[i + 1] as g
  from (select doc_id, w, unnest(range(1, len(w))) as i from d)
  union all select doc_id, w[1] from d where len(w) = 1),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
  select a.doc_id as x, b.doc_id as y
  from shingles a join shingles b on b.g = a.g and b.doc_id <> a.doc_id
  join sizes p on p.doc_id = a.doc_id join sizes q on q.doc_id = b.doc_id
  where 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n)
  group by a.doc_id, b.doc_id having 100 * count(*) >= 80 * (any_value(p.n) + any_value(q.n) - count(*))),
reach as (
  select doc_id, doc_id as r from d
  union
  select reach.doc_id, links.y from reach join links on links.x = reach.r),
found as (select doc_id, min(r) as component_id from reach group by doc_id)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, component_id = doc_id as kept
from found left join sizes using (doc_id)"""

REPEATS = f"""
with d as (select doc_id, {_words()} as w from documents),
starts as (
  select doc_id, i, array_to_string(w[i:i + 34], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d)),
twice as (select doc_id, i from starts qualify count(*) over (partition by g) > 1),
gone as (select distinct doc_id, i + k as p from twice, range(35) r(k)),
places as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (
  select doc_id, string_agg(word, ' ' order by p) as t, count(*) as n
  from places anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(k.n, 0))::bigint as n_removed,
       sha256(coalesce(k.t, '')) as kept_sha256
from d left join kept k on k.doc_id = d.doc_id"""


def licenses() -> str:
    items = license_scan.templates()
    rows = ", ".join(f"({t.number}, '{t.label}', {str(t.exact).lower()}, {t.gram}, '{' '.join(t.words)}')"
                     for t in items)
    return f"""
with template as (
  select n as template, label, exact, gram, string_split(t, ' ') as tw
  from (values {rows}) v(n, label, exact, gram, t)),
grams as (
  select template, gram, i - 1 as pos, array_to_string(tw[i:i + gram - 1], ' ') as g
  from (select template, gram, tw, unnest(range(1, len(tw) - gram + 2)) as i from template)),
wanted as (select template, count(*) as places, count(distinct g) as kinds from grams group by template),
d as (select doc_id, {_alnum()} as w from documents),
hits as (
  select doc_id, template, i - 1 - pos as diagonal, pos
  from (select doc_id, i, gram, array_to_string(w[i:i + gram - 1], ' ') as g
        from (select doc_id, w, gram, unnest(range(1, len(w) - gram + 2)) as i
              from d, (select distinct gram from template))) join grams using (g, gram)),
diagonals as (select doc_id, template, diagonal, min(pos) as a, max(pos) as b from hits group by all),
breaks as (
  select x.*, if(diagonal - lag(diagonal) over o <= if(exact, 0, {license_scan.SLACK}), 0, 1) as fresh
  from diagonals x join template using (template) window o as (partition by doc_id, template order by diagonal)),
finds as (
  select *, sum(fresh) over (partition by doc_id, template order by diagonal) as find from breaks),
spans as (
  select f.doc_id, f.template, f.find, min(f.diagonal) as start, min(f.diagonal + f.a) as low,
         max(f.diagonal + f.b) as high, count(distinct h.pos) as n
  from finds f join hits h using (doc_id, template, diagonal) group by all),
cut as (
  select doc_id, template, label, exact, gram, if(exact, start, low) as first, kinds,
         w[if(exact, start, low) + 1:high + gram] as s
  from spans join template using (template) join wanted using (template) join d using (doc_id)
  where n >= if(exact, 1.0::double, {license_scan.LEAST_SHARE}::double) * places),
shared as (
  select c.doc_id, c.template, any_value(label) as label, any_value(exact) as exact, c.first,
         count(distinct c.g)::double / any_value(kinds) as share
  from (select *, array_to_string(s[k:k + gram - 1], ' ') as g
        from (select *, unnest(range(1, len(s) - gram + 2)) as k from cut)) c
  semi join grams g on g.template = c.template and g.g = c.g
  group by c.doc_id, c.template, c.first, c.s),
good as (
  select distinct * from shared
  where share >= if(exact, 1.0::double, {license_scan.LEAST_SHARE}::double)),
found as (
  select doc_id, count(*) filter (where exact) as n_base, min(first) filter (where exact) as first_word,
         max(first) filter (where exact) as last_word,
         string_agg(distinct label, ',' order by label) filter (where exact) as base_labels,
         string_agg(distinct label, ',' order by label) as labels, max(share) as score
  from good group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base,
       first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       coalesce(score, 0)::double as score
from d left join found using (doc_id)"""


LEXICAL = f"""
with d as (select doc_id, {_alnum()} as w from documents),
total as (select count(*)::bigint as n_docs, sum(len(w))::bigint as n_words from d where len(w) > 0),
tf as (select doc_id, n, t, count(*) as tf from (select doc_id, len(w)::bigint as n, unnest(w) as t from d) group by all),
q as (select item_id, t, count(*) as c from (select item_id, unnest({_alnum()}) as t from benchmark) group by all),
weight as (
  select t, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::bigint as w
  from tf semi join q using (t), total group by t),
scored as (
  select item_id, doc_id,
         sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_words)))))::bigint
         as score
  from q join weight using (t) join tf using (t), total group by item_id, doc_id)
select item_id, rank::int as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank
      from scored where score > 0)
where rank <= 20"""

#: CRC-32 byte by byte, with its table made from the polynomial.
SPELLING = f"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b:
    if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1), i)) as step),
runs as (
  select doc_id, r, count(*) as n
  from (select doc_id, unnest(regexp_extract_all({_LOWER.format(text="text")}, '[a-z\u00C0-\u00FF]+')) as r
        from documents) group by all),
hashed as (
  select r, n, xor(list_reduce(
    list_transform(range(len(x) // 2), lambda k: ('0x' || substr(x, 1 + 2 * k, 2))::bigint),
    lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) as h
  from (select *, hex(encode(coalesce(doc_id::varchar, '') || ':' || r)) as x from runs), crc),
slipped as (
  select if(h % 31 = 0, substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2), r) as word, n from hashed),
words as (
  select word, sum(n)::bigint as n from slipped where length(word) >= 7 group by word having sum(n) >= 2),
cut as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
  from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select a.word, b.word as other, b.n as m from cut a join cut b on b.i = a.i and b.rest = a.rest and b.word <> a.word
  union select c.word, s.word, s.n from cut c join words s on s.word = c.rest
  union select s.word, c.word, c.n from cut c join words s on s.word = c.rest),
best as (
  select word, count(*) as n_near, first(other order by m desc, other) as other, max(m) as m from near group by word),
found as (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, if(m >= 10 * n, other, null) as form,
         if(m >= 10 * n, m, null)::bigint as form_n
  from words w left join best using (word)),
ways as (
  select word, word as at, form as onward from found
  union all
  select ways.word, f.word, f.form from ways join found f on f.word = ways.onward)
select f.*, w.at as root from found f join ways w on w.word = f.word and w.onward is null"""

WARC = """
with p as (
  select page_id, coalesce(html, '') as h, max(page_id) over (partition by coalesce(html, '')) as top from pages),
hashed as (select *, sha1(h) as x from p)
select page_id, strlen(h)::bigint as payload_bytes,
       translate(array_to_string(list_transform(range(8), lambda k:
         to_base(('0x' || substr(x, 1 + 5 * k, 5))::bigint, 32, 4)), ''),
         '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest,
       if(page_id = top, 'response', 'revisit') as record_type, if(page_id = top, null, top) as refers_to
from hashed"""


ORACLE_SQL = {
    "op4_license_scan": licenses(),
    "op5_decontamination": LEAKS,
    "op6_quality_rules": quality(),
    "op7_minhash_dedup": NEAR,
    "op8_substring_dedup": REPEATS,
    "op11_lexical_search": LEXICAL,
    "op12_spelling": SPELLING,
    "op13_warc": WARC,
}
