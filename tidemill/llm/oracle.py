"""SQL of the operators that SQL can express, for an independent engine over the same tables."""

from __future__ import annotations

from tidemill.llm.secrets import ASSIGN, BASE, RULES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
with recursive d as (
  select doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as g from d),
z as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
e as (select x, y from p join z zx on zx.doc_id = x join z zy on zy.doc_id = y where 100 * c >= 80 * (zx.n + zy.n - c)),
both_ways as (select x, y from e union all select y, x from e),
r as (select doc_id, doc_id as other from documents union select r.doc_id, b.y from r join both_ways b on b.x = r.other),
m as (select doc_id, min(other) as component_id from r group by doc_id)
select m.doc_id, coalesce(z.n, 0) as n_shingles, m.component_id, m.doc_id = m.component_id as kept from m left join z on z.doc_id = m.doc_id"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule(kind: str, pattern: str, group: int, least: int) -> str:
    """doc_id, kind, start and end of a rule's matches: the pieces between matches and the matches add up to the places."""
    p = _quoted(pattern)
    return f"""
select doc_id, '{kind}' as kind, s, s + length(hits[i]) as e from (
  select doc_id, hits, parts, i, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) as s from (
    select doc_id, hits, gaps, parts, unnest(range(1, len(hits) + 1)) as i from (
      select doc_id, regexp_extract_all(t, {p}, 0) as hits, regexp_extract_all(t, {p}, {group}) as parts, string_split_regex(t, {p}) as gaps from t where regexp_matches(t, {p})) a) b) c
where length(parts[i]) >= {least}"""


_KINDS = [r.kind for r in RULES]
_PLACE = "case kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(_KINDS)) + " end"
_SPAN = "kind || ':' || s || ':' || e"

OP6 = f"""
with t as (select doc_id, coalesce(text, '') as t from documents),
f as ({' union all '.join(_rule(r.kind, ASSIGN if r.kind == 'assign' else r.pattern, r.group, r.least) for r in RULES)}),
g as (select doc_id,
  {', '.join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in BASE)},
  string_agg({_SPAN}, ',' order by s, {_PLACE}) filter (where kind in ({', '.join(f"'{k}'" for k in BASE)})) as base,
  string_agg({_SPAN}, ',' order by s, {_PLACE}) as spans from f group by doc_id)
select t.doc_id, {', '.join(f'coalesce(n_{k}, 0) as n_{k}' for k in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from t left join g on g.doc_id = t.doc_id"""

OP7 = """
with recursive d as (select doc_id, text, string_split(text, chr(10)) as l from documents),
o as (select doc_id, i, l[i] as line from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from d) x),
u as (select distinct line, length(line) as n from o where length(line) >= 32),
e as (select a.line as x, b.line as y from u a join u b on b.n in (a.n - 1, a.n, a.n + 1) and a.line <> b.line and levenshtein(a.line, b.line) <= 1),
r as (select distinct x as line, x as other from e union select r.line, e.y from r join e on e.x = r.other),
c as (select line, min(other) as class from r group by line),
k as (select o.doc_id, o.i, o.line, o.line = '' or row_number() over (partition by coalesce(c.class, o.line) order by o.doc_id, o.i) = 1 as stays from o left join c on c.line = o.line),
g as (select doc_id, count(*) as n_lines, count(*) filter (where not stays) as n_dropped, string_agg(line, chr(10) order by i) filter (where stays) as text from k group by doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_dropped, 0) as n_dropped, g.text from d left join g on g.doc_id = d.doc_id"""

SQL = {"op2_minhash_dedup": OP2, "op6_secret_scan": OP6, "op7_line_dedup": OP7}
