"""Plain SQL for the queries that it can express, over whole tables."""

from __future__ import annotations

from helixframe.llm.decontamination import ORACLE as DECONTAMINATION

_WORDS = r"list_filter(string_split_regex({0}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs that share a shingle, linked by their exact similarity; components by following links to their end.
NEAR_DUPLICATES = f"""
with recursive d as (select doc_id, {_WORDS.format(_LOWER)} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
e as (select a.doc_id as u, b.doc_id as v from s a join s b using (g) join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id where a.doc_id <> b.doc_id group by all having 100 * count(*) >= 75 * (max(na.n) + max(nb.n) - count(*))),
r(u, v) as (select u, v from e union select r.u, e.v from r join e on e.u = r.v)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.v, d.doc_id)) as component_id, d.doc_id <= coalesce(m.v, d.doc_id) as kept
from d left join n using (doc_id) left join (select u, min(v) as v from r group by u) m on m.u = d.doc_id
"""

#: Windows as texts; a window that stands twice covers its words.
REPEATS = f"""
with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 34], ' ') as s from (select *, unnest(range(1, len(w) - 33)) as i from d)),
dup as (select doc_id, i from win where s in (select s from win group by s having count(*) > 1)),
gone as (select doc_id, list(distinct i + k) as g from dup, range(35) t(k) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(len(g), 0)::bigint as n_removed, sha256(array_to_string(case when g is null then w else list_filter(w, lambda x, i: not list_contains(g, i)) end, ' ')) as kept_sha256
from d left join gone using (doc_id)
"""

#: The digest's 160 bits in groups of five, each from two hexadecimal digits.
_BASE32 = "array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((strpos('0123456789abcdef', substr(hex, (5 * j // 4 + 1)::int, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(hex, (5 * j // 4 + 2)::int, 1)) - 1) // [8, 4, 2, 1][(5 * j % 4 + 1)::int] % 32 + 1)::int, 1)), '')"
ARCHIVES = f"""
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as hex from pages),
m as (select *, max(page_id) over (partition by hex, payload_bytes) as top from p)
select page_id, payload_bytes, {_BASE32} as payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to from m
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": DECONTAMINATION, "op4_minhash": NEAR_DUPLICATES, "op7_warc": ARCHIVES, "op10_substring": REPEATS}
