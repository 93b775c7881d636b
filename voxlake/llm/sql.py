"""DuckDB SQL for the results of the operators that SQL can express."""

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _ASCII_LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
with d as (select doc_id, {_WORDS.format("text")} as w from documents),
i as (select item_id, {_WORDS.format("text")} as w from benchmark),
windows as (
  select distinct item_id, least(10, len(w)) as k, array_to_string(w[pos : pos + least(10, len(w)) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as pos from i where len(w) > 0)),
spots as (
  select doc_id, k, pos, array_to_string(w[pos : pos + k - 1], ' ') as s
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as pos from d, (select distinct k from windows))),
hits as (select doc_id, item_id, s.k, pos from spots s join windows w on s.k = w.k and s.s = w.s),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(pos, pos + k)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n, string_agg(item_id, ',' order by item_id) as s
  from (select distinct doc_id, cast(item_id as varchar) as item_id from hits) group by doc_id)
select d.doc_id, coalesce(len(w), 0) as n_words, coalesce(c.n, 0) as n_hit, coalesce(i.n, 0) as n_items,
  sha256(coalesce(i.s, '')) as items_sha256, c.n is not null as contaminated
from d left join covered c using (doc_id) left join items i using (doc_id)"""

def near_dedup(docs: str, words: int) -> str:
    """Components of documents whose sets of shingles are at least 80 % alike, of a relation with doc_id and text."""
    pattern = r"[^\x20\x09-\x0D]+"
    return f"""
with recursive w as (select doc_id, regexp_extract_all({_ASCII_LOWER.format("text")}, '{pattern}') as w from {docs}),
s as (
  select doc_id, list_distinct(list_transform(range(1, greatest(len(w) - {words - 1}, least(len(w), 1)) + 1), lambda i: array_to_string(w[i : i + {words - 1}], ' '))) as s
  from w),
n as (select doc_id, coalesce(len(s), 0) as n from s),
t as (select doc_id, n, unnest(s) as t from s join n using (doc_id)),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb
  from t a join t b on a.t = b.t and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by 1, 2),
links as (select a, b from common where 100 * c >= 80 * (na + nb - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, low) as (
  select doc_id, doc_id from n
  union select r.doc_id, e.b from reach r join both_ways e on r.low = e.a),
least_id as (select doc_id, min(low) as component_id from reach group by doc_id)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from n join least_id using (doc_id)"""


OP9 = """
with p as (
  select page_id, encode(coalesce(html, '')) as payload, sha1(encode(coalesce(html, ''))) as hex from pages),
k as (select hex, min(page_id) as head from p group by hex),
bits as (
  select page_id, hex, octet_length(payload) as n,
    array_to_string(list_transform(range(40), lambda i: lpad(bin(instr('0123456789abcdef', substr(hex, i + 1, 1)) - 1), 4, '0')), '') as b
  from p)
select page_id, n as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast(list_sum(list_transform(range(5), lambda j: cast(substr(b, 5 * i + j + 1, 1) as int) * cast(pow(2, 4 - j) as int))) as int) + 1, 1)), '') as payload_digest,
  if(page_id = head, 'response', 'revisit') as record_type, if(page_id = head, null, head) as refers_to
from bits join k using (hex)"""

OP11 = f"""
with cut as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_ASCII_LOWER.format("text")}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from cut),
total as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
f as (
  select lang, m, p, count(*) as f from (
    select lang, m, w[i : i + m - 1] as p from (
      select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from w, (select unnest(range(1, 6)) as m)))
  group by all having count(*) >= 100),
cuts as (select lang, m, p, f as a, unnest(range(1, m)) as k from f where m > 1),
scored as (
  select c.lang, c.m, c.p, a, k, x.f as l, y.f as r, n, (1000::hugeint * a * n) // (x.f::hugeint * y.f) as score
  from cuts c join f x on c.lang = x.lang and x.p = c.p[1 : k] join f y on c.lang = y.lang and y.p = c.p[k + 1 : c.m] join total t on c.lang = t.lang),
best as (select * from scored qualify row_number() over (partition by lang, p order by score, k) = 1),
longer as (
  select lang, p, max(f) as f from (select lang, p[1 : m - 1] as p, f from f where m > 2 union all select lang, p[2 : m] as p, f from f where m > 2)
  group by all),
kept as (
  select b.lang, array_to_string(b.p, ' ') as phrase, a, l, r, n, cast(score as bigint) as score
  from best b left join longer o on b.lang = o.lang and b.p = o.p where o.f is null or 100 * o.f < 100 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept qualify rank <= 2000"""

OP13 = """
with e as (
  select vec_id, if(vec_id % 7 = 0, (label + 1) % 10, label) as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings
  where label is not null and embedding is not null and vec_id is not null and coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)),
s as (
  select a.vec_id as anchor_id, e.vec_id, a.label = e.label as same,
    cast(list_dot_product(cast(a.q as double[]), cast(e.q as double[])) as bigint) as score
  from e a join e on a.vec_id % 50 = 0 and a.vec_id <> e.vec_id),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (
  select p.*, vec_id as negative_id, score as negative_score
  from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id) as int) as rank,
  negative_id, positive_score, negative_score
from n qualify rank <= 3"""

SQL = {"op11_collocations": OP11, "op13_hard_negatives": OP13, "op1_decontamination": OP1, "op2_near_dedup": near_dedup("documents", 2), "op9_warc": OP9}
