"""The same results in DuckDB SQL over the same tables, written independently of the Spark plans."""

from __future__ import annotations

import re

from voxlake import fixed
from voxlake.plans import fixtures as fx

WS = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def normal(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def first_words(x: str, n: int) -> str:
    return f"coalesce(array_to_string(list_slice({words(x)}, 1, {n}), ' '), '')"


def strings(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def clock(x: str) -> str:
    s = f"cast(trunc({x}) as bigint)"
    return f"printf('%02d:%02d:%02d', {s} // 3600, ({s} % 3600) // 60, {s} % 60)"


BLOCKS: dict[str, str] = {}

BLOCKS["calls0"] = r"select *, cast(regexp_extract(props, '(\d+)', 1) as int) as k from events"
BLOCKS["calls"] = """
select event_id as call_id, user_id as customer_id, event_id % 40 as agent_id, ts as started_at, cast(ts as date) as call_date,
  value as duration_seconds, case when d then event_type end as intent_label,
  case when d then case when k % 10 < 7 then 'resolved' when k % 10 < 9 then 'partial' else 'unresolved' end end as resolution_status,
  case when d then 'asked about ' || event_type || ' on line ' || (k % 7) end as summary,
  case when d and k % 11 <> 10 then cast((k * 7 + event_id) % 101 as int) end as attention_score,
  case when d and k % 13 = 0 then cast(k % 7 as int) end as mood_shift_turn_index,
  case when d then ts + interval 1 hour end as analyzed_at,
  case when k % 9 <> 8 then ts end as transcribed_at,
  case when k % 2 = 0 then 'alpha' else 'beta' end as transcript_provider
from (select *, k % 25 <> 24 as d from calls0)"""
BLOCKS["ocalls"] = """
select o_orderkey as call_id, o_custkey as customer_id, o_orderdate as started_at, o_orderpriority as intent_label,
  o_orderpriority as cluster_id, o_totalprice as duration_seconds from orders"""
BLOCKS["clusters"] = "select event_id as call_id, event_type as cluster_id from calls0 where k % 50 <> 49"
BLOCKS["issues"] = "select distinct event_type as cluster_id, 'issue ' || event_type as label from events"
BLOCKS["customers"] = "select c_custkey as customer_id, c_name as name from customer"
BLOCKS["agents"] = "select s_suppkey as agent_id, s_name as name from supplier"
BLOCKS["ev"] = f"""
select l_orderkey as call_id, ([{', '.join(q(c) for c in fx.CLAIM_TYPES)}])[l_linenumber] as claim_type,
  l_linenumber as turn_index, l_partkey as ord, {clock('l_quantity')} as timestamp, 'part ' || l_partkey as quote,
  l_discount < 0.08 as verified from lineitem"""
BLOCKS["cov"] = "select call_id, round(avg(case when verified then 1.0 else 0.0 end) * 100, 1) as evidence_coverage from ev group by 1"
BLOCKS["turns"] = f"""
select call_id, turn_index, speaker, text, w, start_ms, end_ms, start_ms / 1000 as start_seconds, end_ms / 1000 as end_seconds
from (select *, case when len(w) = 0 then start_ms else start_ms + 400 * (len(w) - 1) + 1000 * ((len(w) - 1) // 12) + 350 end as end_ms
  from (select *, cast(row_number() over p - 1 as int) as turn_index,
      cast(coalesce(sum(step) over (partition by call_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as start_ms
    from (select *, 400 * len(w) + case turn % 3 when 0 then 300 when 1 then -900 else 1500 end as step
      from (select conv_id as call_id, turn, case role when 'user' then 'customer' else 'agent' end as speaker, text, {words('text')} as w
        from conversations where role <> 'system'))
    window p as (partition by call_id order by turn)))"""
BLOCKS["words"] = """
select call_id, turn_index as segment_no, speaker, i, w[i + 1] as word, (start_ms + 400 * i + 1000 * (i // 12)) / 1000 as ws,
  (start_ms + 400 * i + 1000 * (i // 12) + 350) / 1000 as we
from (select *, unnest(range(len(w))) as i from turns)"""
BLOCKS["pieces"] = f"""
select call_id, segment_no, cast(piece_no as int) as piece_no, any_value(speaker) as speaker, min(ws) as start, max(we) as "end",
  string_agg(word, ' ' order by i) as text, cast(count(*) as int) as n_words
from (select *, sum(brk) over (partition by call_id, segment_no order by i) as piece_no
  from (select *, case when ws - lag(we) over (partition by call_id, segment_no order by i) > {fixed.TURN_GAP} then 1 else 0 end as brk from words))
group by 1, 2, 3
union all
select call_id, turn_index, 0, speaker, start_seconds, end_seconds, text, 0 from turns where len(w) = 0"""
BLOCKS["merged0"] = f"""
select *, lag(speaker) over o as ps, lag(reach) over o as pe from (
  select *, max("end") over (partition by call_id, run order by start, speaker, segment_no, piece_no rows unbounded preceding) as reach from (
    select *, sum(sw) over (partition by call_id order by start, speaker, segment_no, piece_no) as run from (
      select *, case when speaker <> lag(speaker) over (partition by call_id order by start, speaker, segment_no, piece_no) then 1 else 0 end as sw from pieces)))
window o as (partition by call_id order by start, speaker, segment_no, piece_no)"""
BLOCKS["merged1"] = f"""
select *, case when ps is null then 1 when ps = speaker and start - pe <= {fixed.TURN_GAP} then 0 else 1 end as fresh,
  coalesce(ps <> speaker and start < pe, false) as crossing from merged0"""
BLOCKS["merged"] = """
select call_id, cast(t - 1 as int) as turn_index, any_value(speaker) as speaker, min(start) as start_seconds, max("end") as end_seconds,
  string_agg(text, ' ' order by start, speaker, segment_no, piece_no) as text, cast(sum(n_words) as int) as n_words,
  bool_or(crossing) or coalesce(bool_or(next_crossing), false) as overlapping
from (select *, sum(fresh) over o as t, lead(crossing) over o as next_crossing from merged1
  window o as (partition by call_id order by start, speaker, segment_no, piece_no))
group by 1, 2"""
BLOCKS["swapped"] = f"select distinct call_id from turns where turn_index = 0 and speaker = 'customer' and regexp_matches(text, {q(fx.GREETING)})"
BLOCKS["lines"] = """
select call_id, turn_index, printf('[%d] %02d:%02d %s: %s', turn_index, cast(floor(start_seconds / 60) as bigint),
  cast(floor(start_seconds % 60) as bigint), speaker, text) as line from turns"""

# Sentiment
BLOCKS["lexicon"] = "select * from (values " + ", ".join(f"({q(t)}, {v})" for t, v in fx.LEXICON) + ") l(token, valence)"
STRIPPED = "lower(regexp_replace(w, '^[.,!?''\"]+|[.,!?''\"]+$', '', 'g'))"
BLOCKS["variants"] = f"""
select call_id, turn_index, 0 as variant, w, text as said, len(w) as n_all from turns
union all
select call_id, turn_index, 1, kept, coalesce(array_to_string(kept, ' '), ''), n_all from (
  select call_id, turn_index, list_filter(w, lambda w: {STRIPPED} not in {strings(fixed.REFUSAL_WORDS)}) as kept, len(w) as n_all from turns)"""
BLOCKS["tokens"] = r"""
select call_id, turn_index, variant, i, raw, regexp_replace(lower(raw), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') as token,
  upper(raw) = raw and lower(raw) <> raw as loud
from (select call_id, turn_index, variant, unnest(range(len(w))) as i, unnest(w) as raw from variants)"""
BLOCKS["tokens2"] = """
select *, lag(token, 1) over o as p1, lag(token, 2) over o as p2, lag(token, 3) over o as p3,
  min(case when token = 'but' then i end) over k as but_at, bool_or(loud) over k and not bool_and(loud) over k as mixed
from tokens window o as (partition by call_id, turn_index, variant order by i), k as (partition by call_id, turn_index, variant)"""


def _boost(p: str, decay: float) -> str:
    up, down = strings(fixed.BOOST_UP), strings(fixed.BOOST_DOWN)
    return f"case when {p} in {up} then {fixed.BOOST * decay}::double when {p} in {down} then {-fixed.BOOST * decay}::double else 0 end"


def _neg(p: str) -> str:
    return f"case when {p} in {strings(fixed.NEGATORS)} then {fixed.NEGATION_FACTOR}::double else 1 end"


_v = f"(valence::double + case when mixed and loud then sign(valence) * {fixed.CAPS_BOOST} else 0 end)"
for _p, _d in zip(("p1", "p2", "p3"), fixed.BOOST_DECAY):
    _v = f"(({_v} + sign(valence) * {_boost(_p, _d)}) * {_neg(_p)})"
BLOCKS["sums"] = f"""
select call_id, turn_index, variant,
  sum({_v} * case when but_at is null then 1 when i < but_at then {fixed.BUT_BEFORE} when i > but_at then {fixed.BUT_AFTER} else 1 end) as s
from tokens2 join lexicon using (token) group by 1, 2, 3"""
BLOCKS["scores"] = f"""
select call_id, turn_index, variant, n_all, len(w) as n, round(greatest(-1, least(1, t / sqrt(t * t + 15))), 4) as c from (
  select *, case when s > 0 then s + e when s < 0 then s - e else 0 end as t from (
    select v.*, coalesce(s, 0) as s, least(length(said) - length(replace(said, '!', '')), 4) * {fixed.EXCLAMATION_STEP}::double
      + case when length(said) - length(replace(said, '?', '')) <= 1 then 0
          when length(said) - length(replace(said, '?', '')) <= 3 then (length(said) - length(replace(said, '?', ''))) * {fixed.QUESTION_STEP}::double
          else {fixed.QUESTION_MAX} end as e
    from variants v left join sums using (call_id, turn_index, variant)))"""
BLOCKS["valence"] = """
select a.call_id, a.turn_index, a.c as valence,
  case when b.n = a.n_all then false when b.n = 0 then true else b.c > -0.05 end as mere_decline
from scores a join scores b on a.call_id = b.call_id and a.turn_index = b.turn_index and a.variant = 0 and b.variant = 1"""
BLOCKS["valence2"] = "select *, case when valence < 0 and mere_decline then 0 else valence end as text_score from valence"
BLOCKS["gaps"] = """
select call_id, segment_no as turn_index, sum(case when g > 0.45 then g else 0 end) as silent
from (select *, ws - lag(we) over (partition by call_id, segment_no order by i) as g from words) group by 1, 2"""
BLOCKS["prosody"] = """
select call_id, turn_index, speaker, len(w) / greatest(end_seconds - start_seconds, 1e-6) as words_per_second,
  least(coalesce(silent, 0) / greatest(end_seconds - start_seconds, 1e-6), 1) as pause_share,
  len(w) >= 4 and greatest(end_seconds - start_seconds, 1e-6) >= 1.2 as measurable
from turns left join gaps using (call_id, turn_index)"""
BLOCKS["medians"] = "select call_id, median(words_per_second) as median_rate from prosody where speaker = 'customer' and measurable group by 1"
BLOCKS["flags"] = f"""
select call_id, turn_index,
  {strip('text')} <> '' and not regexp_matches({strip('text')}, {q(fixed.PLEASANTRY)})
    and not regexp_matches({strip('text')}, {q(fixed.DICTATION)}) and len(w) >= 4 as substantive,
  speaker = 'customer' and len({words(normal('text'))}) >= 5 as citable from turns"""
BLOCKS["points"] = """
select call_id, turn_index, start_seconds as seconds, text_score, prosody_score,
  greatest(-1, least(1, 0.7::double * text_score + 0.3::double * prosody_score)) as score, substantive, citable
from (select t.*, text_score, substantive, citable,
    case when measurable then greatest(-1, least(1, 0.6::double * -(case when median_rate > 0 then words_per_second / median_rate else 1 end - 1) + 0.4::double * -pause_share)) else 0 end as prosody_score
  from turns t join valence2 using (call_id, turn_index) join prosody using (call_id, turn_index) join flags using (call_id, turn_index)
  left join medians using (call_id) where t.speaker = 'customer')"""
BLOCKS["worst"] = """
select call_id, score as worst_mood, case when citable then turn_index end as worst_mood_turn_index
from points qualify row_number() over (partition by call_id order by score, turn_index) = 1"""
BLOCKS["phrases"] = "select * from (values " + ", ".join(f"({i}, {q(p)})" for i, p in enumerate(fx.PHRASES)) + ") p(phrase_no, phrase)"
BLOCKS["hits"] = "select call_id, turn_index, phrase_no, phrase from turns join phrases on contains(lower(text), phrase) where speaker = 'customer'"
BLOCKS["hitsum"] = """
select call_id, count(*) as escalation_count, min_by(turn_index, turn_index * 1000 + phrase_no) as escalation_turn_index,
  min_by(phrase, turn_index * 1000 + phrase_no) as escalation_phrase from hits group by 1"""

# Change points
BLOCKS["series"] = """
select user_id as call_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as turn_index,
  least(value / 50, 2) - 1 as score, event_type <> 'view' as substantive, event_id % 4 <> 3 as citable from events"""
SERIES_TAIL = {
    "placed": "select *, row_number() over o - 1 as pos, count(*) over (partition by call_id) as n from {src} window o as (partition by call_id order by turn_index)",
    "smoothed": "select *, case when n < 3 then score else avg(score) over (partition by call_id order by pos rows between 1 preceding and 1 following) end as sm from {placed}",
    "lists": """select call_id, any_value(n) as n, 2 * greatest(var_pop(sm), 0.001) * ln(any_value(n)) as pen, list(sm order by pos) as xs,
  list(score order by pos) as raw, list(turn_index order by pos) as ti from {smoothed} group by 1""",
    "sums": """select *, list_transform(range(0, n + 1), lambda k: coalesce(list_sum(xs[1:k]), 0)) as a,
  list_transform(range(0, n + 1), lambda k: coalesce(list_sum(list_transform(xs[1:k], lambda x: x * x)), 0)) as b from {lists} where n >= 5""",
    "dp": """select call_id, cast(1 as bigint) as t, n, pen, a, b, [-pen, 'infinity'::double] as f, [cast(0 as bigint), 0] as back from {sums}
union all
select call_id, t + 1, n, pen, a, b, list_append(f, best.c + pen), list_append(back, best.s) from (
  select *, list_min(list_transform(range(0, t), lambda s: {{'c': f[s + 1] + (b[t + 2] - b[s + 1]) - (a[t + 2] - a[s + 1]) * (a[t + 2] - a[s + 1]) / (t + 1 - s), 's': s}})) as best
  from {dp} where t < n)""",
    "walk": """select call_id, n as cut, back from {dp} where t = n
union all select call_id, back[cut + 1], back from {walk} where back[cut + 1] > 0""",
    "cuts": "select w.call_id, cut as break_pos from {walk} w join {lists} l on l.call_id = w.call_id where cut < n",
    "described": """select call_id, break_pos, ti[break_pos + 1] as turn_index, list_avg(raw[1:break_pos]) as before_mean,
  list_avg(raw[break_pos + 1:n]) as after_mean from {cuts} join {lists} using (call_id)""",
    "shifts": """select call_id, turn_index, before_mean, after_mean, after_mean - before_mean as delta from {described}
where abs(after_mean - before_mean) >= 0.12 qualify row_number() over (partition by call_id order by abs(after_mean - before_mean) desc, break_pos) = 1""",
}


def _series(prefix: str, source: str) -> None:
    names = {k: f"{prefix}_{k}" for k in SERIES_TAIL}
    for key, sql in SERIES_TAIL.items():
        BLOCKS[names[key]] = sql.format(src=source, **names)


_series("s", "series")
BLOCKS["sub_series"] = "select * from series where substantive"
_series("u", "sub_series")

# Judgments
BLOCKS["judged"] = f"""
select call_id, {first_words('itext', 5)} as intent_label, intent_turn_index,
  case call_id % 3 when 0 then 'resolved' when 1 then 'partial' else 'unresolved' end as resolution_status, resolution_turn_index,
  'asked: ' || itext as summary
from (select call_id, min(turn_index) filter (speaker = 'customer') as intent_turn_index,
    min_by(text, turn_index) filter (speaker = 'customer') as itext, max(turn_index) as resolution_turn_index from turns group by 1)
where intent_turn_index is not null"""
BLOCKS["claims0"] = """
select call_id, 'intent' as claim_type, intent_label as claim_text, intent_turn_index as turn_index, 0 as ord from judged
union all
select call_id, 'resolution', 'the customer wanted to ' || intent_label || '; this was ' || resolution_status, resolution_turn_index, 1 from judged"""
BLOCKS["contra"] = f"""
select a.call_id, a.i as agent_turn_index, min(c.turn_index) as customer_turn_index
from (select call_id, min(turn_index) as i from turns where speaker = 'agent' and regexp_matches(text, {q(fx.AGENT_CLAIM)}) group by 1) a
join turns c on c.call_id = a.call_id and c.turn_index > a.i and c.speaker = 'customer' and regexp_matches(c.text, {q(fx.PUSHBACK)})
group by 1, 2"""
BLOCKS["rcontra"] = "select c.* from contra c join judged j on c.call_id = j.call_id and j.resolution_status = 'resolved'"
BLOCKS["claims"] = f"""
select * from claims0
union all select call_id, 'resolution_contradiction_agent', {q(fixed.CLAIM_AGENT_RESOLVED)}, agent_turn_index, 3 from rcontra
union all select call_id, 'resolution_contradiction_customer', {q(fixed.CLAIM_CUSTOMER_DENIES)}, customer_turn_index, 4 from rcontra"""
BLOCKS["cited0"] = "select c.*, text, start_seconds from claims0 c join turns using (call_id, turn_index)"
BLOCKS["cited"] = "select c.*, text, start_seconds from claims c join turns using (call_id, turn_index)"
SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def _similarity(prefix: str, pairs: str) -> dict[str, str]:
    """Blocks that score `pairs(id, x, y)` by word sets; the common subsequence is a recursive query over one text."""
    p = prefix
    return {
        f"{p}_sets": f"""select id, list_distinct({words('lower(x)')}) as tx, list_distinct({words('lower(y)')}) as ty from {pairs}""",
        f"{p}_parts": f"""select id, len(tx) as nx, len(ty) as ny, list_filter(tx, lambda w: list_contains(ty, w)) as sh,
  list_sort(list_filter(tx, lambda w: not list_contains(ty, w))) as ox, list_sort(list_filter(ty, lambda w: not list_contains(tx, w))) as oy from {p}_sets""",
        f"{p}_text": f"""select id, nx, ny, len(sh) as ns, len(ox) as nox, len(oy) as noy, coalesce(length(array_to_string(sh, ' ')), 0) as ls,
  coalesce(array_to_string(ox, ' '), '') as a, coalesce(array_to_string(oy, ' '), '') as b from {p}_parts""",
        f"{p}_lcs": f"""select id, 0 as i, a, string_split(b, '') as bs, list_transform(range(length(b) + 1), lambda k: 0) as r from {p}_text where a <> '' and b <> ''
union all
select id, i + 1, a, bs, list_reduce(range(1, len(bs) + 1), lambda acc, j: list_append(acc, greatest(acc[-1], r[j + 1], case when bs[j] = a[i + 1] then r[j] + 1 else 0 end)), [0])
from {p}_lcs where i < length(a)""",
        f"{p}_len": f"""select t.*, coalesce(l.r[-1], 0) as lcs, length(a) as la, length(b) as lb, case when ls > 0 then 1 else 0 end as g
from {p}_text t left join (select id, r from {p}_lcs where i = length(a)) l using (id)""",
        f"{p}_sim": f"""select id, case when nx = 0 or ny = 0 then 0 when ns > 0 and (nox = 0 or noy = 0) then 1
  when ls = 0 then (100 - 100.0::double * (la + lb - 2 * lcs) / (la + lb)) / 100
  else greatest(100 - 100.0::double * (la + lb - 2 * lcs) / (2 * ls + 2 * g + la + lb), 100 - 100.0::double * (g + la) / (2 * ls + g + la),
    100 - 100.0::double * (g + lb) / (2 * ls + g + lb)) / 100 end as sim from {p}_len""",
    }


def _quotes(prefix: str, cited: str) -> dict[str, str]:
    """Blocks for quote choice and support of `cited`; `<prefix>_final` has quote and support."""
    p = prefix
    out = {
        f"{p}_id": f"select row_number() over (order by call_id, turn_index, ord, claim_type, claim_text) as cid, * from {cited}",
        f"{p}_sent": f"select cid, unnest(range(len(s))) as no, unnest(s) as sentence, len(s) as n from (select cid, {SENTENCES} as s from {p}_id)",
        f"{p}_pairs": f"""select cid * 100000 + no as id, claim_text as x, sentence as y from {p}_sent join {p}_id using (cid)
where n > 1 and len({words('sentence')}) >= 3""",
        **_similarity(f"{p}_q", f"{p}_pairs"),
        f"{p}_best": f"""select cid, sentence from {p}_sent join {p}_q_sim on id = cid * 100000 + no
qualify row_number() over (partition by cid order by sim desc, no) = 1""",
        f"{p}_one": f"select cid, sentence, n from {p}_sent where no = 0",
        f"{p}_quote": f"""select i.*, {first_words("case when coalesce(o.n, 0) <= 1 then i.text else coalesce(b.sentence, o.sentence) end", 30)} as quote
from {p}_id i left join {p}_one o using (cid) left join {p}_best b using (cid)""",
        f"{p}_sup": f"select cid as id, claim_text as x, quote as y from {p}_quote",
        **_similarity(f"{p}_z", f"{p}_sup"),
        f"{p}_final": f"""select t.*, sim as support, len({words(normal('quote'))}) < 5 as short, contains({normal('text')}, {normal('quote')}) as verbatim
from {p}_quote t join {p}_z_sim on id = cid""",
        f"{p}_rows": f"""select call_id, claim_type, claim_text, turn_index, ord, {clock('start_seconds')} as timestamp, quote,
  case when short then 0.0 else 100.0 end as match_score, case when short then 0.0 else support * 100 end as support_score,
  not short and support >= 0.45 as verified, case when short then 'none' else 'lexical' end as method,
  case when short then {q(fixed.REASON_SHORT)} when support < 0.45 then {q(fixed.REASON_UNSUPPORTED)} else '' end as reason from {p}_final""",
    }
    return out


BLOCKS.update(_similarity("l", "lpairs"))
BLOCKS["lpairs"] = "select call_id * 10 + ord as id, claim_text as x, text as y from cited0"
BLOCKS.update(_quotes("e", "cited"))
BLOCKS.update(_quotes("c", "cited0"))

# Attention
BLOCKS["prior"] = """
select a.call_id, cast(count(b.call_id) as int) as repeat_count from (select c.*, cluster_id from calls c left join clusters using (call_id)) a
left join (select c.*, cluster_id from calls c join clusters using (call_id)) b
  on a.customer_id = b.customer_id and a.cluster_id = b.cluster_id and b.started_at < a.started_at and a.started_at - b.started_at <= interval 30 days
group by 1"""
BLOCKS["att"] = """
select c.call_id, c.resolution_status, duration_seconds, m.med, repeat_count,
  case when c.call_id % 6 <> 5 then (c.call_id % 41) / 20 - 1.2::double end as worst, case when c.call_id % 4 = 1 then (c.call_id % 30) / 20 - 1.0::double end as delta,
  case when c.call_id % 8 = 3 then c.call_id % 5 end as esc,
  case when c.call_id % 17 = 0 and c.resolution_status = 'resolved' then 3 end as con
from calls c join prior using (call_id), (select median(duration_seconds) as med from calls) m"""
BLOCKS["parts"] = """
select *, 0.3::double * case resolution_status when 'unresolved' then 1 when 'partial' then 0.5 when 'resolved' then 0 else 0.5 end as p1,
  case when worst <= -0.2 then 0.2::double * least(abs(worst), 1) else 0 end as p2,
  case when delta < 0 then 0.15::double * least(abs(delta), 1) else 0 end as p3,
  case when esc > 0 then 0.2::double * least(esc / 2, 1) else 0 end as p4,
  case when repeat_count > 0 then 0.1::double * least(repeat_count / 3, 1) else 0 end as p5,
  case when med > 0 and duration_seconds / med > 1.2 then 0.05::double * least((duration_seconds / med - 1.2) / (2.0 - 1.2), 1) else 0 end as p6
from att"""
ORDINAL = "{n} || case when {n} % 100 between 10 and 20 then 'th' when {n} % 10 = 1 then 'st' when {n} % 10 = 2 then 'nd' when {n} % 10 = 3 then 'rd' else 'th' end"
BLOCKS["factors"] = f"""
select call_id, 1 as place, 'issue ' || coalesce(resolution_status, 'unknown') as factor, p1 as weight, 2 as turn from parts where p1 > 0
union all select call_id, 2, {q(fixed.FACTOR_MOOD)}, p2, call_id % 5 from parts where p2 > 0
union all select call_id, 3, {q(fixed.FACTOR_SHIFT)}, p3, call_id % 6 from parts where p3 > 0
union all select call_id, 4, 'escalation language: "supervisor"', p4, call_id % 3 from parts where p4 > 0
union all select call_id, 5, {ORDINAL.format(n='(repeat_count + 1)')} || ' call about this issue', p5, 1 from parts where p5 > 0
union all select call_id, 6, {q(fixed.FACTOR_LONG)}, p6, null from parts where p6 > 0
union all select call_id, 7, {q(fixed.FACTOR_CONTRADICTION)}, 0.2::double, con from parts where con is not null"""
BLOCKS["factors3"] = "select * replace (round_even(weight, 3)::double as weight) from factors"
BLOCKS["score"] = """
select call_id, cast(case when con is not null then least(100, s + 20) else s end as int) as attention_score
from (select *, round_even(least(p1 + p2 + p3 + p4 + p5 + p6, 1) * 100, 0) as s from parts)"""

# Views
BLOCKS["done"] = "select * from calls where analyzed_at is not null"
BLOCKS["base"] = """
select count(*) as call_count, coalesce(avg(case when resolution_status = 'resolved' then 1.0 when resolution_status is null then null else 0.0 end), 0) as resolution_rate,
  coalesce(avg(attention_score), 0) as avg_attention_score, coalesce(avg(duration_seconds), 0) as avg_handle_time_seconds from done"""
BLOCKS["outcomes"] = """
select cluster_id, count(*) as call_count, coalesce(avg(case when resolution_status = 'resolved' then 1.0 when resolution_status is null then null else 0.0 end), 0) as resolution_rate,
  coalesce(avg(attention_score), 0) as avg_attention_score, coalesce(avg(duration_seconds), 0) as avg_handle_time_seconds, label
from done join clusters using (call_id) join issues using (cluster_id) group by cluster_id, label"""
BLOCKS["daily"] = """
select cluster_id, call_date, n as call_count, n / day_total as share
from (select cluster_id, call_date, count(*) as n from done join clusters using (call_id) group by 1, 2)
join (select call_date, count(*) as day_total from done group by 1) using (call_date)"""
BLOCKS["overview"] = """
select a.agent_id, name, count(call_id) as call_count, coalesce(avg(duration_seconds), 0) as avg_handle_time_seconds,
  coalesce(avg(case when resolution_status is null then null when resolution_status = 'resolved' then 1.0 else 0.0 end), 0) as resolution_rate,
  coalesce(avg(attention_score), 0) as avg_attention_score
from agents a left join calls c using (agent_id) group by 1, 2"""
BLOCKS["rates"] = "select agent_id, coalesce(avg(case when resolution_status is null then null when resolution_status = 'resolved' then 1.0 else 0.0 end), 0) as agent_rate from done group by 1"
BLOCKS["breakdown"] = """
select agent_id, cluster_id, label, call_count, res as resolution_rate, res - agent_rate as delta_vs_self
from (select agent_id, cluster_id, label, count(*) as call_count,
    coalesce(avg(case when resolution_status is null then null when resolution_status = 'resolved' then 1.0 else 0.0 end), 0) as res
  from done join clusters using (call_id) join issues using (cluster_id) group by 1, 2, 3 having count(*) >= 8) join rates using (agent_id)"""
BLOCKS["weakest"] = """
select * from (select agent_id, resolution_rate, cluster_id, label, call_count, delta_vs_self from breakdown
  qualify row_number() over (partition by agent_id order by resolution_rate, cluster_id) = 1) where delta_vs_self < -0.10"""
BLOCKS["groups"] = """
select customer_id, cu.name as customer_name, cluster_id, label as issue_label, count(*) as call_count,
  count(*) filter (resolution_status in ('unresolved', 'partial')) as unresolved_count, min(started_at) as first_call_at, max(started_at) as last_call_at,
  round((epoch_us(max(started_at)) - epoch_us(min(started_at))) / 86400000000, 1) as span_days
from calls join clusters using (call_id) join customers cu using (customer_id) join issues using (cluster_id) group by 1, 2, 3, 4 having count(*) >= 3"""
SUM = "call_id, started_at, duration_seconds, intent_label, resolution_status, summary, attention_score"
URGENT = "order by attention_score desc nulls last, started_at desc, call_id"
BLOCKS["comparison"] = """
select o.*, o.resolution_rate - b.resolution_rate as resolution_gap,
  case when b.avg_attention_score > 0 then o.avg_attention_score / b.avg_attention_score - 1 else 0 end as attention_gap,
  o.call_count / (select max(call_count) from outcomes) as relative_volume from outcomes o join base b on true"""

# Vectors
BLOCKS["unit"] = "select vec_id as id, label, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as v from embeddings"
BLOCKS["vpairs"] = "select a.id as src, b.id as dst, list_dot_product(a.v, b.v) as cosine from unit a join unit b on a.id < b.id where list_dot_product(a.v, b.v) >= 0.36"
BLOCKS["sym"] = "select src, dst from vpairs union select dst, src from vpairs"
BLOCKS["reach"] = "select id as node, id as seen from unit union select r.node, s.dst from reach r join sym s on s.src = r.seen"
BLOCKS["clabels"] = "select vec_id as id, label * 3 + vec_id % 3 as cluster_id from embeddings"
BLOCKS["cent"] = """
select cluster_id, list(v order by dim) as c from (
  select cluster_id, dim, avg(x) as v from (select cluster_id, unnest(range(64)) as dim, unnest(embedding)::double as x from embeddings join clabels on vec_id = id) group by 1, 2) group by 1"""
BLOCKS["csym"] = "select a.cluster_id as src, b.cluster_id as dst from cent a join cent b on a.cluster_id <> b.cluster_id where list_cosine_similarity(a.c, b.c) >= 0.16"
BLOCKS["creach"] = "select distinct cluster_id as node, cluster_id as seen from clabels union select r.node, s.dst from creach r join csym s on s.src = r.seen"
BLOCKS["dwords"] = f"""
select doc_id, w as term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as w from documents)
where length(w) > 2 and w not in {strings(fixed.ISSUE_STOP_WORDS)} group by 1, 2"""
BLOCKS["draw"] = """
select doc_id, term, df, tf, tf * ln(((select count(*) from documents) + 1) / (df + 1)) as raw
from dwords join (select term, count(*) as df from dwords group by 1) using (term)"""
BLOCKS["dterms"] = "select doc_id, term, df, tf, raw / sqrt(sum(raw * raw) over (partition by doc_id)) as weight from draw where raw > 0"
BLOCKS["dheads"] = "select min(doc_id) as doc_id from (select doc_id, list((term, tf) order by term) as v from dterms group by 1) group by v"
BLOCKS["ctexts"] = "select doc_id as id, text, case when doc_id % 9 <> 8 then doc_id % 9 end as cluster_id from documents"
BLOCKS["terms"] = f"""
select distinct id, cluster_id, term from (select id, cluster_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from ctexts)
where length(term) > 2 and term not in {strings(fixed.ISSUE_STOP_WORDS)}"""
BLOCKS["tscore"] = """
select cluster_id, term, n, size, n / size >= 0.33 as shared, round(n / size * ln((select count(*) from ctexts) / (1 + df)), 9) as score
from (select cluster_id, term, count(*) as n from terms where cluster_id is not null group by 1, 2)
join (select term, count(*) as df from terms group by 1) using (term)
join (select cluster_id, count(*) as size from ctexts where cluster_id is not null group by 1) using (cluster_id)"""
BLOCKS["named"] = """
select cluster_id, string_agg(term, ' / ' order by r) as label from (
  select cluster_id, term, r from (select *, row_number() over (partition by cluster_id order by score desc, term) as r from tscore where shared) where r <= 3
  union all
  select cluster_id, term, r from (select *, row_number() over (partition by cluster_id order by n desc, term) as r from tscore
    where cluster_id not in (select cluster_id from tscore where shared)) where r <= 3) group by 1"""

# Payloads
BLOCKS["payloads"] = f"""
select doc_id as call_id, doc_id % 6 + 1 as n_turns, {first_words('text', 3)} as label, doc_id % 12 - 2 as iturn, doc_id % 7 as rturn,
  case doc_id % 4 when 0 then 'resolved' when 1 then 'partial' else 'unresolved' end as status, text, doc_id % 5 <> 4 as ok from documents"""
CLAMP = (
    f"case when len({words('text')}) <= 40 then {strip('text')} else "
    f"regexp_replace(array_to_string(list_slice({words('text')}, 1, 40), ' '), '[,;:]+$', '') || '…' end"
)

def sql(final: str) -> str:
    """The blocks a select uses, each after those it uses itself, then the select."""
    needed: list[str] = []

    def add(text: str, own: str | None = None) -> None:
        for name in re.findall(r"(?:from|join)\s+([a-z]\w*)", text):
            if name in BLOCKS and name != own and name not in needed:
                add(BLOCKS[name], name)
                needed.append(name)

    add(final)
    return "with recursive " + ",\n".join(f"{n} as ({BLOCKS[n]})" for n in needed) + "\n" + final if needed else final


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}::double, 6) as {c.strip(chr(34))}" for c in columns)


NUDGED = ", ".join(f"round({c} + 1e-9, 6) as {c}" for c in ("before_mean", "after_mean", "delta"))

FINAL: dict[str, str] = {
    # Sources and upkeep
    "call_metadata": r"""select 'c' || o_orderkey as call_id, coalesce(nullif(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') as customer_id,
  c_name as customer_name, coalesce(nullif(regexp_replace(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') as agent_id,
  o_orderpriority as agent_name, o_orderdate as started_at, cast(o_orderdate as date) as call_date, round(trunc(o_totalprice) / 1000, 6) as duration_seconds,
  c_mktsegment as session, round((o_orderkey % 5)::double, 6) as caller_mos from orders join customer on o_custkey = c_custkey""",
    "multichannel_segments": f"""select call_id, case when turn_index % 5 in (3, 4) then case when speaker = 'agent' then 'agent' else 'customer' end else speaker end as speaker,
  {r6('start_seconds')[:-len('start_seconds')]}start, {r6('end_seconds')[:-len('end_seconds')]}"end", text, cast(len(w) as int) as n_words,
  round(len(w)::double, 6) as confidence, turn_index % 5 = 4 as channel_fallback from turns""",
    "per_channel_segments": f"""select call_id, speaker, round(start_seconds, 6) as start, round(end_seconds, 6) as "end", {strip('text')} as text,
  coalesce(array_to_string(w, '|'), '') as word_texts from turns where turn_index % 4 <> 3 and turn_index % 6 <> 5 and {strip('text')} <> ''""",
    "channel_quality": f"""select call_id, count(*) filter (k and speaker = 'agent') as agent_segments, count(*) filter (k and speaker = 'customer') as customer_segments,
  case when not bool_or(k) then 'error' when count(*) filter (k and speaker = 'agent') = 0 or count(*) filter (k and speaker = 'customer') = 0 then 'warning' else 'ok' end as quality
from (select *, turn_index % 4 <> 3 and turn_index % 6 <> 5 and {strip('text')} <> '' as k from turns) group by 1""",
    "dimension_upsert": """select customer_id, name from (select customer_id, 'order ' || call_id as name from ocalls
  qualify row_number() over (partition by customer_id order by started_at, 'order ' || call_id) = 1) where customer_id not in (select user_id from events)""",
    "call_upsert": """select coalesce(c.call_id, o.call_id) as call_id, case when c.call_id is null then o.customer_id else c.customer_id end as customer_id,
  case when c.call_id is null then o.started_at else c.started_at end as started_at, case when o.call_id is null then transcript_provider else 'gamma' end as transcript_provider,
  coalesce(o.started_at, c.transcribed_at) as transcribed_at, resolution_status, case when o.call_id is null then 'old/' || c.call_id else 'new/' || o.call_id end as audio_path
from calls c full join ocalls o on c.call_id = o.call_id""",
    "turn_replacement": """select call_id, turn_index, speaker, text from turns where call_id not in (select doc_id from labels)
union all select doc_id, cast(quality as int), 'agent', 'toxic ' || toxic from labels""",
    "not_yet_transcribed": """select call_id from ocalls where call_id not in (select call_id from calls where transcribed_at is not null and transcript_provider = 'alpha')""",
    "pending_analysis": "select call_id, transcript_provider from calls where transcribed_at is not null and analyzed_at is null",
    "call_invalidation": """select call_id, case when duration_seconds > 60 then null else intent_label end as intent_label, case when duration_seconds > 60 then null else resolution_status end as resolution_status,
  case when duration_seconds > 60 then null else attention_score end as attention_score, duration_seconds, case when duration_seconds > 60 then null else citations end as citations,
  case when duration_seconds > 60 then null else cluster_id end as cluster_id
from calls left join (select call_id, count(*) as citations from ev group by 1) using (call_id) left join clusters using (call_id)""",
    # Turns
    "turns_split_on_pauses": 'select call_id, segment_no, piece_no, speaker, round(start, 6) as start, round("end", 6) as "end", text, n_words from pieces',
    "turns_merged": f"select call_id, turn_index, speaker, {r6('start_seconds', 'end_seconds')}, text, n_words, overlapping from merged",
    "swapped_calls": "select call_id from swapped",
    "speakers_flipped": """select call_id, turn_index, case when call_id not in (select call_id from swapped) then speaker when speaker = 'agent' then 'customer' else 'agent' end as speaker from turns""",
    "channel_swaps_repaired": """select call_id, case when hit then null else intent_label end as intent_label, case when hit then null else attention_score end as attention_score,
  customer_turns, case when hit then null else citations end as citations, case when hit then null else cluster_id end as cluster_id
from (select *, call_id in (select call_id from swapped) as hit from calls)
left join (select call_id, count(*) filter (where speaker = case when call_id in (select call_id from swapped) then 'agent' else 'customer' end) as customer_turns from turns group by 1) using (call_id)
left join (select call_id, count(*) as citations from ev group by 1) using (call_id) left join clusters using (call_id)""",
    "transcript_lines": "select call_id, turn_index, line from lines",
    "transcripts": "select call_id, cast(turn_index // 3 as int) as part, string_agg(line, chr(10) order by turn_index) as transcript, count(*) as n_turns from lines group by 1, 2",
    "clock_formats": f"""select event_id, {clock('value * 60')} as clock,
  case when value * 60 >= 3600 then printf('%d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60) else printf('%02d:%02d', s // 60, s % 60) end as short_clock,
  s::double as seconds, strftime(ts, '%-d %b %Y, %H:%M') as date_time, strftime(ts, '%-d %b %Y') as date_only from (select *, cast(floor(value * 60) as bigint) as s from events)""",
    "name_slugs": rf"""select conv_id, turn, coalesce(nullif(regexp_replace(regexp_replace(lower({strip("'  ' || text || '! '")}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') as slug from conversations""",
    "turn_at_time": """select a.call_id, round(a.t, 6) as t, b.turn_index from (select call_id, (start_seconds + end_seconds) / 2 + 3 as t from turns) a
join turns b on a.call_id = b.call_id and a.t >= b.start_seconds and a.t < b.end_seconds""",
    # Mood
    "text_valence": f"select call_id, turn_index, {r6('valence')}, mere_decline, {r6('text_score')} from valence2",
    "prosody_features": f"select call_id, turn_index, {r6('words_per_second', 'pause_share')}, measurable from prosody",
    "median_speaking_rates": f"select call_id, {r6('median_rate')} from medians",
    "mood_points": f"select call_id, turn_index, {r6('seconds', 'text_score', 'prosody_score', 'score')}, substantive, citable from points",
    "substantive_turns": "select call_id, turn_index, substantive, citable from flags",
    "escalation_hits": "select call_id, turn_index, phrase_no, phrase from hits",
    "escalation_summary": "select * from hitsum",
    "worst_mood": f"select call_id, {r6('worst_mood')}, worst_mood_turn_index from worst",
    "mood_timeline": f"select call_id, turn_index, {r6('seconds', 'score')}, text from points join (select call_id, turn_index, text from turns) using (call_id, turn_index)",
    # Change points
    "series_smoothed": "select call_id, turn_index, pos, n, round(sm, 6) as smoothed from s_smoothed",
    "series_penalties": "select call_id, round(pen, 6) as penalty from s_lists",
    "series_breaks": "select call_id, break_pos from s_cuts",
    "mood_shifts": f"select call_id, turn_index, {NUDGED} from s_shifts",
    "single_split_shifts": """select call_id, ti[b + 1] as turn_index, round(list_avg(raw[1:b]) + 1e-9, 6) as before_mean, round(list_avg(raw[b + 1:n]) + 1e-9, 6) as after_mean, round(list_avg(raw[b + 1:n]) - list_avg(raw[1:b]) + 1e-9, 6) as delta
from (select *, round(abs(list_avg(xs[b + 1:n]) - list_avg(xs[1:b])), 9) as gap from (select *, unnest(range(2, n - 1)) as b from s_lists where n >= 5))
qualify row_number() over (partition by call_id order by gap desc, b) = 1 and gap >= 0.12""",
    "reportable_shifts": f"""select call_id, turn_index, {NUDGED} from u_shifts join (select call_id, turn_index, citable from series) using (call_id, turn_index)
where delta <= 0 and after_mean <= -0.15 and citable""",
    # Judgments
    "judgments_coerced": f"""select call_id, coalesce(nullif({strip('label')}, ''), 'unclear') as intent_label, cast(greatest(0, least(iturn, n_turns - 1)) as int) as intent_turn_index,
  status as resolution_status, cast(greatest(0, least(rturn, n_turns - 1)) as int) as resolution_turn_index, {CLAMP.replace('{strip', '{strip')} as summary from payloads where ok""",
    "judgment_errors": "select call_id, 'no JSON object found in model output' as error from payloads where not ok",
    "summaries_clamped": f"select doc_id, {CLAMP} as summary from documents",
    "rule_judgments": f"""select call_id, coalesce(nullif({first_words('itext', 5)}, ''), 'unclear') as intent_label, coalesce(i, 0) as intent_turn_index,
  status as resolution_status, l as resolution_turn_index, 'Customer: ' || {first_words('itext', 5)} || '. Outcome: ' || status as summary
from (select *, case when push > coalesce(claim, -1) then 'unresolved' when claim is not null then 'resolved' else 'partial' end as status
  from (select call_id, min(turn_index) filter (speaker = 'customer') as i, min_by(text, turn_index) filter (speaker = 'customer') as itext, max(turn_index) as l,
    max(turn_index) filter (speaker = 'agent' and regexp_matches(text, {q(fixed.AGENT_CLAIM)})) as claim,
    max(turn_index) filter (speaker = 'customer' and regexp_matches(text, {q(fixed.CUSTOMER_PUSHBACK)})) as push from turns group by 1))""",
    "cited_turns": "select call_id, claim_type, turn_index, speaker, text from claims0 join (select call_id, turn_index, speaker, text from turns) using (call_id, turn_index)",
    # Evidence
    "normalised_texts": f"select doc_id, {normal('text')} as normalised from documents",
    "selected_quotes": "select call_id, claim_type, turn_index, claim_text, quote from c_quote",
    "lexical_support": "select call_id, claim_type, round(sim, 6) as support from claims0 join l_sim on id = call_id * 10 + ord",
    "vector_support": """select a.id, round(list_dot_product(a.v, b.v), 6) as cosine, round(greatest(0, least(1, (list_dot_product(a.v, b.v) - 0.3) / 0.7)), 6) as support
from unit a join unit b on a.id = b.id + 1""",
    "quote_length_gate": f"select call_id, turn_index, len({words(normal('text'))}) < 5 as too_short from turns",
    "evidence_built": f"select call_id, claim_type, claim_text, turn_index, timestamp, quote, {r6('match_score', 'support_score')}, verified, method, reason from e_rows",
    "claim_policy": "select claim_type, count(*) as citations, count(*) filter (claim_type not in ('mood_shift', 'attention_factor')) as support_checked from ev group by 1",
    "cited_turn_recovery": """select call_id, min(turn_index) filter (claim_type = 'intent') as intent_turn_index, min(turn_index) filter (claim_type = 'resolution') as resolution_turn_index,
  min(turn_index) filter (claim_type = 'resolution_contradiction_customer') as contradiction_turn_index from ev group by 1""",
    "evidence_coverage": "select call_id, evidence_coverage from cov",
    "corpus_coverage": "select round(avg(case when verified then 1.0 else 0.0 end) * 100, 1) as evidence_coverage_pct from ev",
    "first_evidence": "select call_id, claim_type, turn_index, timestamp, quote, verified from ev qualify row_number() over (partition by call_id, claim_type order by turn_index, ord, timestamp, quote, verified) = 1",
    "contradictions": "select * from contra",
    "resolved_contradictions": "select * from rcontra",
    # Attention
    "attention_scores": """select call_id, attention_score, cast(count(factor) as int) as n_factors, coalesce(string_agg(factor, '|' order by weight desc, place), '') as names,
  coalesce(string_agg(cast(cast(round(weight * 1000) as int) as varchar), '|' order by weight desc, place), '') as weights,
  coalesce(string_agg(coalesce(cast(turn as varchar), '-'), '|' order by weight desc, place) filter (factor is not null), '') as turns,
  case when attention_score >= 75 then 'critical' when attention_score >= 50 then 'flagged' else 'low' end as band
from score left join factors3 using (call_id) group by 1, 2""",
    "attention_parts": "select call_id, round(p1, 6) as resolution, round(p2, 6) as mood, round(p3, 6) as shift, round(p4, 6) as escalation, round(p5, 6) as repeat, round(p6, 6) as handle_time from parts",
    "ordinals": f"select o_orderkey, {ORDINAL.format(n='o_orderkey')} as ordinal from orders",
    "median_handle_time": "select round(median(duration_seconds), 6) as median_duration from calls",
    "rescore_report": """select count(*) as calls, (select count(*) from factors) as factors, (select count(*) from factors where turn is not null) as factors_cited,
  count(*) filter (s.attention_score is distinct from c.attention_score) as scores_changed from score s join calls c using (call_id)""",
    # Repeat contact
    "repeats_same_cluster": "select call_id, repeat_count from prior",
    "repeats_same_cluster_orders": """select a.call_id, cast(count(b.call_id) as int) as repeat_count from ocalls a left join ocalls b on a.customer_id = b.customer_id and a.cluster_id = b.cluster_id
  and b.started_at < a.started_at and a.started_at - b.started_at <= interval 30 days group by 1""",
    "repeats_same_intent": "select a.call_id, cast(count(b.call_id) as int) as repeat_count from calls a left join calls b on a.customer_id = b.customer_id and a.intent_label = b.intent_label and b.started_at < a.started_at group by 1",
    "repeats_same_intent_orders": "select a.call_id, cast(count(b.call_id) as int) as repeat_count from ocalls a left join ocalls b on a.customer_id = b.customer_id and a.intent_label = b.intent_label and b.started_at < a.started_at group by 1",
    "repeat_groups": f"select customer_id, customer_name, cluster_id, issue_label, call_count, unresolved_count, first_call_at, last_call_at, {r6('span_days')} from groups order by call_count desc, unresolved_count desc, customer_id, cluster_id limit 50",
    "repeat_group_members": f"""select customer_id, cluster_id, {SUM}, evidence_coverage from calls join clusters using (call_id) left join cov using (call_id)
where (customer_id, cluster_id) in (select (customer_id, cluster_id) from groups)""",
    "unresolved_groups": "select count(*) filter (unresolved_count > 0) as unresolved_groups from groups",
    # Issues
    "issue_texts": "select call_id, coalesce(intent_label, '') || '. ' || coalesce(summary, '') as text from done",
    "min_cluster_sizes": "select count(*) as n, cast(greatest(5, round_even(count(*) * 0.015, 0)) as int) as min_size from documents",
    "text_vectors": "select doc_id, term, df, round(weight, 6) as weight from dterms",
    "similar_texts": """select a.doc_id as src, b.doc_id as dst, round(sum(a.weight * b.weight), 6) as cosine
from (select * from dterms semi join dheads using (doc_id)) a join (select * from dterms semi join dheads using (doc_id)) b on a.term = b.term and a.doc_id < b.doc_id
group by 1, 2 having sum(a.weight * b.weight) >= 0.8""",
    "similar_vector_pairs": "select src, dst, round(cosine, 6) as cosine from vpairs",
    "vector_components": "select node as id, min(seen) as component from reach group by 1",
    "similar_clusters_merged": "select id, m as cluster_id from clabels join (select node, min(seen) as m from creach group by 1) on node = cluster_id",
    "cluster_names": "select cluster_id, label from named",
    "cluster_report": """select count(distinct cluster_id) as clusters, count(*) as calls, round(count(*) filter (cluster_id is null) / count(*), 6) as noise_ratio,
  count(*) filter (cluster_id is null) / count(*) > 0.3 as too_noisy from ctexts""",
    "cluster_sizes": "select cluster_id, count(*) as size, any_value(label) as label from ctexts join named using (cluster_id) group by 1",
    # Views
    "customer_list": "select customer_id, name, count(call_id) as call_count, max(started_at) as last_contact from customers left join calls using (customer_id) group by 1, 2",
    "customer_search": "select customer_id, name from customers where contains(lower(name), 'mer#00000001')",
    "customer_history": f"select {SUM}, evidence_coverage from calls left join cov using (call_id) where customer_id = 17",
    "call_turns": f"select call_id, turn_index, speaker, {r6('start_seconds')}, text, cast(len(w) as int) as n_words, round(score, 6) as mood_score from turns left join (select call_id, turn_index, score from points) using (call_id, turn_index)",
    "days": "select call_date, count(*) as call_count from calls group by 1",
    "latest_day": "select max(call_date) as call_date from calls",
    "attention_queue": f"select t.*, evidence_coverage from (select {SUM} from calls where call_date = (select max(call_date) from calls) {URGENT} limit 100) t left join cov using (call_id)",
    "overview_counters": """select *, case when critical_count > 0 then 'critical' when flagged_count > 0 then 'warning' else 'good' end as attention_tone,
  case when evidence_coverage_pct is null then 'neutral' when evidence_coverage_pct >= 85 then 'good' when evidence_coverage_pct >= 70 then 'warning' else 'critical' end as coverage_tone
from (select count(*) filter (attention_score >= 75) as critical_count, count(*) filter (attention_score >= 50) as flagged_count, coalesce(max(attention_score), 0) as top_score,
  (select round(avg(case when verified then 1.0 else 0.0 end) * 100, 1) from ev) as evidence_coverage_pct from calls where call_date = (select max(call_date) from calls))""",
    "corpus_baseline": f"select call_count, {r6('resolution_rate', 'avg_attention_score', 'avg_handle_time_seconds')} from base",
    "issue_outcomes": f"select cluster_id, call_count, {r6('resolution_rate', 'avg_attention_score', 'avg_handle_time_seconds')}, label from outcomes",
    "issue_days": f"select cluster_id, call_date, call_count, {r6('share')} from daily",
    "issue_day_maps": "select cluster_id, string_agg(call_date || '=' || call_count, ',' order by call_date) as counts_by_day, cast(count(*) as int) as n_days from daily group by 1",
    "cluster_calls": f"select t.*, evidence_coverage from (select {SUM} from calls join clusters using (call_id) where cluster_id = 'error' {URGENT} limit 200) t left join cov using (call_id)",
    "agent_overview": f"select agent_id, name, call_count, {r6('avg_handle_time_seconds', 'resolution_rate', 'avg_attention_score')} from overview",
    "agent_issues": f"select agent_id, cluster_id, label, call_count, {r6('resolution_rate', 'delta_vs_self')} from breakdown",
    "weakest_issues": f"select agent_id, {r6('resolution_rate')}, cluster_id, label, call_count, {r6('delta_vs_self')} from weakest",
    "agent_rates": f"select agent_id, {r6('agent_rate')} from rates",
    "agent_calls": f"select t.*, evidence_coverage from (select {SUM} from calls join clusters using (call_id) where cluster_id = 'view' and agent_id = 7 {URGENT} limit 200) t left join cov using (call_id)",
    "coaching_list": f"select agent_id, {r6('resolution_rate')}, cluster_id, label, call_count, {r6('delta_vs_self')}, name from weakest join agents using (agent_id) order by weakest.delta_vs_self, agent_id limit 4",
    "issue_comparison": f"select cluster_id, call_count, label, {r6('resolution_rate', 'avg_attention_score', 'avg_handle_time_seconds', 'resolution_gap', 'attention_gap', 'relative_volume')} from comparison",
    "underperforming_issues": f"select cluster_id, call_count, label, {r6('resolution_rate', 'avg_attention_score', 'avg_handle_time_seconds', 'resolution_gap', 'attention_gap', 'relative_volume')} from comparison c where c.resolution_gap < -0.001",
    "top_issues": f"""select cluster_id, call_count, label, {r6('resolution_rate', 'avg_attention_score', 'avg_handle_time_seconds', 'resolution_gap', 'attention_gap', 'relative_volume')}, c.resolution_gap < -0.001 as underperforming
from comparison c order by c.resolution_gap < -0.001 desc, call_count desc, cluster_id limit 4""",
    "day_strip": "select cluster_id, call_date, round(share, 6) as share, round(share / greatest(max(share) over (partition by cluster_id), 0.001), 6) as relative_share from daily",
    "top_agents": f"select agent_id, name, call_count, {r6('avg_handle_time_seconds', 'resolution_rate', 'avg_attention_score')} from overview order by call_count desc, agent_id limit 5",
    # Quality
    "claim_coverage": """select count(*) as analysed, count(intent_label) as intents, count(resolution_status) as resolutions, count(mood_shift_turn_index) as shifts,
  (select count(distinct call_id) from ev where claim_type = 'intent' and verified) as verified_intents from done""",
    "word_error_rates": f"""select doc_id as call_id, cast(n as int) as reference_words, cast(n - k as int) as edits, round((n - k) / nullif(n, 0), 6) as wer
from (select doc_id, len({words('text')}) as n, len(list_filter({words('text')}, lambda x: length(x) > 3)) as k from documents)""",
    "word_error_summary": f"""select count(*) as calls, round(avg((n - k) / nullif(n, 0)), 6) as mean_wer, round(sum(n - k) / sum(n), 6) as corpus_wer
from (select call_id, sum(len(w)) as n, sum(len(list_filter(w, lambda x: length(x) > 3))) as k from turns group by 1)""",
    "batch_outcome": "select case when ok then 'ok' else 'failed' end as outcome, count(*) as calls from payloads group by 1",
}

# Citations of factors
BLOCKS["fparts"] = """
select j.call_id, resolution_status, resolution_turn_index, worst_mood, worst_mood_turn_index, escalation_count, escalation_turn_index, escalation_phrase,
  0.3::double * case resolution_status when 'unresolved' then 1 when 'partial' then 0.5 else 0 end as p1,
  case when worst_mood <= -0.2 then 0.2::double * least(abs(worst_mood), 1) else 0 end as p2,
  case when escalation_count > 0 then 0.2::double * least(escalation_count / 2, 1) else 0 end as p4
from judged j left join worst using (call_id) left join hitsum using (call_id)"""
BLOCKS["ffactors"] = f"""
select call_id, 1 as k, 'issue ' || resolution_status as factor, round_even(p1, 3)::double as weight, resolution_turn_index as turn_index, 'resolution status: ' || resolution_status as detail from fparts where p1 > 0
union all select call_id, 2, {q(fixed.FACTOR_MOOD)}, round_even(p2, 3)::double, worst_mood_turn_index, printf('worst mood score %.2f', worst_mood) from fparts where p2 > 0
union all select call_id, 3, 'escalation language: "' || escalation_phrase || '"', round_even(p4, 3)::double, escalation_turn_index, printf('%d escalation phrase(s)', escalation_count) from fparts where p4 > 0"""
BLOCKS["fplaced"] = "select *, row_number() over (partition by call_id order by weight desc, k) - 1 as place from ffactors"
BLOCKS["fmissing"] = """
select call_id, 'attention_factor' as claim_type, factor as claim_text, turn_index, 5 as ord from (
  select * from fplaced where turn_index is not null and (call_id, turn_index) not in (select (call_id, turn_index) from claims))
qualify row_number() over (partition by call_id, turn_index order by place) = 1"""
BLOCKS["fcited"] = "select c.*, text, start_seconds from fmissing c join turns using (call_id, turn_index)"
BLOCKS.update(_quotes("f", "fcited"))
BLOCKS["fevidence"] = """
select call_id, turn_index, ord, claim_text, timestamp, quote, verified from e_rows
union all select call_id, turn_index, ord, claim_text, timestamp, quote, match_score = 100 from f_rows"""
BLOCKS["ffirst"] = "select * from fevidence qualify row_number() over (partition by call_id, turn_index order by ord, claim_text) = 1"
BLOCKS["fscore"] = "select call_id, cast(round_even(least(p1 + p2 + p4, 1) * 100, 0) as int) as attention_score from fparts"
FINAL["factors_cited"] = """select call_id, attention_score, cast(place as int) as place, factor, round(weight, 6) as weight, f.turn_index, detail, quote, timestamp, verified
from fplaced f join fscore using (call_id) left join (select call_id as ec, turn_index as et, quote, timestamp, verified from ffirst) on ec = f.call_id and et = f.turn_index"""

# Rechecks
BLOCKS["stored"] = f"""
select call_id, turn_index, text, case when call_id % 10 = 9 then turn_index + 100 else turn_index end as cited, turn_index % 2 = 0 as stored,
  case when turn_index % 3 = 0 then 'mood_shift' else 'intent' end as claim_type,
  case turn_index % 4 when 2 then 'quite other words were said here ' || {first_words('text', 2)} when 3 then {first_words('text', 3)} else {first_words('lower(text)', 12)} end as quote from turns"""
BLOCKS["recheck"] = f"""
select call_id, claim_type, cited as turn_index, quote, stored, call_id % 10 = 9 as orphaned,
  len({words(normal('quote'))}) >= 5 and contains({normal('text')}, {normal('quote')}) as ok,
  case when len({words(normal('quote'))}) < 5 then {q(fixed.REASON_SHORT)} when not contains({normal('text')}, {normal('quote')}) then {q(fixed.REASON_ABSENT)} else '' end as why from stored"""
FINAL["citation_recheck"] = "select call_id, claim_type, turn_index, quote, stored, orphaned, case when not orphaned then ok end as verified, case when not orphaned then why end as reason from recheck"
FINAL["citation_pass_rates"] = """select claim_type, count(*) as total, count(*) filter (ok) as passed, round(count(*) filter (ok) / count(*), 6) as pass_rate from recheck where not orphaned group by rollup (claim_type)"""
FINAL["citation_rejections"] = "select why as reason, count(*) as n from recheck where not orphaned and not ok group by 1"
FINAL["citation_first_failures"] = "select call_id, claim_type, turn_index, why as reason from recheck where not orphaned and not ok order by call_id, claim_type, turn_index limit 5"
FINAL["stored_against_recomputed"] = "select count(*) filter (stored) as stored_verified, count(*) filter (not orphaned and ok) as recomputed_verified, count(*) filter (orphaned) as orphaned from recheck"
BLOCKS["jcited"] = """
select * from cited0
union all select call_id, 'intent', intent_label, resolution_turn_index, 7, text, start_seconds from judged j join turns t using (call_id) where t.turn_index = j.resolution_turn_index"""
BLOCKS.update(_quotes("j", "jcited"))
BLOCKS["jrates"] = f"""
select 'first' as judge, (select count(*) from judged) as calls, (select count(*) filter (verified) from j_rows where ord = 0) as i,
  (select avg(len({words('summary')})) from judged) as summary_words, cast(0 as bigint) as errors
union all select 'second', (select count(*) from judged), (select count(*) filter (verified) from j_rows where ord = 7), 2, (select count(*) filter (call_id % 7 = 0) from judged)"""
BLOCKS["jrated"] = """
select judge, calls, i / calls as intent_rate, (select count(*) filter (verified) from j_rows where ord = 1) / calls as resolution_rate, summary_words, errors from jrates"""
FINAL["judge_comparison"] = """select judge, calls, round(intent_rate, 6) as intent_rate, round(resolution_rate, 6) as resolution_rate, round(summary_words, 6) as summary_words, errors,
  round((intent_rate + resolution_rate) / 2, 6) as overall, round(max((intent_rate + resolution_rate) / 2) over () - (intent_rate + resolution_rate) / 2, 6) as behind_best from jrated"""

_first = lambda kind, column: f"(min_by({column}, (turn_index, ord, timestamp, quote, verified)) filter (claim_type = '{kind}'))"
FINAL["call_details"] = f"""select {SUM}, cu.name as customer_name, a.name as agent_name, mood_shift_turn_index, evidence_coverage, intent_quote, resolution_quote, mood_shift_cited,
  case when agent_quote is not null then customer_quote end as pushback_quote
from calls join customers cu using (customer_id) join agents a using (agent_id) left join cov using (call_id)
left join (select call_id, {_first('intent', 'quote')} as intent_quote, {_first('resolution', 'quote')} as resolution_quote, {_first('mood_shift', 'turn_index')} as mood_shift_cited,
  {_first('resolution_contradiction_agent', 'quote')} as agent_quote, {_first('resolution_contradiction_customer', 'quote')} as customer_quote from ev group by 1) using (call_id)"""

FINAL["call_detail_factors"] = """select c.call_id, cu.name as customer_name, a.name as agent_name, evidence_coverage, cast(place as int) as place, factor, round(weight, 6) as weight, quote, timestamp, verified
from (select distinct call_id, call_id % 13 + 1 as customer_id, call_id % 7 + 1 as agent_id from turns) c
join customers cu using (customer_id) join agents a using (agent_id)
left join (select call_id, round(avg(case when verified then 1.0 else 0.0 end) * 100, 1) as evidence_coverage from fevidence group by 1) v on v.call_id = c.call_id
left join (select f.call_id as fc, place, factor, weight, quote, timestamp, verified from fplaced f left join
  (select call_id as ec, turn_index as et, quote, timestamp, verified from ffirst) on ec = f.call_id and et = f.turn_index) g on fc = c.call_id"""

ORACLE: dict[str, str] = {name: sql(final) for name, final in FINAL.items()}

ORACLE["clusters_refreshed"] = ORACLE["cluster_sizes"]
ORACLE["transcripts_stored"] = """
select 'p' || (turn % 3) as provider, count(*) as turns, sum(length(text)) as characters from conversations where turn % 3 <> 1 or conv_id % 2 = 0 group by 1"""
ORACLE["newest_runs"] = """
select doc_id as call_id, case when doc_id % 7 = 0 then 3 when doc_id % 3 = 0 then 2 else 1 end as run_id,
  n_chars + case when doc_id % 7 = 0 then 2 when doc_id % 3 = 0 then 1 else 0 end as n_chars
from documents where doc_id % 7 <> 0 or doc_id % 2 = 0"""
ORACLE["failures_split"] = """
select doc_id as call_id, case when quality is distinct from 0 then n_chars end as n_chars, case when quality = 0 then 'unusable' end as error
from documents left join labels using (doc_id)"""
ORACLE["live_day_counts"] = "select cast(ts as date) as call_date, count(*) as call_count from events where ts is not null group by 1"
