"""DuckDB SQL for the queries that it can state in reasonable time: ``name -> SQL``.

The others hash, learn, encode or follow a curve; ``tests/llm`` has plain versions of them.
"""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def components(nodes: str, links: str) -> str:
    """``comp(node, component)`` over ``links(a, b)`` in both directions."""
    return f"""reach as (
  select node, node as other from {nodes} union
  select r.node, l.b from reach r join {links} l on l.a = r.other),
comp as (select node, min(other) as component from reach group by node)"""


TERMS = r"regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


SQL = {
    "op3_vector_dedup": f"""with recursive v as materialized (
  select vec_id, label, e, sqrt(list_dot_product(e, e)) as n from (
    select vec_id, label, embedding::double[] as e from embeddings
    where label is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
  where list_dot_product(e, e) > 0),
links as materialized (
  select a.vec_id as a, b.vec_id as b from v a join v b
    on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
nodes as (select vec_id as node from embeddings),
{components("nodes", "links")}
select vec_id, (select count(*) from links where a = vec_id) as n_links, component as component_id,
  vec_id = component as kept
from embeddings join comp on node = vec_id""",

    "op4_quality_cascade": rf"""with d as (
  select doc_id, coalesce(text, '') as text, {WORDS} as ws from documents),
l as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
lines as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from l
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
windows as (select doc_id, i, array_to_string(ws[i : i + 7], ' ') as w
  from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from d where len(ws) >= 8)),
again as (select doc_id, i from windows qualify count(*) over (partition by doc_id, w) > 1),
repeated as (select doc_id, count(distinct p) as n_repeat_words
  from (select doc_id, unnest(range(i, i + 8)) as p from again) group by doc_id),
counts as (
  select doc_id, len(ws) as n_words, len(array_to_string(ws, '')) as word_chars,
    len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_lines, 0) as n_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words,
    len(regexp_replace(text, '[^A-Z]', '', 'g')) as n_upper,
    len(regexp_replace(text, '[^A-Za-z\x{{C0}}-\x{{10FFFF}}]', '', 'g')) as n_letters,
    len(regexp_replace(text, '[^!]', '', 'g')) as n_shouts,
    len(list_filter(ws, lambda w: regexp_matches(w, '[A-Za-z\x{{C0}}-\x{{10FFFF}}]'))) as n_lettered,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) as n_stutters
  from d left join lines using (doc_id) left join repeated using (doc_id)),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or word_chars < 3 * n_words or word_chars > 10 * n_words
    or 10 * n_dup_lines > 3 * n_lines or 2 * n_upper > n_letters or 2 * n_shouts > n_words
    or 10 * n_lettered < 8 * n_words or 10 * n_stutters > 3 * n_words) as kept
from judged""",

    "op6_minhash": f"""with recursive d as (
  select doc_id, list_transform({WORDS}, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz')) as ws from documents),
s as materialized (
  select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as shingle from (
    select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) as i from d)),
sizes as materialized (select doc_id, count(*) as n from s group by doc_id),
same as (select a.doc_id as a, b.doc_id as b, count(*) as n
  from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
half as (select a, b from same join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * same.n >= 85 * (x.n + y.n - same.n)),
links as materialized (select a, b from half union all select b, a from half),
nodes as (select doc_id as node from documents),
{components("nodes", "links")}
select d.doc_id, coalesce(n, 0) as n_shingles, component as component_id, d.doc_id = component as kept
from d join comp on node = d.doc_id left join sizes on sizes.doc_id = d.doc_id""",

    "op7_warc": """with p as (
  select page_id, coalesce(html, '') as body, octet_length(encode(coalesce(html, ''))) as n from pages),
m as (select *, min(page_id) over (partition by body) as first from p)
select page_id, n::bigint as payload_bytes, sha256(body) as payload_digest,
  case when n >= 100 and first <> page_id then 'revisit' else 'response' end as record_type,
  case when n >= 100 and first <> page_id then first end as refers_to
from m""",

    "op8_chat": r"""with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t as (select *, len(role) + len(text)
    + len(regexp_replace(role || text, '[^\\<\[]', '', 'g')) + len('<|start|><|message|><|end|>') as n from c),
a as (select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    coalesce(string_agg(text, '' order by turn nulls first, text) filter (role = 'assistant'), '') as loss,
    sum(n)::bigint as formatted_chars from t group by conv_id)
select conv_id, n_turns, turns_sha256, len(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars
from a""",

    "op13_fill_in_middle": """with d as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || doc_id) as h from documents),
h as (select doc_id, text, length(text)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
    ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
      or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
o as (select *, substring(text, 1, low) as p, substring(text, low + 1, high - low) as m, substring(text, high + 1) as s
  from c)
select doc_id, n, form, case when form <> 'plain' then low end as prefix_chars,
  case when form <> 'plain' then high - low end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
    else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from o""",

    "op11_reversed_search": f"""with t as materialized (
  select doc_id, {LOWERED.format("unnest(" + TERMS + ")")} as term from documents),
d as materialized (select doc_id, count(*) as n from t group by doc_id),
c as (select count(*) as docs, sum(n)::bigint as terms from d),
i as materialized (select distinct item_id, {LOWERED.format("unnest(" + TERMS + ")")} as term from benchmark),
f as materialized (select doc_id, term, count(*) as tf from t where term in (select term from i) group by all),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w
  from (select term, count(*) as df from f group by term), c),
s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::bigint
    as score from i join f using (term) join w using (term) join d using (doc_id), c group by all),
r as (select *, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10""",
}
