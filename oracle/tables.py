"""Common table expressions that several oracle queries start from."""

from __future__ import annotations

from tonewright.functions import patterns as P
from tonewright.functions import wording as W
from tonewright.functions.lexicon import CATEGORIES
from tonewright.functions.wording import REASON
from tonewright.sources.tables import HEADLINES

from .expressions import *  # noqa: F403

HEADLINE_SQL = HEADLINES.replace("as string", "as varchar").replace("{orders}", "orders")
LABEL = "case dir when 'up' then 'positive' when 'down' then 'negative' else 'neutral' end"

CORPUS = """corpus as (
  select doc_id, text as sentence,
    case when doc_id % 7 = 0 then 'negative' when doc_id % 7 < 3 then 'positive'
         else 'neutral' end as label
  from documents)"""

LINES = """lines as (
  select doc_id, unnest(range(0, len(parts)))::int as position, unnest(parts) as value
  from (select doc_id, string_split(text, chr(10)) as parts from documents))"""

LABELLED = """labelled as (
  select doc_id, text, case when toxic = 1 then 0 when quality = 1 then 2 else 1 end as label
  from documents join labels using (doc_id))"""


def h() -> str:
    return f"h as materialized ({HEADLINE_SQL})"


def gaps() -> str:
    return f"""h as materialized (
  select doc_id, grp, dir, case when doc_id % 11 = 0 then null
    when doc_id % 13 = 0 then ' ' || chr(9) || ' ' else text end as text
  from ({HEADLINE_SQL}))"""


def features(source: str, name: str = "f", negations: bool = True) -> str:
    """Chain of CTEs ending in ``name``: all text features of ``source(text)``."""
    ratio = "case when {b} = 0 then 0e0 else ({a})::double / ({b}) end"
    score = ratio.format(a="pos - neg", b="pos + neg")
    flipped = f"case when ngt > 0 then ({score}) * -0.5e0 + 0e0 else ({score}) end"
    return f"""
{name}_clean as (select *, {clean_financial('text')} as cleaned from {source}),
{name}_norm as (select *, {normalize('cleaned')} as normalized from {name}_clean),
{name}_tok as (select *, {tokens('normalized')} as toks from {name}_norm),
{name}_wrd as (select *, {words('toks')} as wrds from {name}_tok),
{name}_hit as (select *,
  {only('wrds', LEX.positive)} as positive_words,
  {only('wrds', LEX.negative)} as negative_words,
  {only('wrds', LEX.uncertainty)} as uncertainty_words,
  {size(only('wrds', LEX.litigious))} as lit,
  {size(only('wrds', P.NEGATION_WORDS))} as ngt,
  {matches('text', P.PERCENT)} as percentages,
  {matches('text', P.CURRENCY, True)} as currencies,
  {matches('text', P.NUMBER, True)} as numbers,
  {matches('text', P.COMPANY, True)} as companies,
  len(toks)::int as word_count, length(cleaned)::int as char_count,
  greatest(1, {size(matches('cleaned', P.SENTENCE_END))}) as sentence_count,
  case when len(toks) = 0 then 0e0
       else list_sum(list_transform(toks, lambda t: length(t)))::double / len(toks) end as avg_word_length,
  (length(text) - length(replace(text, '!', '')))::int as exclamation_count,
  (length(text) - length(replace(text, '?', '')))::int as question_count
  from {name}_wrd),
{name}_num as (select *, len(positive_words)::int as pos, len(negative_words)::int as neg,
  len(uncertainty_words)::int as unc from {name}_hit),
{name}_scr as (select *, ngt > 0 as has_negation,
  {flipped if negations else score} as score,
  least(1e0, {ratio.format(a='unc', b='word_count')} * 5) as uncertainty_score,
  least(1e0, {ratio.format(a='pos + neg + unc', b='word_count')} * 3) as subjectivity_score
  from {name}_num),
{name} as (select *,
  case when score > 0.2e0 then 'positive' when score < -0.2e0 then 'negative' else 'neutral' end as category,
  greatest(0.1e0, least(1e0, 0.5e0 + abs(score) * 0.3e0 - uncertainty_score * 0.3e0
    - least(0.2e0, ngt * 0.1e0))) as confidence
  from {name}_scr)"""


def explanation() -> str:
    shown = f"'(score: ' || {fixed('score', 2)} || ')'"

    def three(title: str, x: str) -> str:
        return f"case when len({x}) > 0 then '{title}' || array_to_string({x}[1:3], ', ') end"

    return f"""concat_ws(' | ',
    case when score > 0.3e0 then 'Strong positive sentiment ' || {shown}
         when score > 0 then 'Mildly positive sentiment ' || {shown}
         when score < -0.3e0 then 'Strong negative sentiment ' || {shown}
         when score < 0 then 'Mildly negative sentiment ' || {shown}
         else 'Neutral sentiment' end,
    {three('Positive indicators: ', 'positive_words')},
    {three('Negative indicators: ', 'negative_words')},
    case when uncertainty_score > 0.3e0 then 'High uncertainty language detected' end,
    case when uncertainty_score > 0.3e0 then {three('Uncertainty words: ', 'uncertainty_words')} end,
    case when has_negation then 'Contains ' || ngt || ' negation(s) - may flip sentiment' end,
    {three('Contains percentages: ', 'percentages')},
    {three('Contains currency amounts: ', 'currencies')})"""


def predicted() -> str:
    """``p(doc_id, grp, dir, text, label, prediction, confidence)`` of the headlines."""
    return f"""{h()}, {features('h')},
p as materialized (select doc_id, grp, dir, text, {encode(LABEL)} as label,
  {encode('category')} as prediction, category, confidence from f)"""


def class_rates(source: str, name: str, by: str = "") -> str:
    """``name(by..., class, support, predicted, correct, precision, recall, f1)``."""
    b = f"{by}, " if by else ""
    return f"""
{name}_sum as (
  select {b}class, sum(support)::bigint as support, sum(predicted)::bigint as predicted,
    sum(correct)::bigint as correct
  from (select {b}label as class, 1 as support, 0 as predicted,
          case when label = prediction then 1 else 0 end as correct from {source}
        union all select {b}prediction, 0, 1, 0 from {source})
  group by {b}class),
{name}_pr as (select *, case when predicted = 0 then 0e0 else correct::double / predicted end as precision,
  case when support = 0 then 0e0 else correct::double / support end as recall from {name}_sum),
{name} as (select *, case when precision + recall = 0 then 0e0
  else 2 * precision * recall / (precision + recall) end as f1 from {name}_pr)"""


SUMMARY = ", ".join(
    ["sum(correct)::double / sum(support) as accuracy"]
    + [
        part.format(m=m)
        for m in ("f1", "precision", "recall")
        for part in ("avg({m}) as {m}_macro", "sum({m} * support)::double / sum(support) as {m}_weighted")
    ]
)


def tfidf(source: str, name: str = "w", top: int = 10_000) -> str:
    """``name(doc_id, term, tf, tfidf)`` with ``name_stats`` and ``name_vocab``."""
    return f"""
{name}_tf as materialized (
  select doc_id, term, count(*) as tf
  from (select doc_id, unnest({with_pairs('t')}) as term
    from (select doc_id, {single_terms('text')} as t from {source})) group by all),
{name}_stats as materialized (
  select term, count(*) as df, sum(tf)::bigint as cf from {name}_tf group by term),
{name}_n as (select count(*) as n from {source}),
{name}_vocab as materialized (
  select term, df, cf, ln((n + 1)::double / (df + 1)) + 1 as idf
  from {name}_stats, {name}_n where df >= 2 and df <= 0.95e0 * n
  order by cf desc, term limit {top}),
{name}_raw as (select doc_id, term, tf, tf * idf as x from {name}_tf join {name}_vocab using (term)),
{name} as materialized (
  select doc_id, term, tf, x / sqrt(sum(x * x) over (partition by doc_id)) as tfidf
  from {name}_raw)"""


def bayes(weights: str, labels: str) -> str:
    """``nb(term, lp0, lp1, lp2)``."""
    sums = ", ".join(f"sum(case when label = {c} then tfidf else 0e0 end) as s{c}" for c in range(3))
    logs = ", ".join(
        f"ln((s{c} + 0.1e0) / (t{c} + terms * 0.1e0)) as lp{c}" for c in range(3)
    )
    totals = ", ".join(f"sum(s{c}) as t{c}" for c in range(3))
    return f"""
nb_s as materialized (
  select term, {sums} from {weights} join (select doc_id, label from {labels}) using (doc_id) group by term),
nb_t as (select count(*) as terms, {totals} from nb_s),
nb as materialized (select term, {logs} from nb_s, nb_t),
coefs as materialized (
  select term, lp0 - (lp0 + lp1 + lp2) / 3 as coef_neg, lp1 - (lp0 + lp1 + lp2) / 3 as coef_neu,
    lp2 - (lp0 + lp1 + lp2) / 3 as coef_pos from nb)"""


def headline_weights() -> str:
    return f"{h()}, {tfidf('h')}"


def headline_coefs() -> str:
    return (
        f"{headline_weights()}, hl as (select doc_id, {encode(LABEL)} as label from h), "
        f"{bayes('w', 'hl')}"
    )


def importance() -> str:
    """``imp(doc_id, word, score, direction)`` and ``top20`` of the headlines."""
    first = "string_split(lower(term), ' ')[1]"
    return f"""{headline_coefs()},
imp as materialized (select doc_id, term as word,
  tfidf * greatest(abs(coef_neg), abs(coef_neu), abs(coef_pos)) as score,
  case when {first} in {sql_list(LEX.positive)} then 'positive'
       when {first} in {sql_list(LEX.negative)} then 'negative'
       when abs(coef_pos) >= abs(coef_neg) and abs(coef_pos) >= abs(coef_neu) then 'positive'
       when abs(coef_neg) >= abs(coef_neu) then 'negative' else 'neutral' end as direction
  from w join coefs using (term)),
top20 as materialized (select * from (
  select *, row_number() over (partition by doc_id order by round(score, 6) desc, word)::int as rank
  from imp) where rank <= 20)"""


def explained() -> str:
    """``e``: headlines with their top words, lexicon words and first five of each direction."""
    def ranked(direction: str) -> str:
        return f"list_filter(items, lambda x: x.direction = '{direction}')"

    def extended(direction: str) -> str:
        known = f"list_transform({ranked(direction)}, lambda x: x.word)"
        extra = f"list_filter(lex_{direction}, lambda v: not list_contains({known}, v))"
        return f"list_concat({known}, {extra})[1:5]", f"greatest(0, least(5 - len({known}), len({extra})))::int"

    positive, positive_added = extended("positive")
    negative, negative_added = extended("negative")
    return f"""{importance()}, {features('h')},
lists as (select doc_id, list({{'word': word, 'direction': direction}} order by rank) as items
  from top20 group by doc_id),
base as (select f.doc_id, f.text, f.category, f.confidence, coalesce(items, []) as items,
    {words(tokens('text'))} as ws from f left join lists using (doc_id)),
lexed as (select *, {only('ws', LEX.positive)} as lex_positive,
  {only('ws', LEX.negative)} as lex_negative, {only('ws', LEX.uncertainty)} as lex_uncertainty from base),
e as (select *, {positive} as positive_words, {positive_added} as positive_added,
  {negative} as negative_words, {negative_added} as negative_added,
  list_transform({ranked('neutral')}, lambda x: x.word)[1:5] as neutral_words from lexed)"""


def reasoning(source: str, fallback: bool = False, model: bool = False) -> str:
    """CTEs ending in ``r``: every step of the reasoning over ``source(text)``."""
    lists = P.FALLBACK_WORDS if fallback else {c: LEX.terms(c) for c in CATEGORIES}
    topic = " ".join(f"when {present('low', ws)} then {q(name)}" for name, ws in P.TOPICS)
    weighed = "(base + model_confidence) / 2" if model else "base"
    boosted = (
        """case when lower(model_label) = reasoned then least(0.99e0, damped * 1.1e0)
                else damped * 0.85e0 end"""
        if model else "damped"
    )
    label = "lower(model_label)" if model else "reasoned"

    def first(x: str, n: int) -> str:
        return quoted_list(f"{x}[1:{n}]")

    seen_model = (
        fill(REASON["calibrate_seen_model"], base=fixed("base", 2), model=fixed("model_confidence", 2))
        if model else fill(REASON["calibrate_seen"], base=fixed("base", 2))
    )
    told_model = " || " + fill(REASON["final_model"], model="model_label") if model else ""
    up = "list_filter(percents, lambda p: not starts_with(p, '-'))"
    down = "list_filter(percents, lambda p: starts_with(p, '-'))"
    return f"""
r1 as (select *, lower(text) as low, {tokens('text')} as rt from {source}),
r2 as (select *, {words('rt')} as rw from r1),
r3 as (select *, case {topic} else {q(P.OTHER_TOPIC)} end as topic,
  len(rt)::int as nw, greatest(1, {size(matches('text', P.SENTENCE_END))}) as ns,
  {matches('text', P.PERCENT)} as percents, {matches('text', P.STEP_CURRENCY)} as amounts,
  {matches('text', P.STEP_COMPANY)} as comps,
  {only('rw', lists['positive'])} as rp, {only('rw', lists['negative'])} as rn,
  {only('rw', lists['uncertainty'])} as ru,
  {found('low', P.STEP_NEGATIONS)} as negs, {found('low', P.STEP_COMPARISONS)} as cmps,
  {present('low', P.STEP_FUTURE)} as fut from r2),
r4 as (select *, len(rp) as np, len(rn) as nn, len(ru) as nu,
  len(percents) + len(amounts) + len(comps) as ents from r3),
r5 as (select *,
  case when nw > 50 then 'high' when nw > 20 then 'medium' else 'low' end as complexity,
  case when ents > 3 then 'high' when ents > 0 then 'medium' else 'low' end as density,
  case when np > nn * 1.5e0 then 'positive' when nn > np * 1.5e0 then 'negative'
       when np > nn then 'slightly positive' when nn > np then 'slightly negative'
       else 'neutral/balanced' end as dominant,
  case when abs(np - nn) > 2 then 0.8e0 else 0.6e0 end as clarity,
  case when len(negs) > 0 then 'high' when len(cmps) > 0 or fut then 'medium' else 'low' end as impact,
  least(1e0, nw / 30e0) as lenf from r4),
r6 as (select *, ((0.9e0 + 0.85e0 + clarity + 0.75e0) / 4e0 + lenf + clarity) / 3e0
  - case when impact = 'high' then 0.1e0 else 0e0 end as base from r5),
r7 as (select *, greatest(0.1e0, least(0.99e0, {weighed})) as calibrated,
  case when contains(dominant, 'positive') then case when impact = 'high' then 'negative' else 'positive' end
       when contains(dominant, 'negative') then case when impact = 'high' then 'positive' else 'negative' end
       else 'neutral' end as reasoned from r6),
r8 as (select *, case when impact = 'high' then calibrated * 0.8e0 else calibrated end as damped from r7),
r9 as (select *, {boosted} as final_confidence, {label} as final_sentiment,
  case dominant
    when 'positive' then {fill(REASON['signal_positive'], list=first('rp', 3))}
    when 'negative' then {fill(REASON['signal_negative'], list=first('rn', 3))}
    when 'slightly positive' then {fill(REASON['signal_slightly_positive'], list=first('rp', 2))}
    when 'slightly negative' then {fill(REASON['signal_slightly_negative'], list=first('rn', 2))}
    else {q(REASON['signal_balanced'])} end
  || case when nu > 2 then {fill(REASON['signal_uncertain'], list=first('ru', 2))} else '' end as finding,
  concat_ws('. ',
    case when len(negs) > 0 then {fill(REASON['context_negation'], list=first('negs', 2))} end,
    case when len(cmps) > 0 then {q(REASON['context_comparison'])} end,
    case when fut then {q(REASON['context_forward'])} end) as note0 from r8),
r10 as (select *, case when note0 = '' then {q(REASON['context_plain'])} else note0 end as note from r9),
r as (select *,
  {fill(REASON['topic_seen'], words='nw', sentences='ns', topic='topic')} as o1,
  {fill(REASON['topic_why'], topic='topic', length="case when nw > 30 then 'detailed' else 'brief' end")} as w1,
  {fill(REASON['topic_end'], topic='topic', complexity='complexity')} as c1,
  {fill(REASON['entity_seen'], total='ents', percents='len(percents)', amounts='len(amounts)')} as o2,
  case when len(percents) > 0 then {fill(REASON['entity_list'], all=quoted_list('percents'))}
    || case when len({down}) > 0 then {fill(REASON['entity_down'], down=quoted_list(down))} else '' end
    || case when len({up}) > 0 then {fill(REASON['entity_up'], up=quoted_list(up))} else '' end
    else {q(REASON['entity_none'])} end as w2,
  {fill(REASON['entity_end'], density='density')} as c2,
  {fill(REASON['signal_seen'], pos='np', neg='nn', unc='nu')} as o3, finding as w3,
  {fill(REASON['signal_end'], dominant='dominant')} as c3,
  {fill(REASON['context_seen'], negations='len(negs)', comparisons='len(cmps)',
        focus=f"case when fut then {q(REASON['context_future'])} else {q(REASON['context_present'])} end")} as o4,
  note as w4, {fill(REASON['context_end'], impact='impact')} as c4,
  {seen_model} as o5,
  {fill(REASON['calibrate_why'], length=fixed('lenf', 2), clarity=fixed('clarity', 2),
        penalty="case when impact = 'high' then '0.10' else '0.00' end")} as w5,
  case when calibrated > 0.8e0 then {fill(REASON['calibrate_high'], conf=fixed('calibrated', 2))}
       when calibrated > 0.6e0 then {fill(REASON['calibrate_moderate'], conf=fixed('calibrated', 2))}
       else {fill(REASON['calibrate_low'], conf=fixed('calibrated', 2))} end as c5,
  {q(REASON['final_seen'])} as o6,
  {fill(REASON['final_why'], label='final_sentiment', context=fill(REASON['context_end'], impact='impact'))}{told_model} as w6,
  {fill(REASON['final_end'], label_upper='upper(final_sentiment)', conf=percent('final_confidence'))} as c6,
  {fill(REASON['explain'], label_upper='upper(final_sentiment)', conf=percent('final_confidence'), finding='finding')}
    || case when impact = 'high' then {fill(REASON['explain_context'], note='note')} else '' end as reasoning,
  list_filter([{q(REASON['factor_numbers'])},
    case when dominant = 'positive' then {q('Positive indicators: ')} || {first('rp', 3)}[2:-2] end,
    case when dominant = 'negative' then {q('Negative indicators: ')} || {first('rn', 3)}[2:-2] end,
    {q(REASON['factor_negation'])}, case when fut then {q(REASON['factor_future'])} end,
    case when final_confidence > 0.85e0 then {q(REASON['factor_clear'])}
         when final_confidence < 0.5e0 then {q(REASON['factor_mixed'])} end],
    lambda k: k is not null)[1:5] as key_factors
  from r10)"""


def trace() -> str:
    titles = [s.replace("_", " ").title() for s in W.STEPS]
    blocks = [
        fill(W.TRACE_STEP, number=str(i), title=q(t), observation=f"o{i}", reasoning=f"w{i}",
             conclusion=f"c{i}")
        for i, t in enumerate(titles, 1)
    ]
    return " || chr(10) || ".join(blocks)


def mix(source: str, by: str, label: str = "category") -> str:
    """``m``: label counts, percents and mean confidence per ``by``."""
    return f"""
m0 as (select {by}, count(*) as total, count(*) filter ({label} = 'positive') as pos,
  count(*) filter ({label} = 'neutral') as neu, count(*) filter ({label} = 'negative') as neg,
  count(*) filter ({label} = 'error') as err, avg(confidence) as avg_confidence
  from {source} group by {by}),
m as (select *, pos::double / total * 100 as pos_pct, neu::double / total * 100 as neu_pct,
  neg::double / total * 100 as neg_pct from m0)"""


def mix_columns(by: str) -> str:
    return f"""{by}, total, pos, neu, neg, err, {r6('avg_confidence')} as avg_confidence,
  {r6('pos_pct')} as pos_pct, {r6('neu_pct')} as neu_pct, {r6('neg_pct')} as neg_pct"""
