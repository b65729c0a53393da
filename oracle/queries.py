"""``name -> DuckDB SQL`` for every catalogue query that SQL can state."""

from __future__ import annotations

from tonewright.functions import wording as W
from tonewright.functions.lexicon import CATEGORIES
from tonewright.functions.wording import EXPLAIN, REASON
from tonewright.operators.metrics import METRICS
from tonewright.plans.catalog import BROKEN_QUOTES, MODEL_OF_DIRECTION, MODEL_OF_GROUP
from tonewright.sources.metrics_store import MODELS

from .expressions import *  # noqa: F403
from .tables import *  # noqa: F403

SQL: dict[str, str] = {}
H = h()  # noqa: F405


def add(name: str, body: str, *ctes: str) -> None:
    SQL[name] = (f"with {', '.join(ctes)} " if ctes else "") + body


# --- sources ------------------------------------------------------------------------------------
add("read_labelled_text", f"""
select doc_id, regexp_extract(v, '(?s)^(.*)@([^@]*)$', 1) as sentence,
  regexp_extract(v, '(?s)^(.*)@([^@]*)$', 2) as label
from (select doc_id, {strip("case when dir = 'new' then text else text || '@' || " + LABEL + " end")} as v from h)
where contains(v, '@')""", H)
add("read_texts", f"""select * from (select doc_id, position, {strip('value')} as text from lines)
where text <> ''""", LINES)
add("read_texts_any_encoding", "select doc_id, grp as file, text from h", H)
add("read_csv_texts", "select doc_id, text from documents where text is not null")
add("detect_text_columns", """select 'text' as column_name, count(text) as n from documents
union all select 'lang', count(lang) from documents
union all select 'source', count(source) from documents""")

# --- cleaning -----------------------------------------------------------------------------------
add("clean_text", f"select doc_id, {clean_text('text')} as cleaned from documents")
add("clean_text_headlines", f"select doc_id, {clean_text('text')} as cleaned from h", H)
FIRST = "row_number() over (partition by sentence order by doc_id) = 1"
add("drop_duplicate_sentences", f"select * from corpus qualify {FIRST}", CORPUS)
add("drop_empty", f"select doc_id, grp, dir, text from h where {strip('text')} <> ''", gaps())
MIXED = f"case when dir = 'new' then dir else {LABEL} end"
add("encode_label", f"select doc_id, {MIXED} as name, {encode(MIXED)} as label from h", H)
add("decode_label", f"""select o_orderkey as doc_id, {decode('o_orderkey % 4')} as label
from orders""")
add("preprocess", f"""select doc_id, {clean_text('sentence')} as sentence, {encode('label')} as label
from (select * from corpus qualify {FIRST}) where {strip('sentence')} <> ''""", CORPUS)
add("preview_text", f"""select doc_id, {preview('text', 100)} as preview_100,
  {preview('text', 200)} as preview_200 from documents""")
add("clean_financial_text",
    f"select doc_id, {clean_financial('text || ' + q(BROKEN_QUOTES))} as cleaned from h", H)
add("clean_financial_documents", f"select doc_id, {clean_financial('text')} as cleaned from documents")
CLEANED = f"c as (select doc_id, {clean_financial('text')} as cleaned from h)"
add("normalize_numbers", f"select doc_id, {normalize('cleaned')} as normalized from c", H, CLEANED)
add("processor_options", f"""select doc_id, {normalize('cleaned', lower=False)} as keep_case,
  {normalize('cleaned', punctuation=True)} as no_punctuation,
  {normalize('cleaned', numbers=False)} as keep_numbers from c""", H, CLEANED)
add("tokenize", f"""select doc_id, {joined(tokens('text'))} as tokens,
  {size(tokens('text'))} as n_tokens from documents""")
add("lexical_words", f"select doc_id, {joined(words(tokens('text')))} as words from h", H)

# --- look-up joins ------------------------------------------------------------------------------
LEX_TABLE = "lex as (select * from (values " + ", ".join(
    f"({q(c)}, {q(t)})" for c in CATEGORIES for t in LEX.terms(c)) + ") v(category, term))"


def exploded(source: str) -> str:
    ws = words(tokens(normalize(clean_financial("text"))))
    return f"""wl as (select doc_id, {ws} as ws from {source}),
words as (select doc_id, unnest(range(0, len(ws)))::int as position, unnest(ws) as term from wl),
hits as (select * from words join lex using (term))"""


HITS = "select term, doc_id, position, category from hits"
add("lexicon_match", HITS, H, LEX_TABLE, exploded("h"))
add("lexicon_match_documents", HITS, LEX_TABLE, exploded("documents"))
add("lexicon_counts", "select doc_id, " + ", ".join(
    f"(count(*) filter (category = '{c}'))::int as {c}_word_count" for c in CATEGORIES)
    + " from hits group by doc_id", H, LEX_TABLE, exploded("h"))
add("lexicon_word_lists", "select doc_id, " + ", ".join(
    f"coalesce(string_agg(term, ' ' order by position) filter (category = '{c}'), '') as {c}_words"
    for c in CATEGORIES[:3]) + " from hits group by doc_id", H, LEX_TABLE, exploded("h"))
add("coef_lookup", "select doc_id, term, " + ", ".join(
    f"{r6(c)} as {c}" for c in ("tfidf", "coef_neg", "coef_neu", "coef_pos"))
    + " from w join coefs using (term)", headline_coefs())
add("append_unseen_lexicon_words", f"""select doc_id, {joined('positive_words')} as positive_words,
  {joined('negative_words')} as negative_words, positive_added, negative_added from e""", explained())


def renamed(column: str, names: dict[str, str]) -> str:
    return pick(column, {k: q(v) for k, v in names.items()}, column)


NAMED = f"pn as (select *, {renamed('grp', MODEL_OF_GROUP)} as name from p)"
GROUP_METRICS = f"""{predicted()}, {NAMED}, {class_rates('pn', 'cr', 'name')},
gm as (select name, {SUMMARY} from cr group by name)"""
REGISTRY = "reg as (select * from (values " + ", ".join(
    "(" + ", ".join(q(x) for x in row[:-1]) + ", " + q("|".join(row[-1])) + ")" for row in MODELS
) + ") v(model, name, type, accuracy, f1_macro, f1_weighted, speed, features))"
add("model_info", f"""select n.model, coalesce(reg.name, n.model) as name,
  coalesce(type, 'Unknown') as type, coalesce({percent('gm.accuracy')}, reg.accuracy, 'N/A') as accuracy,
  coalesce({fixed('gm.f1_macro', 3)}, reg.f1_macro, 'N/A') as f1_macro,
  coalesce({fixed('gm.f1_weighted', 3)}, reg.f1_weighted, 'N/A') as f1_weighted,
  coalesce(speed, 'N/A') as speed, coalesce(features, '') as features
from (select {renamed('grp', MODEL_OF_GROUP)} as model from h
      union select {renamed('dir', MODEL_OF_DIRECTION)} from h) n
left join reg on reg.model = n.model left join gm on gm.name = n.model""", GROUP_METRICS, REGISTRY)
F_ = f"{H}, {features('h')}"
add("attach_predictions", f"""select doc_id, grp, dir, text, category as predicted_label,
  {encode('category')} as predicted_class, {r6('confidence')} as confidence from f""", F_)

# --- corpus description and split -----------------------------------------------------------------
add("label_distribution", f"""select label, count(*) as n,
  {r6('count(*) * 100e0 / sum(count(*)) over ()')} as pct from corpus group by label""", CORPUS)
add("corpus_quality_report", f"""select count(*) as n_rows,
  (count(*) - count(distinct value))::bigint as n_duplicates,
  (count(*) filter ({strip('value')} = ''))::bigint as n_blank,
  (count(*) filter (label not in ('negative', 'neutral', 'positive')))::bigint as n_unexpected_labels,
  (select string_agg(distinct label, ',' order by label) from ql where label <> 'unsure') as labels_seen,
  (select count(distinct label) = 3 from ql) as labels_as_expected from ql""", LINES, """ql as (
  select *, case when doc_id % 7 = 0 then 'negative' when doc_id % 7 < 3 then 'positive'
    when doc_id % 7 = 6 then 'unsure' else 'neutral' end as label from lines)""")
add("length_by_label", f"""select label, {r6('avg(' + size(tokens('sentence')) + ')')} as avg_words
from corpus group by label""", CORPUS)
add("length_histogram", f"""select label,
  least(29, floor((n_words - lo) * 30 / (hi - lo)))::int as bin, count(*)::bigint as n from (
  select label, n_words,
    case when min(n_words) over l = max(n_words) over l then min(n_words) over l - 0.5e0
      else min(n_words) over l * 1e0 end as lo,
    case when min(n_words) over l = max(n_words) over l then max(n_words) over l + 0.5e0
      else max(n_words) over l * 1e0 end as hi
  from (select label, {size(tokens('sentence'))} as n_words from corpus)
  window l as (partition by label)) group by all""", CORPUS)
add("class_weights", f"""select label, count(*) as n,
  {r6('sum(count(*)) over ()::double / (count(*) over () * count(*))')} as weight
from corpus group by label""", CORPUS)
FOUND = f"found as (select distinct case when dir in ('new', 'flat') then dir else {LABEL} end as label from h)"
add("label_set_check", """select label, 'unexpected' as problem from found
  where label not in ('negative', 'neutral', 'positive')
union all select label, 'missing' from (values ('negative'), ('neutral'), ('positive')) v(label)
  where label not in (select label from found)""", H, FOUND)


def split(source: str) -> str:
    return f"""sp as (select *, case when rn <= size * 80 // 100 then 'train'
    when rn <= size * 90 // 100 then 'val' else 'test' end as split from (
  select *, row_number() over (partition by label order by md5(doc_id || ':42'), doc_id) as rn,
    count(*) over (partition by label) as size from {source}))"""


CODED = f"coded as (select doc_id, sentence, {encode('label')} as label from corpus)"
add("stratified_split_exact", "select doc_id, label, split from sp", CORPUS, CODED, split("coded"))
add("stratified_split_headlines", "select doc_id, label, split from sp", H,
    f"hl as (select doc_id, {encode(LABEL)} as label from h)", split("hl"))
add("split_overlap", "select sentence, " + ", ".join(
    f"max((split = '{s}')::int) as \"{s}\"" for s in ("train", "val", "test"))
    + " from sp group by sentence having count(distinct split) > 1", CORPUS, CODED, split("coded"))


# --- aggregate sentiment and outlook ----------------------------------------------------------------
def aggregate(by: str) -> str:
    return f"""select {by + ',' if by else ''} total_texts, null_texts, {r6('m')} as average_sentiment_score,
  {r6('s')} as sentiment_std, positive_count, negative_count, neutral_count,
  case when positive_count > negative_count * 1.5e0 then 'bullish'
       when negative_count > positive_count * 1.5e0 then 'bearish' else 'mixed' end as overall_trend,
  {r6('positive_count::double / total_texts')} as positive_ratio,
  {r6('negative_count::double / total_texts')} as negative_ratio,
  {r6('neutral_count::double / total_texts')} as neutral_ratio
from (select {by + ',' if by else ''} count(score) as total_texts,
  count(*) - count(score) as null_texts, avg(score) as m, stddev_pop(score) as s,
  count(*) filter (category = 'positive') as positive_count,
  count(*) filter (category = 'negative') as negative_count,
  count(*) filter (category = 'neutral') as neutral_count from f {'group by ' + by if by else ''})"""


add("aggregate_sentiment", aggregate("grp"), F_)
add("aggregate_sentiment_overall", aggregate(""), F_)
add("aggregate_sentiment_with_gaps", aggregate("grp"), gaps(), features("h", "f0").strip(), """f as (
  select * replace (case when text is not null then score end as score,
    case when text is not null then category end as category) from f0)""")
SCORED = f"""{gaps()}, {features('h')},
s as (select doc_id, grp, case when text is null or {strip('text')} = '' then 'error' else category end as label,
  case when text is null or {strip('text')} = '' then 0e0 else confidence end as confidence from f)"""
add("score_or_error", f"select doc_id, grp, label, {r6('confidence')} as confidence from s", SCORED)
add("batch_summary", f"""select {mix_columns('grp')},
  case when greatest(pos, neu, neg, err) = err then 'Error' when greatest(pos, neu, neg) = neg then 'Negative'
       when greatest(pos, neu) = neu then 'Neutral' else 'Positive' end as dominant,
  case when pos_pct > neg_pct + 10 then 'Bullish' when neg_pct > pos_pct + 10 then 'Bearish'
       else 'Mixed / Sideways' end as trend from m""", SCORED, mix("s", "grp", "label"))


def points(by: str) -> str:
    head = fill(
        W.OUTLOOK_HEAD, icon=pick("overall", {k: q(v) for k, v in W.OUTLOOK_ICONS.items()}),
        overall="overall", overall_upper="upper(overall)", total="total", pos="pos", neu="neu",
        neg="neg", pos_pct=fixed("pos_pct", 1), neu_pct=fixed("neu_pct", 1), neg_pct=fixed("neg_pct", 1),
    )
    sure = {k: fill(v, conf=percent("avg_confidence")) for k, v in W.OUTLOOK_CONFIDENCE.items()}
    tone = {k: fill(v, ratio=fixed("pos::double / neg", 1)) for k, v in W.OUTLOOK_RATIO.items()}
    advice = {k: q(v) for k, v in W.OUTLOOK_ADVICE.items()}
    return f"""select {mix_columns(by)}, overall, {head}
  || case when pos_pct > 50 then {q(W.OUTLOOK_MAJORITY['positive'])}
          when neg_pct > 50 then {q(W.OUTLOOK_MAJORITY['negative'])}
          when neu_pct > 50 then {q(W.OUTLOOK_MAJORITY['neutral'])} else '' end
  || case when avg_confidence > 0.8e0 then {sure['high']} when avg_confidence < 0.6e0 then {sure['low']}
          else {sure['moderate']} end
  || case when pos = 0 or neg = 0 then '' when pos::double / neg > 2 then {tone['optimistic']}
          when pos::double / neg < 0.5e0 then {tone['pessimistic']} else {tone['balanced']} end
  || {q(W.OUTLOOK_ADVICE_TITLE)}
  || case when overall = 'bullish' then {advice['bullish']} when overall = 'bearish' then {advice['bearish']}
          when starts_with(overall, 'cautiously') then {advice['cautious']} else {advice['mixed']} end
  || {q(W.OUTLOOK_NOTE)} as report
from (select *, case when pos_pct > neg_pct + 15 then 'bullish' when neg_pct > pos_pct + 15 then 'bearish'
  when pos_pct > neg_pct + 5 then 'cautiously optimistic'
  when neg_pct > pos_pct + 5 then 'cautiously pessimistic' else 'mixed/neutral' end as overall from m)"""


def graded(by: str) -> str:
    shown = pick("trend", {k: q(v[0]) for k, v in W.GRADED_TRENDS.items()})
    icon = pick("trend", {k: q(v[1]) for k, v in W.GRADED_TRENDS.items()})
    balance = {
        k: fill(v, pos_pct=fixed("pos_pct", 1), neg_pct=fixed("neg_pct", 1)) if "{" in v else q(v)
        for k, v in W.GRADED_MIX.items()
    }
    sure = {k: fill(v, conf=percent("avg_confidence")) for k, v in W.GRADED_CONFIDENCE.items()}
    return f"""select {mix_columns(by)}, trend, trend_description, icon,
  {fill(W.GRADED_HEAD, trend='trend_description', trend_lower='lower(trend_description)', total='total')}
  || case when pos_pct > 60 then {balance['positive']} when neg_pct > 60 then {balance['negative']}
          when pos_pct > neg_pct + 10 then {balance['more_positive']}
          when neg_pct > pos_pct + 10 then {balance['more_negative']} else {balance['balanced']} end
  || case when avg_confidence > 0.8e0 then {sure['high']} when avg_confidence < 0.6e0 then {sure['low']}
          else '' end
  || case when pos > 0 and neg > 0 then {fill(W.GRADED_RATIO, ratio=fixed('pos::double / neg', 2))} else '' end
  || {q(W.GRADED_ADVICE_TITLE)}
  || case when contains(trend, 'bullish') then {q(W.GRADED_ADVICE['bullish'])}
          when contains(trend, 'bearish') then {q(W.GRADED_ADVICE['bearish'])}
          else {q(W.GRADED_ADVICE['other'])} end
  || {q(W.GRADED_NOTE)} as narrative
from (select *, {shown} as trend_description, {icon} as icon from (
  select *, case when pos > neg * 2 then 'strongly_bullish' when pos > neg * 1.5e0 then 'bullish'
    when neg > pos * 2 then 'strongly_bearish' when neg > pos * 1.5e0 then 'bearish'
    when pos > neg then 'cautiously_optimistic' when neg > pos then 'cautiously_pessimistic'
    else 'neutral' end as trend from m))"""


for _suffix, _by in (("", "grp"), ("_by_direction", "dir")):
    add("market_outlook" + _suffix, points(_by), F_, mix("f", _by))
    add("market_outlook_graded" + _suffix, graded(_by), F_, mix("f", _by))

# --- evaluation -------------------------------------------------------------------------------------
P_ = predicted()
METRIC_COLUMNS = ", ".join(f"{r6(m)} as {m}" for m in METRICS)
add("confusion_matrix", """select t::int as truth, q::int as prediction,
  (select count(*) from p where label = t and prediction = q) as n
from (select unnest(range(3)) as t), (select unnest(range(3)) as q)""", P_)
add("classification_metrics", f"select {METRIC_COLUMNS} from (select {SUMMARY} from cr)",
    P_, class_rates("p", "cr"))
add("classification_metrics_by_group",
    f"select grp, {METRIC_COLUMNS} from (select grp, {SUMMARY} from cr group by grp)",
    P_, class_rates("p", "cr", "grp"))
add("classification_report", f"""select name, {r6('precision')} as precision, {r6('recall')} as recall,
  {r6('f1')} as f1, support::bigint as support from (
  select {decode('class')} as name, precision, recall, f1, support from cr
  union all select 'accuracy', null, null, sum(correct)::double / sum(support), sum(support) from cr
  union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from cr
  union all select 'weighted avg', sum(precision * support)::double / sum(support),
    sum(recall * support)::double / sum(support), sum(f1 * support)::double / sum(support), sum(support)
  from cr)""", P_, class_rates("p", "cr"))
add("error_analysis", f"""select count(*) as n_samples,
  (count(*) filter (label <> prediction))::bigint as total_errors,
  {r6('(count(*) filter (label <> prediction))::double / count(*)')} as error_rate,
  concat_ws('; ',
    case when count(*) filter (label = 1 and prediction <> 1) > 0 then 'Neutral class is often confused with positive/negative' end,
    case when count(*) filter (label = 2 and prediction = 1) > 0 then 'Some positive texts lack strong positive indicators' end,
    case when count(*) filter (label = 0 and prediction = 1) > 0 then 'Some negative texts have subtle negative sentiment' end) as insights
from p""", P_)
add("error_patterns", f"""select {decode('label')} || '_as_' || {decode('prediction')} as pattern,
  count(*) as n from p where label <> prediction group by all""", P_)
add("error_samples", f"""select doc_id, text, {preview('text', 80)} as shown,
  {decode('label')} as true_label, {decode('prediction')} as pred_label
from p where label <> prediction order by doc_id limit 10""", P_)
add("leaderboard", f"""select name, {METRIC_COLUMNS},
  row_number() over (order by f1_macro desc, name)::int as rank from gm""", GROUP_METRICS)
add("best_model", f"select name, {r6('f1_macro')} as f1_macro from gm order by gm.f1_macro desc, name limit 1",
    GROUP_METRICS)
add("union_results", f"""select name, {METRIC_COLUMNS} from (select * from gm
  union all select 'six_step_reasoning', * from (select {SUMMARY} from rcr))""", GROUP_METRICS,
    reasoning("h"), f"""rp_ as (select {encode(LABEL)} as label, {encode('final_sentiment')} as prediction from r)""",
    class_rates("rp_", "rcr"))

# --- text features ------------------------------------------------------------------------------------
for _name, _pattern, _fold, _source in (
    ("extract_percentages", P.PERCENT, False, "h"),
    ("extract_currencies", P.CURRENCY, True, "h"),
    ("extract_numbers", P.NUMBER, True, "h"),
    ("extract_companies", P.COMPANY, True, "h"),
    ("extract_companies_strict", P.COMPANY, False, "h"),
    ("extract_fiscal_terms", P.FISCAL, True, "h"),
    ("extract_dates", P.DATE, True, "h"),
    ("extract_percentages_documents", P.PERCENT, False, "documents"),
    ("extract_currencies_documents", P.CURRENCY, True, "documents"),
    ("extract_numbers_documents", P.NUMBER, True, "documents"),
    ("extract_companies_documents", P.COMPANY, True, "documents"),
):
    _found = matches("text", _pattern, _fold)
    add(_name, f"select doc_id, {joined(_found)} as found, {size(_found)} as n from {_source}",
        *([H] if _source == "h" else []))
DOC_F = features("documents")
add("size_stats", f"""select doc_id, word_count, char_count, sentence_count,
  {r6('avg_word_length')} as avg_word_length from f""", F_)
add("size_stats_documents", f"""select doc_id, word_count, char_count, sentence_count,
  {r6('avg_word_length')} as avg_word_length, neg as negative_word_count from f""", DOC_F)
add("lexicon_features", f"""select doc_id, pos as positive_word_count, neg as negative_word_count,
  unc as uncertainty_word_count, lit as litigious_word_count, {joined('positive_words')} as positive_words,
  {joined('negative_words')} as negative_words, {joined('uncertainty_words')} as uncertainty_words from f""", F_)
add("sentiment_score", f"select doc_id, {r6('score')} as score from f", H, features("h", negations=False))
add("negation_flip", f"""select doc_id, has_negation, ngt as negation_count, {r6('score')} as score
from f""", F_)
add("uncertainty_score", f"select doc_id, {r6('uncertainty_score')} as score from f", F_)
add("subjectivity_score", f"select doc_id, {r6('subjectivity_score')} as score from f", F_)
add("punctuation_counts", """select doc_id, (length(text) - length(replace(text, '!', '')))::int as exclamations,
  (length(text) - length(replace(text, '?', '')))::int as questions from documents""")
add("sentiment_category", "select doc_id, category from f", F_)
add("lexicon_confidence", f"select doc_id, {r6('confidence')} as confidence from f", F_)
add("feature_explanation", f"select doc_id, {explanation()} as explanation from f", F_)
add("list_caps", f"""select doc_id, {joined('numbers[1:10]')} as numbers,
  {joined('companies[1:10]')} as companies, {joined('negative_words[1:10]')} as negative_words from f""", DOC_F)
add("analyze", f"""select doc_id, cleaned as cleaned_text, category, {r6('score')} as score,
  {r6('confidence')} as confidence, {explanation()} as explanation, word_count, char_count, sentence_count,
  pos as positive_word_count, neg as negative_word_count, unc as uncertainty_word_count,
  lit as litigious_word_count, {r6('avg_word_length')} as avg_word_length,
  {joined('positive_words[1:10]')} as positive_words, {joined('negative_words[1:10]')} as negative_words,
  {joined('uncertainty_words[1:10]')} as uncertainty_words, {joined('numbers[1:10]')} as numbers,
  {joined('percentages')} as percentages, {joined('currencies')} as currencies,
  {joined('companies')} as companies, {r6('uncertainty_score')} as uncertainty_score,
  {r6('subjectivity_score')} as subjectivity_score, has_negation, ngt as negation_count,
  exclamation_count, question_count from f""", F_)
SQL["analyze_stream"] = SQL["analyze"]
add("get_lexicon_sentiment", f"""select doc_id, pos as positive_count, neg as negative_count,
  unc as uncertainty_count, {r6('score')} as sentiment_score, {joined('positive_words')} as positive_words,
  {joined('negative_words')} as negative_words, {joined('uncertainty_words')} as uncertainty_words from f""", F_)


# --- probabilities --------------------------------------------------------------------------------------
def vector(first: int) -> list[str]:
    return [f"scores[{i}]" for i in range(first + 1, first + 4)]


def score_rows(width: int) -> str:
    items = ", ".join(f"embedding[(part * {width} + {i}) % len(embedding) + 1]::double" for i in range(width))
    return f"""e as (select vec_id, part, [{items}] as scores from (
  select vec_id, embedding, unnest(range(0, ceil(len(embedding) / {width}e0)::int))::int as part from embeddings))"""


def probabilities(items: list[str], names=("p0", "p1", "p2")) -> str:
    return ", ".join(f"{x} as {n}" for x, n in zip(softmax(items), names))


NAMES = ["p0", "p1", "p2"]
SOFT = f"{score_rows(3)}, s as (select vec_id, part, {probabilities(vector(0))} from e)"
add("softmax", "select vec_id, part, " + ", ".join(f"{r6(p)} as {p}" for p in NAMES) + " from s", SOFT)
add("argmax_label", f"""select vec_id, part, {argmax(NAMES)}::int as prediction, {decode(argmax(NAMES))} as label,
  {r6('greatest(p0, p1, p2)')} as confidence from s""", SOFT)
add("reorder_probabilities", f"""select vec_id, part, {r6('p1')} as negative, {r6('p2')} as neutral,
  {r6('p0')} as positive from s""", SOFT)
add("prediction_record", f"""select doc_id, {preview('text', 100)} as shown, {argmax(NAMES)}::int as prediction,
  {decode(argmax(NAMES))} as label, {r6('greatest(p0, p1, p2)')} as confidence, {r6('p0')} as negative,
  {r6('p1')} as neutral, {r6('p2')} as positive from s""", F_,
    f"s as (select doc_id, text, {probabilities(['neg * 1e0', '0.5e0', 'pos * 1e0'])} from f)")
_members = [softmax(vector(i)) for i in (0, 3, 6)]
_mean = ", ".join(f"({' + '.join(m[c] for m in _members)}) / 3 as p{c}" for c in range(3))
add("soft_vote", "select vec_id, part, " + ", ".join(f"{r6(p)} as {p}" for p in NAMES)
    + f", {argmax(NAMES)}::int as prediction, {r6('greatest(p0, p1, p2)')} as confidence from s",
    f"{score_rows(9)}, s as (select vec_id, part, {_mean} from e)")
_counts = [f"(length(text) - length(replace(text, '{c}', ''))) / 4e0" for c in "aeo"]
_class = ["p1", "p2", "p0"]  # external order positive, negative, neutral
add("score_external", f"""select doc_id, {argmax(_class)}::int as prediction, {decode(argmax(_class))} as label,
  {r6('greatest(p0, p1, p2)')} as confidence, {r6('p1')} as negative, {r6('p2')} as neutral,
  {r6('p0')} as positive from s""", H, f"s as (select doc_id, {probabilities(_counts)} from h)")
_kept = "array_to_string(t[1:128], ' ')"
_letters = [f"(length({_kept}) - length(replace({_kept}, '{c}', ''))) / 16e0" for c in "aeo"]
add("score_external_tokens", f"""select doc_id, case when n > 0 then n end as n_tokens,
  case when n > 0 then n > 128 end as truncated, case when n > 0 then {argmax(_class)}::int end as prediction,
  case when n > 0 then {decode(argmax(_class))} else 'error' end as label,
  case when n > 0 then {r6('greatest(p0, p1, p2)')} else 0e0 end as confidence from s""",
    f"l as (select doc_id, coalesce({tokens('text')}, []) as t from documents)",
    f"s as (select doc_id, len(t)::int as n, {probabilities(_letters)} from l)")

# --- TF-IDF and naive Bayes -------------------------------------------------------------------------------
add("tokens_1_2gram", f"""select doc_id, {joined(with_pairs('t'))} as terms,
  {size(with_pairs('t'))} as n_terms from (select doc_id, {single_terms('text')} as t from documents)""")
DOC_W = tfidf("documents")
add("term_document_stats", "select term, df, cf from w_stats", DOC_W)
add("vocabulary_top_k", f"select term, df, cf, {r6('idf')} as idf from w_vocab", DOC_W)
add("tfidf_documents", f"select doc_id, term, tf, {r6('tfidf')} as tfidf from w", DOC_W)
add("tfidf_headlines", f"select doc_id, term, tf, {r6('tfidf')} as tfidf from w", headline_weights())
LABELLED_NB = f"{LABELLED}, {tfidf('labelled')}, {bayes('w', 'labelled')}"
add("naive_bayes_model", "select term, " + ", ".join(f"{r6(f'lp{c}')} as log_prob_{c}" for c in range(3))
    + " from nb", LABELLED_NB)
_joint = ", ".join(
    f"""coalesce(s{c}, 0e0) + ln((select count(*) filter (label = {c}) from labelled)::double
      / (select count(*) from labelled)) as jll_{c}""" for c in range(3))
_sums = ", ".join(f"sum(tfidf * lp{c}) as s{c}" for c in range(3))
_jll = [f"jll_{c}" for c in range(3)]
add("naive_bayes_predictions", "select doc_id, " + ", ".join(f"{r6(j)} as {j}" for j in _jll)
    + f", {argmax(_jll)}::int as prediction from j", LABELLED_NB,
    f"sc as (select doc_id, {_sums} from w join nb using (term) group by doc_id)",
    f"j as (select doc_id, {_joint} from labelled left join sc using (doc_id))")

# --- word importance ----------------------------------------------------------------------------------------
IMP = importance()
add("word_importance", f"select doc_id, word, {r6('score')} as score, direction from imp", IMP)
_first = "string_split(lower(term), ' ')[1]"
add("word_importance_without_coefs", f"""select doc_id, term as word, {r6('tfidf')} as score,
  case when {_first} in {sql_list(LEX.positive)} then 'positive'
       when {_first} in {sql_list(LEX.negative)} then 'negative' else 'neutral' end as direction from w""",
    headline_weights())
add("top_words_per_text", f"select doc_id, word, {r6('score')} as score, direction, rank from top20", IMP)
add("top_words_by_direction", f"""select doc_id, word, {r6('score')} as score, direction, rank,
  place from (select *, row_number() over (partition by doc_id, direction order by rank)::int as place from top20)
where place <= 5""", IMP)
TOP_FEATURES = """tf as (select *, row_number() over (partition by class order by round(coef, 6) desc, term)::int as rank
from (select term, 'negative' as class, coef_neg as coef from coefs
  union all select term, 'neutral', coef_neu from coefs
  union all select term, 'positive', coef_pos from coefs))"""
add("top_features_per_class", f"select term, class, {r6('coef')} as coef, rank from tf where rank <= 10",
    headline_coefs(), TOP_FEATURES)
add("class_word_comparison", f"""select term as word, {r6('coef')} as score,
  upper(class[1]) || class[2:] as sentiment from tf where rank <= 5""", headline_coefs(), TOP_FEATURES)
E_ = explained()
_parts = ", ".join(f"coalesce(sum(tfidf * lp{c}), 0e0) as s{c}" for c in range(3))
_joint = ", ".join(
    f"s{c} + ln((select count(*) filter (label = {c}) from hl)::double / (select count(*) from hl)) as jll_{c}"
    for c in range(3))
_top = "greatest(jll_0, jll_1, jll_2)"
_total = " + ".join(f"exp(jll_{c} - {_top})" for c in range(3))
MODEL_SCORES = f"""ms as (select doc_id, {_joint} from (
  select h.doc_id, {_parts} from h left join (select * from w join nb using (term)) t using (doc_id) group by h.doc_id)),
mp as (select *, {decode(argmax(_jll))} as prediction, """ + ", ".join(
    f"exp(jll_{c} - {_top}) / ({_total}) as p{c}" for c in range(3)) + " from ms)"
add("explain_prediction", """select doc_id, prediction, """ + ", ".join(
    f"{r6(f'p{i}')} as p_{c}" for i, c in enumerate(("negative", "neutral", "positive"))) + f""",
  {joined('list_transform(items, lambda x: x.word)')} as word_importance, """ + ", ".join(
    f"{joined(c + '_words')} as {c}_words" for c in ("negative", "neutral", "positive")) + ", " + ", ".join(
    f"{joined('lex_' + c)} as lexicon_{c}" for c in ("positive", "negative", "uncertainty"))
    + " from e join mp using (doc_id)", E_, MODEL_SCORES)
_colour = pick("direction", {k: q(v) for k, v in P.HIGHLIGHT_COLOURS.items()}, "'#ffffff'")
SQL["highlight_html"] = f"""with {IMP},
tk as (select doc_id, unnest(range(0, len(ts))) as position, unnest(ts) as tok
  from (select doc_id, {tokens('text')} as ts from h)),
mk as (select tk.*, t.direction from tk left join (select * from top20 where rank <= 15) t
  on t.doc_id = tk.doc_id and t.word = {sub('lower(tk.tok)', P.NOT_WORD, '')})
select doc_id, string_agg(case when direction is null then tok else
  '<span style="background-color: ' || {_colour} || '; padding: 2px 4px; border-radius: 3px;">' || tok || '</span>' end,
  ' ' order by position) as html from mk group by doc_id"""


def named_words(x: str) -> str:
    return f"""case least(3, len({x})) when 1 then '''' || {x}[1] || ''''
  when 2 then '''' || {x}[1] || ''' and ''' || {x}[2] || ''''
  else '''' || {x}[1] || ''', ''' || {x}[2] || ''', and ''' || {x}[3] || '''' end"""


def sided(side: str, own: str, other: str) -> str:
    opening = fill(EXPLAIN[side], band="band", conf=percent("confidence"), words=named_words(own))
    return f"""case when len({own}) > 0 then {opening} || case when len({other}) > 0
    then {fill(EXPLAIN[side + '_but'], other=other + '[1]')} else {q(EXPLAIN[side + '_only'])} end
  else {fill(EXPLAIN[side + '_bare'], conf=percent('confidence'))} end"""


add("explanation_text", f"""select doc_id, case category
  when 'positive' then {sided('positive', 'positive_words', 'negative_words')}
  when 'negative' then {sided('negative', 'negative_words', 'positive_words')}
  else {fill(EXPLAIN['neutral'], band='band', conf=percent('confidence'))}
    || case when len(neutral_words) > 0 then {fill(EXPLAIN['neutral_terms'], word='neutral_words[1]')} else '' end
    || {q(EXPLAIN['neutral_end'])} end as explanation
from (select *, case when confidence > 0.8e0 then 'high' when confidence > 0.6e0 then 'moderate'
  else 'low' end as band from e)""", E_)

# --- six-step reasoning ---------------------------------------------------------------------------------------
R_ = f"{H}, {reasoning('h')}"
_confidence = ("0.9e0", "0.85e0", "clarity", "0.75e0", "calibrated", "final_confidence")
for _i, _name in enumerate((
    "reasoning_comprehension", "reasoning_entities", "reasoning_sentiment", "reasoning_context",
    "reasoning_calibration", "reasoning_synthesis",
)):
    add(_name, f"""select doc_id, {q(W.STEPS[_i])} as step, o{_i + 1} as observation, w{_i + 1} as reasoning,
  c{_i + 1} as conclusion, {r6(_confidence[_i])} as confidence from r""", R_)
add("reasoning_final", f"""select doc_id, final_sentiment, {r6('final_confidence')} as final_confidence,
  reasoning from r""", R_)
add("reasoning_key_factors", f"select doc_id, {joined('key_factors')} as key_factors from r", R_)
add("reasoning_trace", f"select doc_id, {trace()} as trace from r", R_)
add("reasoning_documents", f"""select doc_id, final_sentiment, {r6('final_confidence')} as final_confidence,
  {joined('key_factors')} as key_factors from r""", reasoning("documents"))
add("reasoning_without_lexicon", f"""select doc_id, final_sentiment, {joined('key_factors')} as key_factors
from r""", H, reasoning("h", fallback=True))
MODEL_R = f"""{F_}, mr as (select doc_id, text, category as model_label, confidence as model_confidence
  from f), {reasoning('mr', model=True)}"""
_summary = {
    "agree": fill(REASON["summary_agree"], model_upper="upper(model_label)", conf=percent("model_confidence"),
                  n_factors="len(key_factors)", reasoning="w6"),
    "differ": fill(REASON["summary_differ"], model_upper="upper(model_label)", conf=percent("model_confidence"),
                   label_upper="upper(final_sentiment)", final_conf=percent("final_confidence"),
                   factors="array_to_string(key_factors[1:3], ', ')"),
}
_told = {k: fill(REASON[f"confidence_{k}"], conf=percent("model_confidence")) for k in ("high", "moderate", "low")}
add("comprehensive_explanation", f"""select doc_id,
  case when lower(model_label) = final_sentiment then {_summary['agree']} else {_summary['differ']} end as summary,
  case when model_confidence > 0.85e0 then {_told['high']} when model_confidence > 0.65e0 then {_told['moderate']}
       else {_told['low']} end as confidence_explanation,
  {joined('key_factors')} as key_factors, final_sentiment as reasoning_prediction,
  {r6('final_confidence')} as reasoning_confidence, lower(model_label) = final_sentiment as agreement,
  reasoning, {trace()} as trace from r""", MODEL_R)
_influential = ", ".join(
    f"""{joined(f"list_transform(list_filter(items, lambda x: x.direction = '{c}')[1:5], lambda x: x.word)")}
      as influential_{c}""" for c in ("positive", "negative"))
add("comprehensive_explanation_words", f"""select e.doc_id, {_influential},
  {r6('f.score')} as lexicon_sentiment_score, {r6('f.uncertainty_score')} as uncertainty_level,
  {joined('f.positive_words[1:10]')} as positive_words_found, {joined('f.negative_words[1:10]')} as negative_words_found,
  {joined('percentages')} as percentages, {joined('currencies')} as currencies, {joined('companies')} as companies
from e join f using (doc_id)""", E_)
add("sample_analyses", f"""select doc_id, {preview('text', 100)} as shown, model_label as prediction,
  {joined('key_factors[1:3]')} as key_factors from r order by doc_id limit 3""", MODEL_R)

# --- training: what has to hold for the scores of any model ------------------------------------------
for _model in ("logreg", "naive_bayes", "svm", "random_forest", "gradient_boosting", "mlp", "ensemble"):
    add(f"train_{_model}", """select label as class, count(*) as n, count(*) as predicted,
  count(*) as shares_sum_to_one, count(*) as confidence_is_largest, true as learned
from sp where split = 'val' group by label""", LABELLED, split("labelled"))

add("forest_leaves", """select tree::int as tree, label as class, count(*) as n, true as all_leaves_agree, 0::bigint as small_split,
  true as depth_in_bounds
from sp, range(10) as trees(tree) where split = 'train' group by tree, label""", LABELLED, split("labelled"))
add("boosting_rounds", "select unnest(range(1, 101)) as round, true as falls, true as above_zero")

add("network_early_stop", "select true as stopped_early, true as kept_best, true as learned, true as waited")
add("calibrate_margins", f"""select grp, class, count(*) as n, count(*) filter (label = class) as hits,
  true as level_fits, true as slope_fits
from (select grp, {encode(LABEL)} as label, unnest([0, 1, 2])::int as class from h) group by all""", H)

# --- written and read back ------------------------------------------------------------------------------
add("agreement_levels", f"""select case left(grp, 1) when '1' then '50Agree' when '2' then '66Agree'
    when '3' then '75Agree' else 'AllAgree' end as level,
  {strip('text')} as sentence, {LABEL} as label from h where dir <> 'new'""", H)
add("splits_round_trip", "select sentence, label, split from sp", CORPUS, CODED, split("coded"))
add("predictions_round_trip", "select doc_id::varchar as doc_id, text, category as predicted_label from f", F_)
add("metrics_round_trip", f"select grp as name, {METRIC_COLUMNS} from (select grp, {SUMMARY} from cr group by grp)",
    P_, class_rates("p", "cr", "grp"))
_stored = [f"baseline_{m}" for m in (
    "logreg", "naive_bayes", "svm", "random_forest", "gradient_boosting", "mlp", "ensemble")]
add("models_round_trip", f"""select model, n, n as predicted, case when model like 'baseline_%' then 2 else 0 end::bigint as versions,
  case when model like 'baseline_%' then true end as accuracy_is_that_compared, true as no_error
from (select unnest({[*_stored, 'finbert_pretrained']}) as model), (select count(*) as n from sp where split = 'val')""",
    LABELLED, split("labelled"))

# --- explanations of fitted linear models: what has to hold whatever the coefficients ---------------------
_own_words = words(tokens("text"))
for _model in ("logreg", "naive_bayes", "svm"):
    add(f"explain_{_model}", f"""select doc_id, coalesce(n_terms, 0)::int as n_terms, coalesce(terms, '') as terms,
  {joined(only(_own_words, LEX.negative))} as lexicon_negative, true as adds_up, true as same_class,
  true as positive_listed
from (select sp.doc_id, labelled.text from sp join labelled using (doc_id) where split <> 'train')
  left join (select doc_id, count(*) as n_terms, string_agg(term, '|' order by term) as terms
    from o join t_vocab using (term) group by doc_id) using (doc_id)""",
        LABELLED, split("labelled"),
        "tr as (select labelled.doc_id, labelled.text from labelled join sp using (doc_id) where split = 'train')",
        tfidf("tr", "t"), f"""o as (select distinct doc_id, unnest({with_pairs('t')}) as term
  from (select doc_id, {single_terms('text')} as t from labelled))""")
