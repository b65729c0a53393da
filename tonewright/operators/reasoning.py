"""Six-step reasoning over a text column. Row-local: no shuffle, safe on streams.

Keyword tests look for substrings ("announced" contains "no"), which is part of the rules;
``whole_word=True`` gives the stricter reading.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.lexicon import Lexicon, only
from ..functions.wording import REASON, STEPS, TRACE_STEP, fill
from . import features

MODEL_COLUMNS = ("model_label", "model_confidence")


def _present(lowered: Column, word: str, whole_word: bool) -> Column:
    if whole_word:
        return F.rlike(lowered, F.lit(rf"(?U)\b{word}\b"))
    return F.contains(lowered, F.lit(word))


def _any(lowered: Column, words: Sequence[str], whole_word: bool) -> Column:
    found = F.lit(False)
    for word in reversed(words):
        found = _present(lowered, word, whole_word) | found
    return found


def _listed(lowered: Column, words: Sequence[str], whole_word: bool) -> Column:
    return F.array_compact(
        F.array(*[F.when(_present(lowered, w, whole_word), F.lit(w)) for w in words])
    )


def _fallback_lexicon() -> Lexicon:
    return Lexicon(**P.FALLBACK_WORDS, litigious=())


def signals(
    df: DataFrame, text: str = "text", lexicon: Lexicon | None = None, whole_word: bool = False
) -> DataFrame:
    """The facts the six steps rest on, as flat columns prefixed ``r_``."""
    raw, lowered = F.col(text), F.col("r_lower")
    lists = lexicon or _fallback_lexicon()
    base = df.withColumns(
        {"r_lower": F.lower(raw), "r_tokens": T.tokens(raw), "r_words": T.lexical_words(raw)}
    )
    topic = F.lit(P.OTHER_TOPIC)
    for name, words in reversed(P.TOPICS):
        topic = F.when(_any(lowered, words, whole_word), name).otherwise(topic)
    return base.withColumns(
        {
            "r_topic": topic,
            "r_sentences": T.sentence_count(raw),
            "r_word_count": F.size("r_tokens"),
            "r_percents": T.percentages(raw),
            "r_amounts": T.find_all(raw, P.STEP_CURRENCY),
            "r_companies": T.step_companies(raw),
            "r_positive": only(F.col("r_words"), lists.positive),
            "r_negative": only(F.col("r_words"), lists.negative),
            "r_uncertain": only(F.col("r_words"), lists.uncertainty),
            "r_negations": _listed(lowered, P.STEP_NEGATIONS, whole_word),
            "r_comparisons": _listed(lowered, P.STEP_COMPARISONS, whole_word),
            "r_future": _any(lowered, P.STEP_FUTURE, whole_word),
        }
    ).drop("r_lower", "r_tokens", "r_words")


def verdicts(df: DataFrame, model: Sequence[str] | None = None) -> DataFrame:
    """Decide topic depth, entity density, dominant signal, impact, confidence and label.

    ``model`` names a label and a confidence column of a model to weigh in.
    """
    words = F.col("r_word_count")
    positive, negative = F.size("r_positive"), F.size("r_negative")
    entities = F.size("r_percents") + F.size("r_amounts") + F.size("r_companies")
    dominant = (
        F.when(positive > negative * 1.5, "positive")
        .when(negative > positive * 1.5, "negative")
        .when(positive > negative, "slightly positive")
        .when(negative > positive, "slightly negative")
        .otherwise("neutral/balanced")
    )
    impact = (
        F.when(F.size("r_negations") > 0, "high")
        .when((F.size("r_comparisons") > 0) | F.col("r_future"), "medium")
        .otherwise("low")
    )
    complexity = F.when(words > 50, "high").when(words > 20, "medium").otherwise("low")
    first = df.withColumns(
        {
            "r_complexity": complexity,
            "r_entities": entities,
            "r_density": F.when(entities > 3, "high").when(entities > 0, "medium").otherwise("low"),
            "r_dominant": dominant,
            "r_clarity": F.when(F.abs(positive - negative) > 2, 0.8).otherwise(0.6),
            "r_impact": impact,
            "r_length_factor": F.least(F.lit(1.0), words / F.lit(30)),
        }
    )
    clarity, high = F.col("r_clarity"), F.col("r_impact") == "high"
    mean_of_steps = (F.lit(0.9) + F.lit(0.85) + clarity + F.lit(0.75)) / 4
    base = (mean_of_steps + F.col("r_length_factor") + clarity) / 3 - F.when(high, 0.1).otherwise(0)
    second = first.withColumn("r_base", base)
    weighed = F.col("r_base")
    if model:
        weighed = F.coalesce((F.col("r_base") + F.col(model[1])) / 2, F.col("r_base"))
    third = second.withColumn(
        "r_calibrated", F.greatest(F.lit(0.1), F.least(F.lit(0.99), weighed))
    )
    leaning = (
        F.when(F.contains(F.col("r_dominant"), F.lit("positive")), "positive")
        .when(F.contains(F.col("r_dominant"), F.lit("negative")), "negative")
        .otherwise("neutral")
    )
    flipped = (
        F.when(high & (leaning == "positive"), "negative")
        .when(high & (leaning == "negative"), "positive")
        .otherwise(leaning)
    )
    fourth = third.withColumns(
        {
            "r_reasoned": flipped,
            "r_damped": F.when(high, F.col("r_calibrated") * 0.8).otherwise(F.col("r_calibrated")),
        }
    )
    label, confidence = F.col("r_reasoned"), F.col("r_damped")
    if model:
        given = F.lower(F.col(model[0]))
        confidence = (
            F.when(given == label, F.least(F.lit(0.99), confidence * 1.1))
            .when(given.isNotNull(), confidence * 0.85)
            .otherwise(confidence)
        )
        label = F.coalesce(given, label)
    return fourth.withColumns({"r_label": label, "r_confidence": confidence})


def _topic_step() -> Column:
    topic, words = F.col("r_topic"), F.col("r_word_count")
    length = F.when(words > 30, "detailed").otherwise("brief")
    return _step(
        0,
        fill(REASON["topic_seen"], words=words, sentences=F.col("r_sentences"), topic=topic),
        fill(REASON["topic_why"], topic=topic, length=length),
        fill(REASON["topic_end"], topic=topic, complexity=F.col("r_complexity")),
        F.lit(0.9),
    )


def _entity_step() -> Column:
    percents = F.col("r_percents")
    down = F.filter(percents, lambda p: F.startswith(p, F.lit("-")))
    up = F.filter(percents, lambda p: ~F.startswith(p, F.lit("-")))
    found = F.concat(
        fill(REASON["entity_list"], all=T.quoted_list(percents)),
        F.when(F.size(down) > 0, fill(REASON["entity_down"], down=T.quoted_list(down))).otherwise(""),
        F.when(F.size(up) > 0, fill(REASON["entity_up"], up=T.quoted_list(up))).otherwise(""),
    )
    return _step(
        1,
        fill(REASON["entity_seen"], total=F.col("r_entities"), percents=F.size(percents),
             amounts=F.size("r_amounts")),
        F.when(F.size(percents) > 0, found).otherwise(REASON["entity_none"]),
        fill(REASON["entity_end"], density=F.col("r_density")),
        F.lit(0.85),
    )


def _signal_reason() -> Column:
    def first(array: str, n: int) -> Column:
        return T.quoted_list(F.slice(F.col(array), 1, n))

    dominant = F.col("r_dominant")
    lean = (
        F.when(dominant == "positive", fill(REASON["signal_positive"], list=first("r_positive", 3)))
        .when(dominant == "negative", fill(REASON["signal_negative"], list=first("r_negative", 3)))
        .when(dominant == "slightly positive",
              fill(REASON["signal_slightly_positive"], list=first("r_positive", 2)))
        .when(dominant == "slightly negative",
              fill(REASON["signal_slightly_negative"], list=first("r_negative", 2)))
        .otherwise(REASON["signal_balanced"])
    )
    doubtful = fill(REASON["signal_uncertain"], list=first("r_uncertain", 2))
    return F.concat(lean, F.when(F.size("r_uncertain") > 2, doubtful).otherwise(""))


def _signal_step() -> Column:
    seen = fill(
        REASON["signal_seen"], pos=F.size("r_positive"), neg=F.size("r_negative"),
        unc=F.size("r_uncertain"),
    )
    end = fill(REASON["signal_end"], dominant=F.col("r_dominant"))
    return _step(2, seen, F.col("r_finding"), end, F.col("r_clarity"))


def _context_reason() -> Column:
    negations = T.quoted_list(F.slice(F.col("r_negations"), 1, 2))
    parts = F.concat_ws(
        ". ",
        F.when(F.size("r_negations") > 0, fill(REASON["context_negation"], list=negations)),
        F.when(F.size("r_comparisons") > 0, F.lit(REASON["context_comparison"])),
        F.when(F.col("r_future"), F.lit(REASON["context_forward"])),
    )
    return F.when(parts == "", REASON["context_plain"]).otherwise(parts)


def _context_step() -> Column:
    focus = F.when(F.col("r_future"), REASON["context_future"]).otherwise(REASON["context_present"])
    seen = fill(
        REASON["context_seen"], negations=F.size("r_negations"),
        comparisons=F.size("r_comparisons"), focus=focus,
    )
    end = fill(REASON["context_end"], impact=F.col("r_impact"))
    return _step(3, seen, F.col("r_context_note"), end, F.lit(0.75))


def _calibration_step(model: Sequence[str] | None) -> Column:
    base, final = T.fixed(F.col("r_base"), 2), F.col("r_calibrated")
    seen = fill(REASON["calibrate_seen"], base=base)
    if model:
        seen = F.coalesce(
            fill(REASON["calibrate_seen_model"], base=base, model=T.fixed(F.col(model[1]), 2)), seen
        )
    # the penalty is an integer 0 when there is none, which still shows two decimals
    penalty = F.when(F.col("r_impact") == "high", "0.10").otherwise("0.00")
    why = fill(
        REASON["calibrate_why"], length=T.fixed(F.col("r_length_factor"), 2),
        clarity=T.fixed(F.col("r_clarity"), 2), penalty=penalty,
    )
    shown = T.fixed(final, 2)
    end = (
        F.when(final > 0.8, fill(REASON["calibrate_high"], conf=shown))
        .when(final > 0.6, fill(REASON["calibrate_moderate"], conf=shown))
        .otherwise(fill(REASON["calibrate_low"], conf=shown))
    )
    return _step(4, seen, why, end, final)


def _final_step(model: Sequence[str] | None) -> Column:
    label, confidence = F.col("r_label"), F.col("r_confidence")
    context = fill(REASON["context_end"], impact=F.col("r_impact"))
    why = fill(REASON["final_why"], label=label, context=context)
    if model:
        told = F.coalesce(fill(REASON["final_model"], model=F.col(model[0])), F.lit(""))
        why = F.concat(why, told)
    end = fill(REASON["final_end"], label_upper=F.upper(label), conf=T.percent(confidence))
    return _step(5, F.lit(REASON["final_seen"]), why, end, confidence)


def _step(position: int, seen: Column, why: Column, end: Column, confidence: Column) -> Column:
    return F.struct(
        F.lit(STEPS[position]).alias("step"),
        seen.alias("observation"),
        why.alias("reasoning"),
        end.alias("conclusion"),
        confidence.cast("double").alias("confidence"),
    )


def _explanation() -> Column:
    text = fill(
        REASON["explain"], label_upper=F.upper(F.col("r_label")),
        conf=T.percent(F.col("r_confidence")), finding=F.col("r_finding"),
    )
    note = fill(REASON["explain_context"], note=F.col("r_context_note"))
    return F.concat(text, F.when(F.col("r_impact") == "high", note).otherwise(""))


def _key_factors() -> Column:
    """At most five. Numbers and negations are always named: the rules test words that every
    observation contains."""
    def bare(array: str) -> Column:
        listed = T.quoted_list(F.slice(F.col(array), 1, 3))
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    dominant, confidence = F.col("r_dominant"), F.col("r_confidence")
    return F.slice(
        F.array_compact(F.array(
            F.lit(REASON["factor_numbers"]),
            F.when(dominant == "positive", fill(REASON["factor_positive"], list=bare("r_positive"))),
            F.when(dominant == "negative", fill(REASON["factor_negative"], list=bare("r_negative"))),
            F.lit(REASON["factor_negation"]),
            F.when(F.col("r_future"), F.lit(REASON["factor_future"])),
            F.when(confidence > 0.85, F.lit(REASON["factor_clear"]))
            .when(confidence < 0.5, F.lit(REASON["factor_mixed"])),
        )),
        1, 5,
    )


def reasoning_trace(steps: Column) -> Column:
    """The steps as numbered markdown."""
    def block(step: Column, position: Column) -> Column:
        return fill(
            TRACE_STEP, number=position + 1,
            title=F.initcap(F.replace(step["step"], F.lit("_"), F.lit(" "))),
            observation=step["observation"], reasoning=step["reasoning"],
            conclusion=step["conclusion"],
        )

    return F.array_join(F.transform(steps, block), "\n")


def reason(
    df: DataFrame,
    text: str = "text",
    lexicon: Lexicon | None = None,
    model: Sequence[str] | None = None,
    whole_word: bool = False,
) -> DataFrame:
    """Add ``steps``, ``final_sentiment``, ``final_confidence``, ``reasoning`` and ``key_factors``.

    Without a lexicon, short built-in word lists are used.
    """
    judged = verdicts(signals(df, text, lexicon, whole_word), model).withColumns(
        {"r_finding": _signal_reason(), "r_context_note": _context_reason()}
    )
    steps = F.array(
        _topic_step(), _entity_step(), _signal_step(), _context_step(),
        _calibration_step(model), _final_step(model),
    )
    return judged.select(
        *[F.col(c) for c in df.columns],
        steps.alias("steps"),
        F.col("r_label").alias("final_sentiment"),
        F.col("r_confidence").alias("final_confidence"),
        _explanation().alias("reasoning"),
        _key_factors().alias("key_factors"),
    )


def _with_linguistic(df: DataFrame, text: str, lexicon: Lexicon | None) -> DataFrame:
    # out of flat columns: a field of a nested record would make the planner compute the whole record
    found = features.add_sentiment(features.extract_features(df, text, lexicon))
    block = F.struct(
        F.col("sentiment_score").alias("lexicon_sentiment_score"),
        F.col("uncertainty_score").alias("uncertainty_level"),
        F.slice("positive_words", 1, features.LISTED).alias("positive_words_found"),
        F.slice("negative_words", 1, features.LISTED).alias("negative_words_found"),
        features.entities().alias("entities_found"),
    )
    return found.select(*df.columns, block.alias("linguistic_analysis"))


def _scored(direction: str) -> Column:
    kept = F.filter("word_importance", lambda x: x["direction"] == direction)
    return F.transform(kept, lambda x: x.dropFields("direction"))


def comprehensive_explanation(
    df: DataFrame,
    text: str = "text",
    lexicon: Lexicon | None = None,
    model: Sequence[str] = MODEL_COLUMNS,
) -> DataFrame:
    """Model prediction and reasoning side by side, in words and as a struct.

    ``linguistic_analysis`` holds the lexicon's view of the text. If ``df`` has ``word_importance``
    (:func:`importance.importance_lists`), ``influential_words`` names the first five words and scores of
    either direction.
    """
    full = reason(_with_linguistic(df, text, lexicon), text, lexicon, model)
    if "word_importance" in df.columns:
        full = full.withColumn("influential_words", F.struct(*[
            F.slice(_scored(side), 1, 5).alias(side) for side in ("positive", "negative")]))
    label, confidence = F.col(model[0]), F.col(model[1])
    final, final_confidence = F.col("final_sentiment"), F.col("final_confidence")
    agreement = F.lower(label) == final
    shown = T.percent(confidence)
    agree = fill(
        REASON["summary_agree"], model_upper=F.upper(label), conf=shown,
        n_factors=F.size("key_factors"), reasoning=F.get("steps", F.lit(5))["reasoning"],
    )
    differ = fill(
        REASON["summary_differ"], model_upper=F.upper(label), conf=shown,
        label_upper=F.upper(final), final_conf=T.percent(final_confidence),
        factors=F.array_join(F.slice("key_factors", 1, 3), ", "),
    )
    told = (
        F.when(confidence > 0.85, fill(REASON["confidence_high"], conf=shown))
        .when(confidence > 0.65, fill(REASON["confidence_moderate"], conf=shown))
        .otherwise(fill(REASON["confidence_low"], conf=shown))
    )
    return full.withColumns(
        {
            "summary": F.when(agreement, agree).otherwise(differ),
            "confidence_explanation": told,
            "trace": reasoning_trace(F.col("steps")),
            "model_vs_reasoning": F.struct(
                label.alias("model_prediction"), confidence.alias("model_confidence"),
                final.alias("reasoning_prediction"),
                final_confidence.alias("reasoning_confidence"), agreement.alias("agreement"),
            ),
        }
    )


def sample_analyses(
    df: DataFrame,
    n: int = 3,
    text: str = "text",
    order: str = "doc_id",
    lexicon: Lexicon | None = None,
    model: Sequence[str] = MODEL_COLUMNS,
) -> DataFrame:
    """Reasoning for the first ``n`` texts, with three factors each: a sample for the report."""
    # the smallest keys are a top-k; sorting whole rows would sort the corpus
    smallest = df.select(order).orderBy(order).limit(n)
    first = df.join(F.broadcast(smallest), order, "left_semi")  # n rows
    return reason(first, text, lexicon, model).select(
        order,
        T.preview(F.col(text), 100).alias("shown"),
        F.col(model[0]).alias("prediction"),
        F.slice("key_factors", 1, 3).alias("key_factors"),
    )
