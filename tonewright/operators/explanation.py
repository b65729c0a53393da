"""Templated explanation of a prediction from its influential words. Row-local."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.wording import EXPLAIN, fill


def _named_words(terms: Column) -> Column:
    """Up to three words as ``'a'``, ``'a' and 'b'`` or ``'a', 'b', and 'c'``."""
    def quoted(position: int) -> Column:
        return F.concat(F.lit("'"), F.get(terms, F.lit(position)), F.lit("'"))

    one, two, three = (quoted(i) for i in range(3))
    return (
        F.when(F.size(terms) == 1, one)
        .when(F.size(terms) == 2, F.concat(one, F.lit(" and "), two))
        .otherwise(F.concat(one, F.lit(", "), two, F.lit(", and "), three))
    )


def explanation_text(
    prediction: Column,
    confidence: Column,
    positive_terms: Column,
    negative_terms: Column,
    neutral_terms: Column,
) -> Column:
    """Explanation for a label, its confidence and three arrays of words, best first."""
    band = F.when(confidence > 0.8, "high").when(confidence > 0.6, "moderate").otherwise("low")
    shown = T.percent(confidence)

    def sided(side: str, own: Column, other: Column) -> Column:
        opening = fill(EXPLAIN[side], band=band, conf=shown, words=_named_words(F.slice(own, 1, 3)))
        contrast = fill(EXPLAIN[f"{side}_but"], other=F.get(other, F.lit(0)))
        ending = F.when(F.size(other) > 0, contrast).otherwise(EXPLAIN[f"{side}_only"])
        return F.when(F.size(own) > 0, F.concat(opening, ending)).otherwise(
            fill(EXPLAIN[f"{side}_bare"], conf=shown)
        )

    named = fill(EXPLAIN["neutral_terms"], word=F.get(neutral_terms, F.lit(0)))
    neutral = F.concat(
        fill(EXPLAIN["neutral"], band=band, conf=shown),
        F.when(F.size(neutral_terms) > 0, named).otherwise(""),
        F.lit(EXPLAIN["neutral_end"]),
    )
    return (
        F.when(prediction == "positive", sided("positive", positive_terms, negative_terms))
        .when(prediction == "negative", sided("negative", negative_terms, positive_terms))
        .otherwise(neutral)
    )


def explain_importance(prediction: Column, probabilities: Column, importance: Column) -> Column:
    """The same from a probability map and an array of (word, score, direction)."""
    def terms(direction: str) -> Column:
        kept = F.filter(importance, lambda x: x["direction"] == direction)
        return F.transform(kept, lambda x: x["word"])

    confidence = F.coalesce(F.element_at(probabilities, prediction), F.lit(0.5))
    return explanation_text(
        prediction, confidence, terms("positive"), terms("negative"), terms("neutral")
    )
