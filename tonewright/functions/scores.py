"""Scores and class decisions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _ratio(part: Column, whole: Column) -> Column:
    """The fraction; 0 of nothing, null if either number is unknown."""
    known = part.isNotNull() & whole.isNotNull()
    return F.when(known, F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0)))


def rounded(number: Column, digits: int = 6) -> Column:
    """``F.round`` of a double. Spark rounds by way of its decimal text; a number of ordinary size that is clear of the
    middle between two results gets the same double from one division. ``number`` has to be a column: it stands here
    several times. Not for lambdas, which aren't compiled: there ``F.round`` is faster."""
    scale = 10.0 ** digits
    scaled = number * scale
    clear = (F.abs(number) < 1e5) & (F.abs(F.pmod(scaled, F.lit(1.0)) - 0.5) > 1e-3)
    return F.when(clear, F.rint(scaled) / scale + 0.0).otherwise(F.round(number, digits))


def _at_most_one(x: Column) -> Column:
    return F.when(x > 1.0, 1.0).otherwise(x)


def sentiment_score(positive: Column, negative: Column) -> Column:
    """(p - n) / (p + n); 0 without any hit."""
    return _ratio(positive - negative, positive + negative)


def flip_for_negation(score: Column, negations: Column) -> Column:
    """Halve and turn the score when a negation is present (adding 0 removes a minus zero)."""
    return F.when(negations > 0, score * -0.5 + 0.0).otherwise(score)


def uncertainty_score(uncertain: Column, words: Column) -> Column:
    return _at_most_one(_ratio(uncertain, words) * 5)


def subjectivity_score(opinions: Column, words: Column) -> Column:
    return _at_most_one(_ratio(opinions, words) * 3)


def sentiment_category(score: Column) -> Column:
    """By the sign of a clear score; null without a score."""
    return (
        F.when(score > 0.2, "positive").when(score < -0.2, "negative")
        .when(score.isNotNull(), "neutral")
    )


def lexicon_confidence(score: Column, uncertainty: Column, negations: Column) -> Column:
    raw = (
        F.lit(0.5)
        + F.abs(score) * 0.3
        - uncertainty * 0.3
        - F.least(F.lit(0.2), negations * F.lit(0.1))
    )
    return F.when(raw < 0.1, 0.1).when(raw > 1.0, 1.0).otherwise(raw)


def softmax(scores: Column) -> Column:
    """Shifted softmax of a score array."""
    def shares(exps: Column) -> Column:
        # the array holds one item, so the total is taken once and not for every element
        total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
        return F.transform(F.array(total), lambda t: F.transform(exps, lambda x: x / t))[0]

    shifted = F.transform(F.array(F.array_max(scores)), lambda m: F.transform(
        scores, lambda x: F.exp(x - m)))
    return F.transform(shifted, shares)[0]


def argmax(scores: Column) -> Column:
    """Position of the first largest value, counted from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def reorder_external(probabilities: Column) -> Column:
    """positive/negative/neutral order of the pretrained scorer -> class order 0/1/2."""
    source = [P.EXTERNAL_ORDER.index(label) for label in P.LABELS]
    return F.array(*[F.get(probabilities, F.lit(i)) for i in source])


def probability_map(probabilities: Column) -> Column:
    """Probability array in class order -> ``{label: probability}``."""
    return F.map_from_arrays(F.array(*[F.lit(n) for n in P.LABELS]), probabilities)
