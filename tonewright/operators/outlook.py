"""From row labels to a market outlook: four rule sets over one grouped aggregate.

All take optional grouping columns. Counting is a partial aggregate, so a group holding a third
of the rows sends one row per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import wording as W
from ..functions.wording import fill


def _share(part: str, total: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(total)), F.lit(0.0))


def aggregate_sentiment(
    df: DataFrame, by: Sequence[str] = (), score: str = "sentiment_score", category: str = "category"
) -> DataFrame:
    """Size, mean and population deviation of the score, class counts and shares, trend (1.5x).

    Texts without a score (null texts) are counted apart, in ``null_texts``.
    """
    counts = df.groupBy(*by).agg(
        F.count(score).alias("total_texts"),
        F.count_if(F.col(score).isNull()).alias("null_texts"),
        F.avg(score).alias("average_sentiment_score"),
        F.stddev_pop(score).alias("sentiment_std"),
        *[F.count_if(F.col(category) == c).alias(f"{c}_count")
          for c in ("positive", "negative", "neutral")],
    )
    positive, negative = F.col("positive_count"), F.col("negative_count")
    trend = (
        F.when(positive > negative * 1.5, "bullish")
        .when(negative > positive * 1.5, "bearish")
        .otherwise("mixed")
    )
    return counts.withColumns(
        {
            "overall_trend": trend,
            **{f"{c}_ratio": _share(f"{c}_count", "total_texts")
               for c in ("positive", "negative", "neutral")},
        }
    )


def label_mix(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", confidence: str = "confidence"
) -> DataFrame:
    """Counts per label (any case) with size and mean confidence: input of the outlook rules."""
    lowered = F.lower(F.col(label))
    return df.groupBy(*by).agg(
        F.count("*").alias("total"),
        *[F.count_if(lowered == name).alias(short)
          for short, name in (("pos", "positive"), ("neu", "neutral"), ("neg", "negative"))],
        F.count_if(lowered == "error").alias("err"),
        F.coalesce(F.avg(confidence), F.lit(0.0)).alias("avg_confidence"),
    )


def _percents(mix: DataFrame) -> DataFrame:
    return mix.withColumns({f"{c}_pct": _share(c, "total") * 100 for c in ("pos", "neu", "neg")})


def batch_summary(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", confidence: str = "confidence"
) -> DataFrame:
    """Counts and percents per label, mean confidence, most frequent label (first by name among
    equals), trend by 10 points."""
    mix = _percents(label_mix(df, by, label, confidence))
    names = (("err", "Error"), ("neg", "Negative"), ("neu", "Neutral"), ("pos", "Positive"))
    largest = F.greatest(*[F.col(c) for c, _ in names])
    dominant = F.lit("N/A")
    for column, shown in reversed(names):
        dominant = F.when(F.col(column) == largest, shown).otherwise(dominant)
    positive, negative = F.col("pos_pct"), F.col("neg_pct")
    trend = (
        F.when(positive > negative + 10, "Bullish")
        .when(negative > positive + 10, "Bearish")
        .otherwise("Mixed / Sideways")
    )
    return mix.withColumns(
        {"dominant": F.when(F.col("total") > 0, dominant).otherwise("N/A"), "trend": trend}
    )


def market_outlook(mix: DataFrame) -> DataFrame:
    """Outlook by percentage points (15 / 5) with a markdown report; input from ``label_mix``."""
    df = _percents(mix)
    positive, negative = F.col("pos_pct"), F.col("neg_pct")
    overall = (
        F.when(positive > negative + 15, "bullish")
        .when(negative > positive + 15, "bearish")
        .when(positive > negative + 5, "cautiously optimistic")
        .when(negative > positive + 5, "cautiously pessimistic")
        .otherwise("mixed/neutral")
    )
    ratio = F.try_divide(F.col("pos").cast("double"), F.col("neg"))
    out = df.withColumn("overall", overall).withColumn("_ratio", ratio)
    return out.withColumn("report", _outlook_report()).drop("_ratio")


def _choose(key: Column, texts: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, words in texts.items():
        out = F.when(key == name, F.lit(words)).otherwise(out)
    return out


def _outlook_report() -> Column:
    positive, negative, neutral = F.col("pos_pct"), F.col("neg_pct"), F.col("neu_pct")
    overall, confidence, ratio = F.col("overall"), F.col("avg_confidence"), F.col("_ratio")
    head = fill(
        W.OUTLOOK_HEAD, icon=_choose(overall, W.OUTLOOK_ICONS), overall=overall,
        overall_upper=F.upper(overall), total=F.col("total"), pos=F.col("pos"), neu=F.col("neu"),
        neg=F.col("neg"), pos_pct=T.fixed(positive, 1), neu_pct=T.fixed(neutral, 1),
        neg_pct=T.fixed(negative, 1),
    )
    majority = (
        F.when(positive > 50, W.OUTLOOK_MAJORITY["positive"])
        .when(negative > 50, W.OUTLOOK_MAJORITY["negative"])
        .when(neutral > 50, W.OUTLOOK_MAJORITY["neutral"])
        .otherwise("")
    )
    band = F.when(confidence > 0.8, "high").when(confidence < 0.6, "low").otherwise("moderate")
    sure = _filled_choice(band, W.OUTLOOK_CONFIDENCE, conf=T.percent(confidence))
    tone = F.when(ratio > 2, "optimistic").when(ratio < 0.5, "pessimistic").otherwise("balanced")
    mixed = _filled_choice(tone, W.OUTLOOK_RATIO, ratio=T.fixed(ratio, 1))
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    kind = (
        F.when(overall.isin("bullish", "bearish"), overall)
        .when(overall.startswith("cautiously"), "cautious")
        .otherwise("mixed")
    )
    return F.concat(
        head, majority, sure, F.when(both, mixed).otherwise(""), F.lit(W.OUTLOOK_ADVICE_TITLE),
        _choose(kind, W.OUTLOOK_ADVICE), F.lit(W.OUTLOOK_NOTE),
    )


def _filled_choice(key: Column, templates: dict[str, str], **values: Column) -> Column:
    out = F.lit("")
    for name, template in templates.items():
        out = F.when(key == name, fill(template, **values)).otherwise(out)
    return out


def graded_outlook(mix: DataFrame) -> DataFrame:
    """Outlook by count ratios (2x / 1.5x / 1x), seven trends, narrative; input from
    ``label_mix``."""
    positive, negative = F.col("pos"), F.col("neg")
    trend = (
        F.when(positive > negative * 2, "strongly_bullish")
        .when(positive > negative * 1.5, "bullish")
        .when(negative > positive * 2, "strongly_bearish")
        .when(negative > positive * 1.5, "bearish")
        .when(positive > negative, "cautiously_optimistic")
        .when(negative > positive, "cautiously_pessimistic")
        .otherwise("neutral")
    )
    df = _percents(mix).withColumn("trend", trend)
    shown = _choose(F.col("trend"), {k: v[0] for k, v in W.GRADED_TRENDS.items()})
    icon = _choose(F.col("trend"), {k: v[1] for k, v in W.GRADED_TRENDS.items()})
    df = df.withColumns({"trend_description": shown, "icon": icon})
    return df.withColumn("narrative", _graded_narrative())


def _graded_narrative() -> Column:
    positive, negative = F.col("pos_pct"), F.col("neg_pct")
    confidence, trend = F.col("avg_confidence"), F.col("trend_description")
    head = fill(W.GRADED_HEAD, trend=trend, trend_lower=F.lower(trend), total=F.col("total"))
    balance = (
        F.when(positive > 60, "positive").when(negative > 60, "negative")
        .when(positive > negative + 10, "more_positive")
        .when(negative > positive + 10, "more_negative").otherwise("balanced")
    )
    mix = _filled_choice(
        balance, W.GRADED_MIX, pos_pct=T.fixed(positive, 1), neg_pct=T.fixed(negative, 1)
    )
    band = F.when(confidence > 0.8, "high").when(confidence < 0.6, "low").otherwise("")
    sure = _filled_choice(band, W.GRADED_CONFIDENCE, conf=T.percent(confidence))
    ratio = F.try_divide(F.col("pos").cast("double"), F.col("neg"))
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    compared = F.when(both, fill(W.GRADED_RATIO, ratio=T.fixed(ratio, 2))).otherwise("")
    kind = (
        F.when(F.col("trend").contains("bullish"), "bullish")
        .when(F.col("trend").contains("bearish"), "bearish").otherwise("other")
    )
    return F.concat(
        head, mix, sure, compared, F.lit(W.GRADED_ADVICE_TITLE), _choose(kind, W.GRADED_ADVICE),
        F.lit(W.GRADED_NOTE),
    )


def mix_from_counts(counts: DataFrame, total: str = "total_texts") -> DataFrame:
    """Ready-made label counts (one row per report) in the shape of ``label_mix``."""
    return counts.select(
        *[c for c in counts.columns
          if c not in ("positive", "neutral", "negative", total, "avg_confidence")],
        F.col(total).cast("bigint").alias("total"),
        *[F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(short)
          for short, name in (("pos", "positive"), ("neu", "neutral"), ("neg", "negative"))],
        F.lit(0).cast("bigint").alias("err"),
        F.col("avg_confidence").cast("double").alias("avg_confidence"),
    )
