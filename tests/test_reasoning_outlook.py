import pytest
from pyspark.sql import functions as F

from tonewright.functions.lexicon import Lexicon
from tonewright.operators import outlook, reasoning

GOLDEN = [
    ("Revenue increased 25%.", "earnings/financial results", "medium", "positive", "low", 0.491667,
     "positive", 0.491667,
     ["Contains quantitative data", "Positive indicators: 'increased'",
      "Negation patterns detected", "Ambiguous/mixed signals"]),
    ("The company announced flat results.", "general financial news", "low", "neutral/balanced",
     "high", 0.413889, "neutral", 0.331111,
     ["Contains quantitative data", "Negation patterns detected", "Ambiguous/mixed signals"]),
]


@pytest.mark.parametrize("case", GOLDEN, ids=["increase", "flat"])
def test_goldens(texts, case):
    judged = reasoning.verdicts(reasoning.signals(texts(case[0]), lexicon=Lexicon())).first()
    assert (judged.r_topic, judged.r_density, judged.r_dominant, judged.r_impact) == case[1:5]
    assert round(judged.r_calibrated, 6) == case[5]
    r = reasoning.reason(texts(case[0]), lexicon=Lexicon()).first()
    assert (r.final_sentiment, round(r.final_confidence, 6), r.key_factors) == case[6:]
    assert [s.step for s in r.steps][0] == "comprehension" and len(r.steps) == 6


def test_model_label_and_trace(texts):
    df = texts("Strong growth in Q4.").withColumns(
        {"model_label": F.lit("negative"), "model_confidence": F.lit(0.9)}
    )
    r = reasoning.comprehensive_explanation(df, lexicon=Lexicon()).first()
    assert r.final_sentiment == "negative" and 0 < r.final_confidence < 1
    assert "Step 1" in r.trace and "Step 6: Final Synthesis" in r.trace
    assert r.model_vs_reasoning.agreement and r.summary.startswith("The text is classified as **NEG")


def test_whole_words_are_stricter(texts):
    df = texts("The company announced flat results.")
    r = reasoning.signals(df, whole_word=True).first()
    assert r.r_negations == []


def mix(spark, positive, neutral, negative, confidence=0.78):
    rows = [("positive",)] * positive + [("neutral",)] * neutral + [("negative",)] * negative
    df = spark.createDataFrame(rows, "label string").withColumn("confidence", F.lit(confidence))
    return df, outlook.label_mix(df)


def test_four_rules_on_one_mix(spark):
    df, counted = mix(spark, 35, 45, 20)
    scored = df.withColumns({"category": F.col("label"), "sentiment_score": F.lit(0.0)})
    assert outlook.aggregate_sentiment(scored).first().overall_trend == "bullish"
    summary = outlook.batch_summary(df).first()
    assert (summary.trend, summary.dominant) == ("Bullish", "Neutral")
    report = outlook.market_outlook(counted).first()
    assert report.overall == "cautiously optimistic" and "35.0%" in report.report
    graded = outlook.graded_outlook(counted).first()
    assert graded.trend == "bullish" and "1.75:1" in graded.narrative


def test_graded_extremes_and_counts(spark):
    assert outlook.graded_outlook(mix(spark, 5, 0, 1)[1]).first().trend == "strongly_bullish"
    assert outlook.graded_outlook(mix(spark, 1, 0, 5)[1]).first().trend == "strongly_bearish"
    counts = spark.createDataFrame([(35, 45, 20, 100, 0.78)],
                                   "positive int, neutral int, negative int, total_texts int, "
                                   "avg_confidence double")
    assert outlook.market_outlook(outlook.mix_from_counts(counts)).first().overall == \
        "cautiously optimistic"
