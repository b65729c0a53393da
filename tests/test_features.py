import pytest
from pyspark.sql import functions as F

from tonewright.functions.lexicon import CATEGORIES, Lexicon
from tonewright.operators import features, lexicon, outlook
from tonewright.operators.joins import join_lookup

GOLDEN = [
    ("Our bakery chain booked strong profit growth of 30%, well above its own plan.",
     15, 77, "strong profit growth", "", "plan", 0, 0, 1.0, 0.333333, 0.8, 0.7),
    ("Orders at the two shipyards declined sharply by 9% after weak freight and port disruptions.",
     15, 91, "", "declined weak disruptions", "", 0, 0, -1.0, 0, 0.6, 0.8),
    ("The mill did not show growth in spring.", 8, 39, "growth", "", "", 0, 1, -0.5, 0, 0.375, 0.55),
    ("The ferry line kept its usual timetable, with no change to its fares or forecasts.",
     15, 82, "", "", "forecasts", 0, 1, 0, 0.333333, 0.2, 0.3),
    ("Pending litigation could hurt the port, and new risks may arise from negatively worded contracts.",
     15, 97, "", "litigation risks negatively", "pending could may", 1, 0, -1.0, 1.0, 1.0, 0.5),
    ("Net profit of the dairy rose to EUR 4.2 mn from EUR 3.9 mn.", 13, 59, "profit rose", "", "", 0, 0,
     1.0, 0, 0.461538, 0.8),
    ("We can't say: sales hit $2.5 billion, up from $1,200,000. See www.x.com or a@b.c!",
     13, 66, "up", "", "", 0, 0, 1.0, 0, 0.230769, 0.8),
]


@pytest.mark.parametrize("case", GOLDEN, ids=range(len(GOLDEN)))
def test_goldens(texts, case):
    r = features.add_sentiment(features.extract_features(texts(case[0]))).first()
    got = (
        r.word_count, r.char_count, " ".join(r.positive_words), " ".join(r.negative_words),
        " ".join(r.uncertainty_words), r.litigious_word_count, r.negation_count,
        r.sentiment_score, round(r.uncertainty_score, 6), round(r.subjectivity_score, 6),
        round(r.confidence, 6),
    )
    assert got == case[1:]
    assert str(r.sentiment_score) != "-0.0"


def test_starter_lexicon():
    lists = Lexicon()
    assert len(lists.positive) > 100 and len(lists.negative) > 100 and len(lists.uncertainty) > 50
    assert "growth" in lists.positive and "loss" in lists.negative and "may" in lists.uncertainty


def test_join_form_equals_row_form(texts, spark):
    df = texts(*[g[0] for g in GOLDEN])
    table = Lexicon().table(spark)
    by_row = features.extract_features(df).select(
        "doc_id", *[f"{c}_word_count" for c in CATEGORIES]
    )
    by_row = {tuple(r) for r in by_row.collect() if any(r[1:])}
    words = lexicon.explode_words(df)
    for salts in (None, 5):
        matches = lexicon.match_lexicon(words, table, salts=salts)
        assert {tuple(r) for r in lexicon.lexicon_counts(matches).collect()} == by_row


def test_salted_join_keeps_every_row(spark):
    large = spark.range(1000).withColumn("k", F.when(F.col("id") < 400, 1).otherwise(F.col("id")))
    small = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = large.join(small, "k", how).collect()
        salted = join_lookup(large, small, ["k"], spread_by=["id"], how=how, salts=16)
        assert sorted(map(str, salted.select(*large.join(small, "k", how).columns).collect())) == \
            sorted(map(str, plain))


def test_lexicon_from_table_is_bounded(spark):
    table = spark.createDataFrame([("positive", "Gut"), ("negative", "schlecht")],
                                  "category string, term string")
    assert Lexicon.from_table(table).positive == ("gut",)
    with pytest.raises(ValueError):
        Lexicon.from_table(table, max_terms=1)


def test_null_text_gives_null_features(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    null, blank = features.analyze(df).orderBy("doc_id").collect()
    assert null.cleaned_text is None and null.sentiment.category is None
    assert null.sentiment.score is None and null.sentiment.confidence is None
    assert blank.sentiment.category == "neutral"


def test_null_texts_are_counted_apart(spark):
    df = spark.createDataFrame([(1, "Strong growth."), (2, None), (3, None)], "doc_id long, text string")
    r = outlook.aggregate_sentiment(features.add_sentiment(features.extract_features(df))).first()
    assert (r.total_texts, r.null_texts, r.neutral_count, r.positive_ratio) == (1, 2, 0, 1.0)


def test_aggregate(texts):
    df = texts("Strong growth.", "Severe decline.", "Flat results.")
    r = outlook.aggregate_sentiment(features.add_sentiment(features.extract_features(df))).first()
    assert (r.total_texts, r.positive_count, r.negative_count, r.neutral_count) == (3, 1, 1, 1)
    assert r.overall_trend == "mixed" and r.average_sentiment_score == 0
