"""Lexicon and entity features of a text column. Row-local: no shuffle, safe on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scores as S
from ..functions import text as T
from ..functions.lexicon import Lexicon, is_in, only

COUNTS = (
    "word_count", "char_count", "sentence_count", "avg_word_length",
    "positive_word_count", "negative_word_count", "uncertainty_word_count", "litigious_word_count",
)
SCORES = (
    "sentiment_score", "uncertainty_score", "subjectivity_score",
    "has_negation", "negation_count", "exclamation_count", "question_count",
)
LISTED = 10  # items of a list that the analysis record shows


def normalized_tokens(
    df: DataFrame,
    text: str = "text",
    lowercase: bool = True,
    remove_punctuation: bool = False,
    normalize_numbers: bool = True,
) -> DataFrame:
    """Add ``cleaned_text``, ``normalized_text``, ``tokens`` and ``words``."""
    return (
        df.withColumn("cleaned_text", T.clean_financial_text(F.col(text)))
        .withColumn(
            "normalized_text",
            T.normalize_text(
                F.col("cleaned_text"), lowercase, remove_punctuation, normalize_numbers
            ),
        )
        .withColumn("tokens", T.tokens(F.col("normalized_text")))
        .withColumn("words", T.lexical_words(F.col("normalized_text")))
    )


def lexicon_hits(df: DataFrame, lexicon: Lexicon, words: str = "words") -> DataFrame:
    """Add the three word lists and four counts. One pass finds all hits, the rest filter those."""
    union = tuple(sorted(set().union(*(lexicon.terms(c) for c in
                                       ("positive", "negative", "uncertainty", "litigious")))))
    hits = F.col("_hits")
    lists = {
        f"{c}_words": only(hits, lexicon.terms(c)) for c in ("positive", "negative", "uncertainty")
    }
    with_lists = (
        df.withColumn("_hits", only(F.col(words), union))
        .withColumns({**lists, "litigious_word_count": F.size(only(hits, lexicon.litigious))})
        .drop("_hits")
    )
    return with_lists.withColumns(
        {f"{c}_word_count": F.size(f"{c}_words") for c in ("positive", "negative", "uncertainty")}
    )


def extract_features(
    df: DataFrame,
    text: str = "text",
    lexicon: Lexicon | None = None,
    lowercase: bool = True,
    remove_punctuation: bool = False,
    normalize_numbers: bool = True,
    handle_negations: bool = True,
) -> DataFrame:
    """Add every text feature as a flat column."""
    raw, cleaned = F.col(text), F.col("cleaned_text")
    words, tokens = F.col("words"), F.col("tokens")
    base = normalized_tokens(df, text, lowercase, remove_punctuation, normalize_numbers)
    hits = lexicon_hits(base, lexicon or Lexicon())
    positive, negative = F.col("positive_word_count"), F.col("negative_word_count")
    uncertain, total = F.col("uncertainty_word_count"), F.col("word_count")

    sized = hits.withColumns(
        {
            "word_count": F.size(tokens),
            "char_count": F.length(cleaned),
            "sentence_count": T.sentence_count(cleaned),
            "avg_word_length": T.mean_token_length(tokens),
            "percentages": T.percentages(raw),
            "currencies": T.currencies(raw),
            "numbers": T.numbers(raw),
            "companies": T.companies(raw),
            "negation_count": F.size(F.filter(words, lambda w: is_in(w, P.NEGATION_WORDS))),
            "exclamation_count": T.count_char(raw, "!"),
            "question_count": T.count_char(raw, "?"),
        }
    )
    score = S.sentiment_score(positive, negative)
    if handle_negations:
        score = S.flip_for_negation(score, F.col("negation_count"))
    return sized.withColumns(
        {
            "sentiment_score": score,
            "uncertainty_score": S.uncertainty_score(uncertain, total),
            "subjectivity_score": S.subjectivity_score(positive + negative + uncertain, total),
            "has_negation": F.col("negation_count") > 0,
        }
    )


def add_sentiment(df: DataFrame) -> DataFrame:
    """Add ``category``, ``confidence`` and ``explanation`` to a frame with features."""
    return df.withColumns(
        {
            "category": S.sentiment_category(F.col("sentiment_score")),
            "confidence": S.lexicon_confidence(
                F.col("sentiment_score"), F.col("uncertainty_score"), F.col("negation_count")
            ),
            "explanation": explain_features(),
        }
    )


def _first_three(title: str, array: str) -> Column:
    listed = F.array_join(F.slice(F.col(array), 1, 3), ", ")
    return F.when(F.size(array) > 0, F.concat(F.lit(title), listed))


def explain_features() -> Column:
    """One line of text from the feature columns; parts that do not apply are left out."""
    score = F.col("sentiment_score")
    shown = F.concat(F.lit("(score: "), T.fixed(score, 2), F.lit(")"))
    uncertain = F.col("uncertainty_score") > 0.3
    # fixed values: wording of the feature explanation
    direction = (
        F.when(score > 0.3, F.concat(F.lit("Strong positive sentiment "), shown))
        .when(score > 0, F.concat(F.lit("Mildly positive sentiment "), shown))
        .when(score < -0.3, F.concat(F.lit("Strong negative sentiment "), shown))
        .when(score < 0, F.concat(F.lit("Mildly negative sentiment "), shown))
        .otherwise("Neutral sentiment")
    )
    negated = F.concat(
        F.lit("Contains "), F.col("negation_count").cast("string"),
        F.lit(" negation(s) - may flip sentiment"),
    )
    return F.concat_ws(
        " | ",
        direction,
        _first_three("Positive indicators: ", "positive_words"),
        _first_three("Negative indicators: ", "negative_words"),
        F.when(uncertain, F.lit("High uncertainty language detected")),
        F.when(uncertain, _first_three("Uncertainty words: ", "uncertainty_words")),
        F.when(F.col("has_negation"), negated),
        _first_three("Contains percentages: ", "percentages"),
        _first_three("Contains currency amounts: ", "currencies"),
    )


def entities() -> Column:
    """The entities of a frame with features as one record."""
    return F.struct("percentages", "currencies", "companies")


def analyze(df: DataFrame, text: str = "text", lexicon: Lexicon | None = None) -> DataFrame:
    """Nested analysis record per row: sentiment, features, entities, linguistic."""
    full = add_sentiment(extract_features(df, text, lexicon))
    capped = {n: F.slice(F.col(n), 1, LISTED).alias(n) for n in
              ("positive_words", "negative_words", "uncertainty_words", "numbers", "companies")}
    return full.select(
        *[F.col(c) for c in df.columns],
        "cleaned_text",
        F.struct(
            "category", F.col("sentiment_score").alias("score"), "confidence", "explanation"
        ).alias("sentiment"),
        F.struct(
            *COUNTS, capped["positive_words"], capped["negative_words"],
            capped["uncertainty_words"], "percentages", "currencies", capped["numbers"],
            capped["companies"], *SCORES,
        ).alias("features"),
        entities().alias("entities"),
        F.struct(
            "word_count", "sentence_count", "avg_word_length", "has_negation",
            "uncertainty_score", "subjectivity_score",
        ).alias("linguistic"),
    )


def lexicon_sentiment(df: DataFrame, text: str = "text", lexicon: Lexicon | None = None) -> DataFrame:
    """The short form: counts, score and word lists only."""
    full = extract_features(df, text, lexicon)
    return full.select(
        *[F.col(c) for c in df.columns],
        F.col("positive_word_count").alias("positive_count"),
        F.col("negative_word_count").alias("negative_count"),
        F.col("uncertainty_word_count").alias("uncertainty_count"),
        "sentiment_score", "positive_words", "negative_words", "uncertainty_words",
    )
