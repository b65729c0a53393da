"""Lexicon matching as a join, for word lists of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import CATEGORIES
from .joins import join_lookup


def explode_words(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per lexical word of the normalized text: ``(key, position, term)``."""
    cleaned = df.select(key, T.clean_financial_text(F.col(text)).alias("_cleaned"))
    normalized = T.normalize_text(F.col("_cleaned"))
    words = cleaned.select(key, T.lexical_words(normalized).alias("_words"))
    # the outer form keeps the planner from testing (and computing) the words a second time
    exploded = words.select(key, F.posexplode_outer("_words").alias("position", "term"))
    return exploded.where(F.col("term").isNotNull())


def match_lexicon(
    words: DataFrame, lexicon_table: DataFrame, key: str = "doc_id", salts: int | None = None
) -> DataFrame:
    """Words that occur in the lexicon, once per category: adds ``category``."""
    lookup = lexicon_table.select(F.lower("term").alias("term"), "category").distinct()
    return join_lookup(words, lookup, ["term"], spread_by=[key, "position"], salts=salts)


def lexicon_counts(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits per category and text, for texts with at least one hit."""
    counts = [
        F.count_if(F.col("category") == c).cast("int").alias(f"{c}_word_count") for c in CATEGORIES
    ]
    return matches.groupBy(key).agg(*counts)


def lexicon_word_lists(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits per text in reading order, as one string per category."""
    def in_order(category: str):
        hit = F.when(F.col("category") == category, F.struct("position", "term"))
        ordered = F.array_sort(F.collect_list(hit))
        return F.array_join(F.transform(ordered, lambda x: x["term"]), " ")

    names = ("positive", "negative", "uncertainty")
    return matches.groupBy(key).agg(*[in_order(c).alias(f"{c}_words") for c in names])
