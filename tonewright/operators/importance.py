"""Word importance: TF-IDF times class coefficients, with lexicon words deciding the direction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scores as S
from ..functions import text as T
from ..functions.lexicon import Lexicon, is_in, only
from ..functions.wording import CAPITALISED
from .joins import join_lookup
from .tfidf import CLASSES, Vocabulary, at, constant_numbers, constant_strings, score_naive_bayes

COEFS = ("coef_neg", "coef_neu", "coef_pos")  # class order 0, 1, 2
ITEMS = "array<struct<word:string,score:double,direction:string>>"
RANK_DIGITS = 6  # scores are ranked to 1e-6, so equal scores tie whatever the summation order


def coef_lookup(
    weights: DataFrame, coefs: DataFrame, key: str = "doc_id", salts: int | None = None
) -> DataFrame:
    """Attach class coefficients to each text's terms; terms without coefficients drop out."""
    table = coefs.select("term", *COEFS)
    return join_lookup(weights, table, ["term"], spread_by=[key], salts=salts)


def word_direction(lexicon: Lexicon, with_coefs: bool = True, term: str = "term") -> Column:
    """Lexicon class of the first word, else the class of the largest coefficient, else neutral."""
    first = F.get(F.split(F.lower(F.col(term)), " "), F.lit(0))
    known = F.when(is_in(first, lexicon.positive), "positive").when(
        is_in(first, lexicon.negative), "negative"
    )
    if not with_coefs:
        return known.otherwise("neutral")
    negative, neutral, positive = (F.abs(F.col(c)) for c in COEFS)
    return (
        known.when((positive >= negative) & (positive >= neutral), "positive")
        .when(negative >= neutral, "negative")
        .otherwise("neutral")
    )


@dataclass(frozen=True)
class WordScores:
    """What importance needs of each vocabulary term: a factor for its weight (null: the term has
    no coefficients and drops out) and a direction."""

    vocabulary: Vocabulary
    factors: tuple[float | None, ...]
    directions: tuple[str, ...]


def word_scores(
    spark: SparkSession, vocabulary: Vocabulary, lexicon: Lexicon, coefs: DataFrame | None = None
) -> WordScores:
    """Factors and directions, computed once per term (the vocabulary is bounded)."""
    terms = spark.createDataFrame(
        pa.table({"no": range(len(vocabulary.terms)), "term": pa.array(vocabulary.terms, pa.string())}))
    if coefs is None:
        known, factor = terms, F.lit(1.0)
    else:
        known = terms.join(coefs.select("term", *COEFS), "term", "left")
        factor = F.greatest(*[F.abs(F.col(c)) for c in COEFS])
    rows = known.orderBy("no").select(
        factor.alias("factor"), word_direction(lexicon, coefs is not None).alias("direction")).collect()
    return WordScores(vocabulary, tuple(r.factor for r in rows), tuple(r.direction for r in rows))


def add_importance(rows: DataFrame, scores: WordScores, out: str = "importance") -> DataFrame:
    """Add ``(word, score, direction)`` of every term as an array, from the rows of
    :func:`weigh_rows`. A projection: no join, no shuffle."""
    if not scores.vocabulary.terms:
        return rows.withColumn(out, F.array().cast(ITEMS))
    words = constant_strings(scores.vocabulary.terms)
    factors = constant_numbers([float("nan") if f is None else f for f in scores.factors])
    directions = constant_strings(scores.directions)
    items = F.zip_with("term_no", "tfidf", lambda i, w: F.struct(
        at(words, i).alias("word"), (w * at(factors, i)).alias("score"),
        at(directions, i).alias("direction"),
    ))
    if any(f is None for f in scores.factors):
        items = F.filter(items, lambda x: ~F.isnan(x["score"]))
    return rows.withColumn(out, items)


def word_importance(rows: DataFrame, scores: WordScores, key: str = "doc_id") -> DataFrame:
    """``(key, word, score, direction)`` for every term of every text."""
    items = add_importance(rows, scores).select(key, F.inline_outer("importance"))
    return items.where(F.col("word").isNotNull())


def top_items(items: Column, k: int) -> Column:
    """The ``k`` most important items of an array; scores that tie to 1e-6 are put in order by word.
    A sort inside the row: no window, no shuffle."""
    ranked = F.sort_array(F.transform(items, lambda x: F.struct(
        (-F.round(x["score"], RANK_DIGITS)).alias("place"), x["word"].alias("word"), x.alias("item"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: x["item"])


def top_words_per_text(
    rows: DataFrame, scores: WordScores, k: int = 20, key: str = "doc_id"
) -> DataFrame:
    """The ``k`` most important words of each text, with ``rank``."""
    lists = importance_lists(rows, scores, k, key)
    out = lists.select(key, F.posexplode_outer("word_importance").alias("rank", "_x"))
    return out.where(F.col("_x").isNotNull()).select(key, "_x.*", (F.col("rank") + 1).alias("rank"))


def top_words_by_direction(
    rows: DataFrame, scores: WordScores, k: int = 5, top: int = 20, key: str = "doc_id"
) -> DataFrame:
    """The first ``k`` words of each direction among a text's ``top`` words, with their ``rank`` among these and
    their ``place`` in the direction. Lists are cut inside the row, so no window brings them together again."""
    ranked = importance_lists(rows, scores, top, key).select(key, F.transform(
        "word_importance", lambda x, i: F.struct(
            x["word"].alias("word"), x["score"].alias("score"), x["direction"].alias("direction"),
            (i + 1).alias("rank"))).alias("_ranked"))

    def first_of(side: str) -> Column:
        kept = F.slice(F.filter("_ranked", lambda x: x["direction"] == side), 1, k)
        return F.transform(kept, lambda x, i: F.struct(x.alias("item"), (i + 1).alias("place")))

    sides = [first_of(side) for side in ("positive", "negative", "neutral")]
    out = ranked.select(key, F.explode_outer(F.concat(*sides)).alias("_x"))
    return out.where(F.col("_x").isNotNull()).select(key, "_x.item.*", "_x.place")


def importance_lists(
    rows: DataFrame, scores: WordScores, k: int = 20, key: str = "doc_id", keep: Sequence[str] = ()
) -> DataFrame:
    """``key``, ``keep`` and a text's top words as one array in rank order.

    A term is ranked by one whole number out of the rounded score, the word's place in the alphabet and the term's
    place in the row; factors too large for that are ranked as :func:`top_items` does."""
    columns = [key, *[c for c in keep if c != key]]
    words, n = scores.vocabulary.terms, len(scores.vocabulary.terms)
    largest = max((abs(f) for f in scores.factors if f is not None), default=0.0)
    if not words or not (largest * 10 ** RANK_DIGITS + 1) * n * n < 2 ** 61:
        return add_importance(rows, scores).select(
            *columns, top_items(F.col("importance"), k).alias("word_importance"))
    factors = constant_numbers([float("nan") if f is None else f for f in scores.factors])
    alphabet = {word: place * n for place, word in enumerate(sorted(words))}
    order = constant_strings([str(alphabet[word]) for word in words]).cast("array<long>")
    scored = rows.select(*columns, "term_no", F.zip_with(
        "term_no", "tfidf", lambda i, w: w * at(factors, i)).alias("_scores"))

    def ranked(score: Column, i: Column) -> Column:
        place = F.floor(score * 10.0 ** RANK_DIGITS + 0.5) * F.lit(-n * n)
        return place + at(order, F.get("term_no", i)) + i

    ranks = F.transform("_scores", ranked)
    if any(f is None for f in scores.factors):
        ranks = F.array_compact(F.transform("_scores", lambda s, i: F.when(~F.isnan(s), ranked(s, i))))
    best = F.transform(F.slice(F.sort_array(ranks), 1, k), lambda x: F.pmod(x, F.lit(n)).cast("int"))
    names, directions = constant_strings(words), constant_strings(scores.directions)
    return scored.select(*columns, F.transform(best, lambda i: F.struct(
        at(names, F.get("term_no", i)).alias("word"), F.get("_scores", i).alias("score"),
        at(directions, F.get("term_no", i)).alias("direction"))).alias("word_importance"))


def append_unseen(ranked: Column, known: Column, lexicon_words: Column) -> Column:
    """Lexicon words that are not in ``known``, the words of ``ranked``, join its end with score
    0.1 (repeats included)."""
    unseen = T.let(known, lambda words: F.filter(lexicon_words, lambda w: ~F.array_contains(words, w)))
    extra = F.transform(unseen, lambda w: F.struct(w.alias("word"), F.lit(0.1).alias("score")))
    return F.concat(ranked, extra)


def _of_direction(array: str, direction: str) -> Column:
    kept = F.filter(F.col(array), lambda x: x["direction"] == direction)
    return F.transform(
        kept, lambda x: F.struct(x["word"].alias("word"), x["score"].alias("score"))
    )


def explain_words(
    texts: DataFrame,
    lexicon: Lexicon,
    text: str = "text",
    show: int = 5,
) -> DataFrame:
    """Texts with ``word_importance`` (:func:`importance_lists`): their lexicon words and the first
    ``show`` words of each direction are added. A projection."""
    words = T.lexical_words(F.col(text))
    with_words = texts.withColumn("_words", words).withColumns(
        {
            f"lexicon_{category}": only(F.col("_words"), lexicon.terms(category))
            for category in ("positive", "negative", "uncertainty")
        }
    )
    sides = ("positive", "negative")
    ranked = with_words.drop("_words").withColumns(
        {f"_{side}": _of_direction("word_importance", side) for side in sides})
    known = ranked.withColumns(
        {f"_{side}_known": F.transform(f"_{side}", lambda x: x["word"]) for side in sides})
    lists = {
        side: append_unseen(F.col(f"_{side}"), F.col(f"_{side}_known"), F.col(f"lexicon_{side}"))
        for side in sides
    }
    lists["neutral"] = _of_direction("word_importance", "neutral")
    told = known.withColumns({f"{side}_words": F.slice(x, 1, show) for side, x in lists.items()})
    return told.drop(*[f"_{side}" for side in sides], *[f"_{side}_known" for side in sides])


def explain_prediction(
    rows: DataFrame,
    scores: WordScores,
    model: DataFrame,
    priors: DataFrame,
    lexicon: Lexicon,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """A fitted model's class for each text with the words that speak for it: ``prediction`` (class
    name), ``probabilities`` in class order, and the lists of :func:`explain_words`. ``rows`` are rows of
    :func:`weigh_rows` that kept the text; everything is a projection of them."""
    vectors = ["term_no", "tf", "tfidf"]
    scored = score_naive_bayes(
        rows, scores.vocabulary, model, priors, key, keep=[text, *vectors])
    joint = F.array(*[F.col(f"jll_{c}") for c in CLASSES])
    told = scored.withColumn("probabilities", S.softmax(joint)).withColumn(
        "prediction", T.decode_label(F.col("prediction")))
    listed = importance_lists(told, scores, key=key, keep=[text, "prediction", "probabilities"])
    return explain_words(listed, lexicon, text)


def highlight_html(
    df: DataFrame, text: str = "text", top_words: str = "word_importance", top: int = 15, out: str = "html"
) -> DataFrame:
    """Add ``out``: the text with each word found among the first ``top`` important words in a
    coloured span. Words and colours are made once for a text; of words that differ only in case the last one decides."""
    first = F.slice(top_words, 1, top)
    pairs = F.transform(F.reverse(first), lambda x: F.struct(
        F.lower(x["word"]).alias("word"), _colour(x["direction"]).alias("colour")))

    def marked(word: Column, names: Column, pairs: Column) -> Column:
        bare = F.regexp_replace(F.lower(word), P.NOT_WORD, "")
        place = F.array_position(names, bare).cast("int")  # 0: not among them
        colour = F.get(pairs, place - 1)["colour"]
        # fixed values: span format
        opened = F.concat(
            F.lit('<span style="background-color: '), colour,
            F.lit('; padding: 2px 4px; border-radius: 3px;">'), word, F.lit("</span>"),
        )
        return F.coalesce(opened, word)

    words = T.let(pairs, lambda p: T.let(
        F.transform(p, lambda x: x["word"]),
        lambda names: F.transform(T.tokens(F.col(text)), lambda w: marked(w, names, p))))
    return df.withColumn(out, F.array_join(words, " "))


def _colour(direction: Column) -> Column:
    out = F.lit("#ffffff")
    for name, colour in P.HIGHLIGHT_COLOURS.items():
        out = F.when(direction == name, colour).otherwise(out)
    return out


def top_features_per_class(coefs: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` terms with the largest coefficient of each class."""
    stacked = coefs.select(
        "term",
        F.inline(F.array(*[
            F.struct(F.lit(name).alias("class"), F.col(c).alias("coef"))
            for name, c in zip(P.LABELS, COEFS)
        ])),
    )
    order = Window.partitionBy("class").orderBy(F.round("coef", RANK_DIGITS).desc(), "term")
    return stacked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def class_word_comparison(coefs: DataFrame, k: int = 5) -> DataFrame:
    """Top words of each class side by side, class names capitalised."""
    name = F.lit(None).cast("string")
    for plain, shown in CAPITALISED.items():
        name = F.when(F.col("class") == plain, shown).otherwise(name)
    return top_features_per_class(coefs, k).select(
        F.col("term").alias("word"), F.col("coef").alias("score"), name.alias("sentiment")
    )
