"""TF-IDF over 1- and 2-grams, and naive Bayes on it.

Texts never move: terms are counted inside their row, only combined ``(term, df, cf)`` counts are
shuffled, and weights are computed in the row from a vocabulary of at most ``max_features`` terms.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

CLASSES = range(len(P.LABELS))


def with_terms(df: DataFrame, keep: Sequence[str], text: str, out: str = "_terms") -> DataFrame:
    """``keep`` columns and the 1- and 2-grams of the text (empty for a null text)."""
    words = df.select(*keep, F.coalesce(T.term_words(F.col(text)), F.array()).alias("_words"))
    return words.select(*keep, T.with_pairs(F.col("_words")).alias(out))


def term_counts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, term, tf)`` for every 1- and 2-gram, without a shuffle: a row's terms are sorted
    and the lengths of their runs are the counts."""
    terms = with_terms(df, [key], text).select(key, F.sort_array("_terms").alias("_s"))
    n = F.size("_s")

    def begins(i: Column) -> Column:
        return (i == 0) | (F.get("_s", i) != F.get("_s", i - 1))

    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = terms.select(key, "_s", F.filter(every, begins).alias("_at"))
    counts = F.transform("_at", lambda at, i: F.struct(
        F.get("_s", at).alias("term"),
        (F.coalesce(F.get("_at", i + 1), n) - at).cast("long").alias("tf"),
    ))
    # the outer form keeps the planner from testing (and computing) the counts a second time
    exploded = starts.select(key, counts.alias("_c")).select(key, F.inline_outer("_c"))
    return exploded.where(F.col("tf").isNotNull())


def term_document_stats(counts: DataFrame) -> DataFrame:
    """Document and corpus frequency per term. Combined before the shuffle, so frequent words
    cost one row per partition."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def term_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of :func:`term_document_stats` straight from the texts: a text brings each of its terms once for ``df``
    and every occurrence for ``cf``, so no counts are made inside the row."""
    terms = with_terms(df, [], text).select("_terms", F.array_distinct("_terms").alias("_once"))
    # the outer form keeps the planner from computing the terms a second time
    told = terms.select(F.size("_once").alias("_n"), F.posexplode_outer(F.concat("_once", "_terms")).alias("_at", "term"))
    return told.where(F.col("term").isNotNull()).groupBy("term").agg(
        F.count_if(F.col("_at") < F.col("_n")).alias("df"), F.count_if(F.col("_at") >= F.col("_n")).alias("cf"))


def vocabulary(
    stats: DataFrame,
    texts: DataFrame,
    max_features: int = 10_000,
    min_df: int = 2,
    max_df: float = 0.95,
) -> DataFrame:
    """The ``max_features`` most frequent terms within the document-frequency limits, with
    smoothed idf. ``texts`` is the corpus the statistics came from (its rows are counted)."""
    n_docs = texts.agg(F.count("*")).scalar()
    kept = stats.withColumn("_n", n_docs).where(
        (F.col("df") >= min_df) & (F.col("df") <= F.col("_n") * max_df)
    )
    top = kept.orderBy(F.col("cf").desc(), "term").limit(max_features)
    idf = F.log((F.col("_n") + 1) / (F.col("df") + 1)) + 1
    return top.select("term", "df", "cf", idf.alias("idf"))


@dataclass(frozen=True)
class Vocabulary:
    """A fitted vocabulary: at most ``max_features`` terms, most frequent first, with their idf."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]

    @classmethod
    def collect(cls, vocab: DataFrame) -> "Vocabulary":
        """From the rows of :func:`vocabulary`, whose number ``max_features`` bounds."""
        rows = vocab.orderBy(F.col("cf").desc(), "term").select("term", "idf").collect()
        return cls(tuple(r.term for r in rows), tuple(r.idf for r in rows))


def fit_vocabulary(
    df: DataFrame, key: str = "doc_id", text: str = "text", **limits
) -> Vocabulary:
    return Vocabulary.collect(vocabulary(term_stats(df, text), df, **limits))


def constant_strings(values: Sequence[str]) -> Column:
    """An array constant of terms (which hold no line break)."""
    return F.split(F.lit("\n".join(values)), "\n")


def constant_numbers(values: Sequence[float]) -> Column:
    return constant_strings([repr(float(v)) for v in values]).cast("array<double>")


def at(constant: Column, position: Column) -> Column:
    return F.get(constant, position)


def weigh_rows(
    df: DataFrame,
    vocab: Vocabulary,
    key: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``key``, ``keep`` and three arrays of equal length: ``term_no`` (position in the
    vocabulary), ``tf`` and ``tfidf`` (unit length per text). A projection of the texts."""
    columns = [key, *[c for c in keep if c != key]]
    nothing = {"term_no": "array<int>", "tf": "array<long>", "tfidf": "array<double>"}
    if not vocab.terms:
        return df.select(*columns, *[F.array().cast(t).alias(n) for n, t in nothing.items()])
    counter = CountVectorizerModel.from_vocabulary(
        list(vocab.terms), inputCol="_terms", outputCol="_counts")
    counted = counter.transform(with_terms(df, columns, text))
    # vectors are weighed by compiled loops, arrays by lambdas that aren't compiled
    scaled = ElementwiseProduct(
        scalingVec=Vectors.dense(vocab.idf), inputCol="_counts", outputCol="_scaled").transform(counted)
    unit = Normalizer(inputCol="_scaled", outputCol="_unit").transform(scaled)
    raw = unit.select(
        *columns, F.unwrap_udt("_counts").alias("_c"), F.unwrap_udt("_unit").alias("_u"))
    return raw.select(
        *columns, F.col("_c.indices").alias("term_no"), F.col("_c.values").cast("array<long>").alias("tf"),
        F.col("_u.values").alias("tfidf"))


def exploded(rows: DataFrame, vocab: Vocabulary, key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """``(key, keep, term, tf, tfidf)``, one row per term of a text."""
    columns = [key, *[c for c in keep if c != key]]
    zipped = rows.select(*columns, F.inline_outer(F.arrays_zip("term_no", "tf", "tfidf")))
    known = zipped.where(F.col("term_no").isNotNull())
    term = at(constant_strings(vocab.terms), F.col("term_no"))
    return known.select(*columns, term.alias("term"), "tf", "tfidf")


def weigh(
    df: DataFrame, vocab: Vocabulary, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """``(key, keep, term, tf, tfidf)`` with unit length per text; no shuffle."""
    return exploded(weigh_rows(df, vocab, key, text, keep), vocab, key, keep)


def tfidf(df: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """Fit on ``df`` and weigh it."""
    return weigh(df, fit_vocabulary(df, key, text, **limits), key, text)


def class_priors(labels: DataFrame, label: str = "label") -> DataFrame:
    """One row with the log share of each class."""
    counted = F.count_if(F.col(label).isin(*CLASSES))
    return labels.agg(
        *[F.log(F.count_if(F.col(label) == c) / counted).alias(f"prior_{c}") for c in CLASSES]
    )


def fit_naive_bayes(weights: DataFrame, label: str = "label", alpha: float = 0.1) -> DataFrame:
    """Multinomial naive Bayes in closed form: one row per term with three log probabilities.

    ``weights`` are rows of :func:`weigh` that kept the label, so nothing is joined.
    """
    sums = weights.where(F.col(label).isNotNull()).groupBy("term").agg(
        *[F.sum(F.when(F.col(label) == c, F.col("tfidf")).otherwise(0.0)).alias(f"_s{c}")
          for c in CLASSES]
    )
    totals = sums.agg(
        F.struct(F.count("*").alias("terms"), *[F.sum(f"_s{c}").alias(f"s{c}") for c in CLASSES])
    ).scalar()
    with_totals = sums.withColumn("_t", totals)
    return with_totals.select(
        "term",
        *[
            F.log((F.col(f"_s{c}") + alpha) / (F.col(f"_t.s{c}") + F.col("_t.terms") * alpha))
            .alias(f"log_prob_{c}")
            for c in CLASSES
        ],
    )


def score_naive_bayes(
    rows: DataFrame,
    vocab: Vocabulary,
    model: DataFrame,
    priors: DataFrame,
    key: str = "doc_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Joint log likelihood and predicted class for every row of :func:`weigh_rows`; a text without
    known terms is decided by the priors. ``model`` has at most one row per vocabulary term, so it
    is taken along as three array constants and nothing is shuffled."""
    names = [f"log_prob_{c}" for c in CLASSES]
    logs = {r["term"]: r for r in model.select("term", *names).collect()}
    columns = [[logs[t][n] if t in logs else 0.0 for t in vocab.terms] for n in names]
    prior = priors.agg(
        F.struct(*[F.first(f"prior_{c}").alias(f"prior_{c}") for c in CLASSES])
    ).scalar()

    def likelihood(c: int) -> Column:
        if not vocab.terms:
            return F.lit(0.0)
        table = constant_numbers(columns[c])
        parts = F.zip_with("term_no", "tfidf", lambda i, w: w * at(table, i))
        return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)

    scored = rows.withColumn("_p", prior).select(
        key, *keep, *[(likelihood(c) + F.col(f"_p.prior_{c}")).alias(f"jll_{c}") for c in CLASSES])
    joint = F.array(*[F.col(f"jll_{c}") for c in CLASSES])
    best = (F.array_position(joint, F.array_max(joint)) - 1).cast("int")
    return scored.withColumn("prediction", best)


def naive_bayes_coefficients(model: DataFrame) -> DataFrame:
    """Log probabilities centred per term, as a class coefficient table."""
    mean = sum((F.col(f"log_prob_{c}") for c in CLASSES), F.lit(0.0)) / len(CLASSES)
    names = ("coef_neg", "coef_neu", "coef_pos")
    return model.select(
        "term", *[(F.col(f"log_prob_{c}") - mean).alias(names[c]) for c in CLASSES]
    )
