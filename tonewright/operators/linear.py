"""Explanations of fitted linear models: the weights are read out of a stored pipeline and applied inside the row.

A linear model over TF-IDF weights is a vocabulary with idf, and a row of coefficients and an intercept for each
class. Logistic regression, one-against-rest SVMs and naive Bayes have this form, alone or as members of an ensemble. A
term's contribution to the margin of a class is its weight times its coefficient; contributions and intercept
add up to the margin that the model itself computes.

A null text has no terms, so its margins are the intercepts. At most ``max_features`` terms come to the driver; texts
and weights never move.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LinearSVCModel, LogisticRegressionModel, NaiveBayesModel, OneVsRestModel,
)
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scores as S
from ..functions import text as T
from ..functions.lexicon import Lexicon
from . import importance
from .tfidf import Vocabulary, at, constant_numbers, constant_strings, weigh_rows

CONTRIBUTIONS = "array<struct<word:string,weight:double,by_class:array<double>>>"


@dataclass(frozen=True)
class LinearModel:
    """Vocabulary, three rows of coefficients (one number for each term) and three intercepts, in class order."""

    vocabulary: Vocabulary
    coefs: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]

    def coefficient_table(self, spark: SparkSession) -> DataFrame:
        """``term, coef_neg, coef_neu, coef_pos``: a row for each term."""
        return spark.createDataFrame(pa.table({
            "term": pa.array(self.vocabulary.terms, pa.string()),
            **{n: pa.array(c, pa.float64()) for n, c in zip(importance.COEFS, self.coefs)},
        }))


def linear_model(features: PipelineModel, classifier) -> LinearModel:
    """Read a linear model out of a feature pipeline and a fitted classifier."""
    counter = next(s for s in features.stages if isinstance(s, CountVectorizerModel))
    scaling = next(s for s in features.stages if isinstance(s, ElementwiseProduct)).getScalingVec()
    if isinstance(classifier, LogisticRegressionModel) and classifier.numClasses == len(P.LABELS):
        rows, intercepts = classifier.coefficientMatrix.toArray(), classifier.interceptVector.toArray()
    elif isinstance(classifier, NaiveBayesModel):
        rows, intercepts = classifier.theta.toArray(), classifier.pi.toArray()
    elif isinstance(classifier, OneVsRestModel) and all(isinstance(m, LinearSVCModel) for m in classifier.models):
        rows = [m.coefficients.toArray() for m in classifier.models]
        intercepts = [m.intercept for m in classifier.models]
    else:
        raise ValueError(f"{type(classifier).__name__} has no coefficients for each class")
    vocabulary = Vocabulary(tuple(counter.vocabulary), tuple(map(float, scaling.toArray())))
    return LinearModel(vocabulary, tuple(tuple(map(float, r)) for r in rows), tuple(map(float, intercepts)))


def add_contributions(rows: DataFrame, model: LinearModel, out: str = "contributions") -> DataFrame:
    """Add to rows of :func:`weigh_rows` every term with its weight and its contribution to each class."""
    if not model.vocabulary.terms:
        return rows.withColumn(out, F.array().cast(CONTRIBUTIONS))
    words = constant_strings(model.vocabulary.terms)
    tables = [constant_numbers(c) for c in model.coefs]
    return rows.withColumn(out, F.zip_with("term_no", "tfidf", lambda i, w: F.struct(
        at(words, i).alias("word"), w.alias("weight"), F.array(*[w * at(t, i) for t in tables]).alias("by_class"))))


def margins(model: LinearModel, contributions: str = "contributions") -> Column:
    """Contributions and intercept added up, for each class."""
    def total(number: int, intercept: float) -> Column:
        return F.aggregate(
            contributions, F.lit(0.0), lambda t, x: t + F.get(x["by_class"], F.lit(number))) + F.lit(intercept)

    return F.array(*[total(i, b) for i, b in enumerate(model.intercepts)])


def explain_linear(
    texts: DataFrame,
    model: LinearModel,
    lexicon: Lexicon,
    key: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] = (),
    k: int = 20,
) -> DataFrame:
    """The model's class for each text and the words behind it, as a projection of the texts.

    ``key``, ``keep`` and the text; ``margins``, ``probabilities`` and ``prediction`` (the class name);
    ``contributions`` of all terms; ``speaks_for``: the ``k`` words that raise the margin of the predicted class most over
    the mean of the classes; and the lists of :func:`importance.explain_words` with the coefficients' directions.
    """
    spark = texts.sparkSession
    scores = importance.word_scores(spark, model.vocabulary, lexicon, model.coefficient_table(spark))
    columns = [text, *[c for c in keep if c not in (key, text)]]
    rows = weigh_rows(texts, model.vocabulary, key, text, columns)
    told = add_contributions(rows, model)
    told = told.withColumn("margins", margins(model))
    told = told.withColumns({
        "probabilities": S.softmax(F.col("margins")), "class_no": S.argmax(F.col("margins"))})
    gains = F.transform("contributions", lambda x: F.struct(
        x["word"].alias("word"),
        (F.get(x["by_class"], F.col("class_no"))
         - F.aggregate(x["by_class"], F.lit(0.0), lambda t, v: t + v) / len(P.LABELS)).alias("score"),
        F.lit(None).cast("string").alias("direction")))
    best = importance.top_items(F.filter(gains, lambda x: x["score"] > 0), k)
    told = told.withColumn("speaks_for", F.transform(best, lambda x: F.struct(x["word"], x["score"])))
    told = told.withColumn("prediction", T.decode_label(F.col("class_no"))).drop("class_no")
    made = ["margins", "probabilities", "prediction", "contributions", "speaks_for"]
    listed = importance.importance_lists(told, scores, k, key, [*columns, *made])
    return importance.explain_words(listed, lexicon, text)
