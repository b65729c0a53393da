"""Metric records as JSON lines, and the registry of known models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.metrics import METRICS

METRIC_SCHEMA = "name string, " + ", ".join(f"{m} double" for m in METRICS)
INFO_SCHEMA = (
    "model string, name string, type string, accuracy string, f1_macro string, "
    "f1_weighted string, speed string, features array<string>"
)

UNKNOWN = "N/A"
_TERMS = "words and word pairs weighed by TF-IDF, at most 10,000 of them"
_BALANCED = "rare classes weigh more"

# key, name, kind, what the model of this library does; figures come from stored measurements only
MODELS = tuple(
    (key, name, kind, UNKNOWN, UNKNOWN, UNKNOWN, UNKNOWN, facts)
    for key, name, kind, facts in (
        ("baseline_logreg", "Multinomial logistic regression", "linear",
         [_TERMS, _BALANCED, "one weight per term and class", "solver stops at tolerance 1e-4"]),
        ("baseline_naive_bayes", "Multinomial naive Bayes", "count-based",
         [_TERMS, "smoothing 0.1"]),
        ("baseline_svm", "Linear support vector machine", "linear",
         [_TERMS, _BALANCED, "one class against the rest", "margins become shares by softmax"]),
        ("baseline_random_forest", "Random forest", "trees",
         [_TERMS, _BALANCED, "200 trees of depth 30 at most", "at least 2 rows in a leaf"]),
        ("baseline_gradient_boosting", "Gradient-boosted trees", "trees",
         [_TERMS, "one class against the rest", "100 rounds of depth 5, step 0.1"]),
        ("baseline_mlp", "Neural network", "neural",
         [_TERMS, "hidden layers of 256 and 128 units", "solver stops at tolerance 1e-4"]),
        ("baseline_ensemble", "Mean of three models", "ensemble",
         ["logistic regression, calibrated support vector machine and random forest",
          "mean of their probabilities"]),
        ("finbert_pretrained", "Pretrained transformer", "external",
         ["scored by a function that the caller supplies"]),
    )
)
PRETRAINED = "finbert_pretrained"
FINE_TUNED = ("finbert", "distilbert", "roberta", "bert")


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.select("name", *METRICS).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).json(path)


def registry(spark: SparkSession) -> DataFrame:
    """The known models as a table."""
    return spark.createDataFrame(list(MODELS), INFO_SCHEMA)


def model_info(names: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Information for every row of ``names`` (column ``model``).

    Figures are shown once they have been measured, ``N/A`` before; a model that is not known has
    the type ``Unknown``.
    """
    known = registry(names.sparkSession)
    out = names.select("model").distinct().join(F.broadcast(known), "model", "left")
    if metrics is None:
        measured = [F.lit(None).cast("string")] * 3
    else:
        figures = metrics.select(
            F.col("name").alias("model"),
            T.percent(F.col("accuracy")).alias("_acc"),
            T.fixed(F.col("f1_macro"), 3).alias("_macro"),
            T.fixed(F.col("f1_weighted"), 3).alias("_weighted"),
        )
        out = out.join(figures, "model", "left")
        measured = [F.col("_acc"), F.col("_macro"), F.col("_weighted")]
    missing = F.lit("N/A")
    return out.select(
        "model",
        F.coalesce("name", "model").alias("name"),
        F.coalesce("type", F.lit("Unknown")).alias("type"),
        F.coalesce(measured[0], F.col("accuracy"), missing).alias("accuracy"),
        F.coalesce(measured[1], F.col("f1_macro"), missing).alias("f1_macro"),
        F.coalesce(measured[2], F.col("f1_weighted"), missing).alias("f1_weighted"),
        F.coalesce("speed", missing).alias("speed"),
        F.coalesce("features", F.array().cast("array<string>")).alias("features"),
    )
