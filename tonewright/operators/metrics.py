"""Evaluation: confusion counts, precision / recall / F1, error tables, leaderboards.

Every function starts from grouped counts, so only (model, truth, prediction) cells are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

METRICS = (
    "accuracy", "f1_macro", "f1_weighted", "precision_macro", "precision_weighted",
    "recall_macro", "recall_weighted",
)


def _cells(df: DataFrame, truth: str, prediction: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(
    df: DataFrame, truth: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """All 3 x 3 cells, zeros included."""
    spark = df.sparkSession
    size = len(P.LABELS)
    grid = spark.range(size * size).select(
        F.floor(F.col("id") / size).cast("int").alias("truth"),
        (F.col("id") % size).cast("int").alias("prediction"),
    )
    zeros = grid.withColumn("n", F.lit(0).cast("bigint"))
    cells = _cells(df, truth, prediction, []).unionByName(zeros)
    return cells.groupBy("truth", "prediction").agg(F.sum("n").alias("n"))


def per_class(
    df: DataFrame, truth: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall, F1 and support for each class seen in truth or prediction."""
    cells = _cells(df, truth, prediction, by)
    hit = F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0)
    nothing = F.lit(0).cast("bigint")
    roles = F.array(
        F.struct(F.col("truth").alias("class"), F.col("n").alias("support"),
                 nothing.alias("predicted"), hit.cast("bigint").alias("correct")),
        F.struct(F.col("prediction").alias("class"), nothing.alias("support"),
                 F.col("n").alias("predicted"), nothing.alias("correct")),
    )
    sums = cells.select(*by, F.inline(roles)).groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
        F.sum("correct").alias("correct"),
    )

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))

    rates = sums.withColumn("precision", share(F.col("correct"), F.col("predicted"))).withColumn(
        "recall", share(F.col("correct"), F.col("support"))
    )
    p, r = F.col("precision"), F.col("recall")
    return rates.withColumn("f1", share(2 * p * r, p + r))


def classification_metrics(
    df: DataFrame, truth: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy and macro / weighted precision, recall and F1; one row per ``by`` group."""
    rows = per_class(df, truth, prediction, by)
    total = F.sum("support")

    def weighted(name: str) -> Column:
        return F.sum(F.col(name) * F.col("support")) / total

    summary = [(F.sum("correct") / total).alias("accuracy")]
    for name in ("f1", "precision", "recall"):
        summary += [F.avg(name).alias(f"{name}_macro"), weighted(name).alias(f"{name}_weighted")]
    grouped = rows.groupBy(*by) if by else rows.groupBy()
    return grouped.agg(*summary).select(*by, *METRICS)


def classification_report(
    df: DataFrame, truth: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Per-class rows followed by accuracy, macro and weighted averages."""
    rows = per_class(df, truth, prediction)
    classes = rows.select(
        T.decode_label(F.col("class")).alias("name"), "precision", "recall", "f1", "support"
    )
    total = F.sum("support")
    macro = rows.agg(
        F.lit("macro avg").alias("name"),
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], total.alias("support"),
    )
    weighted = rows.agg(
        F.lit("weighted avg").alias("name"),
        *[(F.sum(F.col(c) * F.col("support")) / total).alias(c)
          for c in ("precision", "recall", "f1")],
        total.alias("support"),
    )
    accuracy = rows.agg(
        F.lit("accuracy").alias("name"),
        *[F.lit(None).cast("double").alias(c) for c in ("precision", "recall")],
        (F.sum("correct") / total).alias("f1"), total.alias("support"),
    )
    return classes.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def error_patterns(
    df: DataFrame, truth: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Mistakes by kind, named ``true_as_predicted``; kinds that do not occur are absent."""
    counted = df.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(
        F.count_if(F.col(truth) != F.col(prediction)).alias("n")
    )
    wrong = counted.where(F.col("n") > 0)  # a test on the count cannot sink into the scoring
    kind = F.concat(
        T.decode_label(F.col("truth")), F.lit("_as_"), T.decode_label(F.col("prediction"))
    )
    return wrong.select(kind.alias("pattern"), "n").orderBy(F.col("n").desc(), "pattern")


def error_analysis(
    df: DataFrame, truth: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row: sample size, errors, error rate and the insights that the patterns support."""
    negative, neutral, positive = (F.lit(i) for i in range(3))
    t, p = F.col("truth"), F.col("prediction")
    wrong = t != p
    # fixed values: wording of the insights
    insights = (
        (F.max((t == neutral) & wrong), "Neutral class is often confused with positive/negative"),
        (F.max((t == positive) & (p == neutral)),
         "Some positive texts lack strong positive indicators"),
        (F.max((t == negative) & (p == neutral)),
         "Some negative texts have subtle negative sentiment"),
    )
    errors = F.sum(F.when(wrong, F.col("n")).otherwise(0))
    return _cells(df, truth, prediction, []).agg(
        F.sum("n").alias("n_samples"),
        errors.alias("total_errors"),
        (errors / F.sum("n")).alias("error_rate"),
        F.concat_ws("; ", *[F.when(seen, F.lit(words)) for seen, words in insights]).alias(
            "insights"
        ),
    )


def error_samples(
    df: DataFrame,
    n: int = 10,
    truth: str = "label",
    prediction: str = "prediction",
    text: str = "text",
    order: str = "doc_id",
    preview: int = 80,
) -> DataFrame:
    """The first ``n`` mistakes in ``order``."""
    row = F.struct(order, text, truth, prediction)
    missed = F.when(F.col(truth) != F.col(prediction), F.array(row))
    # the test sits in a generator, so it is not copied below the projections that score a text
    rows = df.select(F.inline_outer(missed)).where(F.col(truth).isNotNull())
    wrong = rows.orderBy(order).limit(n)
    return wrong.select(
        order, text, T.preview(F.col(text), preview).alias("shown"),
        T.decode_label(F.col(truth)).alias("true_label"),
        T.decode_label(F.col(prediction)).alias("pred_label"),
    )


def leaderboard(metrics: DataFrame, name: str = "name") -> DataFrame:
    """Models by macro F1, best first. ``metrics`` has one row per model."""
    best_first = Window.partitionBy().orderBy(F.col("f1_macro").desc(), name)
    return metrics.withColumn("rank", F.row_number().over(best_first)).orderBy("rank")


def best_model(metrics: DataFrame, name: str = "name") -> DataFrame:
    """The model with the highest macro F1 (first by name among equals)."""
    top = metrics.orderBy(F.col("f1_macro").desc(), name).limit(1)
    return top.select(name, "f1_macro")


def union_results(*results: DataFrame) -> DataFrame:
    """Metric rows of several families in one table."""
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
