"""Sigmoids that turn margins into probabilities, fitted by Newton steps for all folds and classes at once.

For a class with ``p`` rows in a fold and ``q`` others the targets are ``(p + 1) / (p + 2)`` and ``1 / (q + 2)`` instead of 1 and
0, so margins that part the classes without a mistake still have a finite line. An iteration is one job: the losses,
gradients and second derivatives of all lines are sums over the stored margins. A step that raises a
line's loss is halved.

Rows with a null margin or a label that is no class are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

ROUNDS = 60
NEAR = 1e-12  # of a step, relative to the line


def stacked_margins(margins: DataFrame, label: str = "label", array: str = "margins", fold: str = "fold") -> DataFrame:
    """``fold, class, margin, hit``: a row for each class of each row."""
    known = margins.where(F.col(label).isin(*range(len(P.LABELS))))
    stacked = known.select(
        F.col(fold).alias("fold"), F.col(label).alias("truth"), F.posexplode(array).alias("class", "margin"))
    return stacked.where("margin is not null").select("fold", "class", "margin", (F.col("truth") == F.col("class")).alias("hit"))


def fit_sigmoids(stacked: DataFrame) -> dict[tuple, tuple[float, float]]:
    """Slope and intercept of each ``(fold, class)`` of :func:`stacked_margins`: the probability is
    ``1 / (1 + exp(-(slope * margin + intercept)))``. ``stacked`` should be stored: every iteration reads it."""
    spark = stacked.sparkSession
    counts = stacked.groupBy("fold", "class").agg(F.count_if("hit").alias("p"), F.count_if(~F.col("hit")).alias("q"))
    targets = {
        (r["fold"], r["class"]): ((r["p"] + 1) / (r["p"] + 2), 1 / (r["q"] + 2), math.log((r["p"] + 1) / (r["q"] + 1)))
        for r in counts.collect()  # one row for each line
    }
    lines = {k: (0.0, prior) for k, (_, _, prior) in targets.items()}
    steps = {k: (0.0, 0.0) for k in lines}
    losses = {k: math.inf for k in lines}
    open_lines = set(lines)
    fold_kind, class_kind = stacked.schema["fold"].dataType.simpleString(), stacked.schema["class"].dataType.simpleString()
    kind = f"fold {fold_kind}, class {class_kind}, slope double, intercept double, high double, low double"
    for _ in range(ROUNDS):
        if not open_lines:
            break
        rows = [(*k, *lines[k], *targets[k][:2]) for k in open_lines]
        for r in _sums(stacked.join(F.broadcast(spark.createDataFrame(rows, kind)), ["fold", "class"])).collect():
            k = (r["fold"], r["class"])
            (slope, intercept), (ds, di) = lines[k], steps[k]
            if r["loss"] > losses[k] + 1e-12 * abs(losses[k]):  # went too far
                steps[k] = (ds / 2, di / 2)
                lines[k] = (slope - ds / 2, intercept - di / 2)
            else:
                losses[k] = r["loss"]
                det = r["hss"] * r["hii"] - r["hsi"] ** 2
                if det <= 1e-14 * max(r["hss"] * r["hii"], 1e-300):  # all margins are equal: the intercept alone
                    ds, di = 0.0, -r["gi"] / max(r["hii"], 1e-300)
                else:
                    ds = -(r["hii"] * r["gs"] - r["hsi"] * r["gi"]) / det
                    di = -(r["hss"] * r["gi"] - r["hsi"] * r["gs"]) / det
                steps[k], lines[k] = (ds, di), (slope + ds, intercept + di)
            if max(abs(x) for x in steps[k]) <= NEAR * (1 + max(abs(x) for x in lines[k])):
                open_lines.discard(k)
    return lines


def _sums(rows: DataFrame) -> DataFrame:
    """Loss, gradient and second derivatives of every line."""
    x = F.col("slope") * F.col("margin") + F.col("intercept")
    told = rows.withColumn("x", x).withColumn("t", F.when(F.col("hit"), F.col("high")).otherwise(F.col("low")))
    # log(1 + exp(x)) without overflow
    soft = F.greatest("x", F.lit(0.0)) + F.log1p(F.exp(-F.abs("x")))
    told = told.withColumns({"share": 1 / (1 + F.exp(-F.col("x"))), "loss": soft - F.col("t") * F.col("x")})
    told = told.withColumns({"g": F.col("share") - F.col("t"), "h": F.col("share") * (1 - F.col("share"))})
    m = F.col("margin")
    return told.groupBy("fold", "class").agg(
        F.sum("loss").alias("loss"), F.sum(F.col("g") * m).alias("gs"), F.sum("g").alias("gi"),
        F.sum(F.col("h") * m * m).alias("hss"), F.sum(F.col("h") * m).alias("hsi"), F.sum("h").alias("hii"))
