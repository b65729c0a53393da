"""TF-IDF features and classifiers as Spark ML pipelines.

The vocabulary (at most ``max_features`` rows) and class weights (three numbers) come to the
driver, because estimators take them as parameters; texts and vectors never do.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    LogisticRegressionModel,
    NaiveBayes,
    OneVsRest,
    OneVsRestModel,
)
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.util import inheritable_thread_target

from ..functions import patterns as P
from ..functions import scores as S
from ..functions.lexicon import Lexicon
from ..operators import tfidf
from ..operators.corpus import class_weights
from ..operators.linear import LinearModel, explain_linear, linear_model
from ..operators.metrics import METRICS, classification_metrics, union_results
from ..session import materialize
from ..sources.metrics_store import FINE_TUNED, METRIC_SCHEMA, PRETRAINED
from . import boosting, calibration, forest, network
from .scoring import prediction_record, score_external, soft_vote

log = logging.getLogger(__name__)

CLASSIFIERS = ("logreg", "naive_bayes", "svm", "random_forest", "gradient_boosting", "mlp")
LINEAR = ("logreg", "naive_bayes", "svm")
SEED = 42
# fixed values: tokens of a text that these models are given
MAX_TOKENS = {"pretrained": 512, "fine_tuned": 128}


def fit_features(
    train: DataFrame,
    text: str = "sentence",
    key: str = "doc_id",
    max_features: int = 10_000,
    min_df: int = 2,
    max_df: float = 0.95,
) -> PipelineModel:
    """Text to a unit-length TF-IDF vector in ``features``; a saveable pipeline."""
    vocab = tfidf.fit_vocabulary(
        train, key, text, max_features=max_features, min_df=min_df, max_df=max_df)
    terms, idf = list(vocab.terms), list(vocab.idf)
    return PipelineModel(stages=[
        RegexTokenizer(inputCol=text, outputCol="words", pattern=P.TERM, gaps=False),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
        CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="counts"),
        ElementwiseProduct(scalingVec=DenseVector(idf), inputCol="counts", outputCol="weighted"),
        Normalizer(p=2.0, inputCol="weighted", outputCol="features"),
    ])


def vectors(features: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and the feature vector; a null text has the vector of an empty one."""
    return features.transform(without_nulls(df, text_column(features))).select(*keep, "features")


def without_nulls(df: DataFrame, text: str) -> DataFrame:
    """Tokenizers of pipelines end their task at a null text."""
    return df.withColumn(text, F.coalesce(text, F.lit("")))


ROWS_PER_TASK = 2_000


def training_vectors(features: PipelineModel, train: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Feature vectors for the solvers, which run very many short jobs: small sets are held in few
    partitions, so a job is not mostly the start of its tasks. Large ones keep theirs."""
    rows = vectors(features, train, keep)
    return rows.coalesce(max(1, -(-train.count() // ROWS_PER_TASK)))


def with_weights(df: DataFrame, label: str = "label") -> tuple[DataFrame, int]:
    """Add balanced class weights in ``weight``; also the number of rows."""
    known = df.where(F.col(label).isin(*range(len(P.LABELS))))
    by_class = class_weights(known, label).collect()  # one row per class
    weight = F.lit(1.0)
    for row in by_class:
        weight = F.when(F.col(label) == row[label], row["weight"]).otherwise(weight)
    return known.withColumn("weight", weight), sum(r["n"] for r in by_class)


def classifier(name: str, n_rows: int, **changes) -> Estimator:
    """An estimator with the standard parameters; ``changes`` replace some of them.

    Where Spark differs: regularisation is per row (hence ``1 / n_rows``).
    Trees and the neural network are not among them: see :mod:`forest`, :mod:`boosting` and :mod:`network`.
    """
    def merged(**standard):
        return {**standard, **changes}

    linear = {"regParam": 1.0 / n_rows, "standardization": False, "maxIter": 1000, "tol": 1e-4}
    if name == "logreg":
        return LogisticRegression(weightCol="weight", **merged(family="multinomial", **linear))
    if name == "naive_bayes":
        return NaiveBayes(**merged(smoothing=0.1))
    if name == "svm":
        return OneVsRest(
            classifier=LinearSVC(weightCol="weight", **merged(**linear)), weightCol="weight",
            parallelism=len(P.LABELS),  # a fit is very many short jobs, each far from using all cores
        )
    raise ValueError(f"unknown classifier {name!r}; use one of {CLASSIFIERS}")


def fit_classifier(name: str, data: DataFrame, **changes) -> list[Model]:
    """Fit on ``features, label``; the stages to append to the feature pipeline."""
    weighted, n_rows = with_weights(data)
    return [classifier(name, n_rows, **changes).fit(weighted)]


def probability_array(scored: DataFrame) -> Column:
    """Class probabilities of a scored frame; margins go through softmax."""
    if "probabilities" in scored.columns:
        return F.col("probabilities")
    if "probability" in scored.columns:
        return vector_to_array(F.col("probability"))
    return S.softmax(vector_to_array(F.col("rawPrediction")))


def score(model, df: DataFrame) -> DataFrame:
    """``df`` with a ``prediction`` record from a fitted pipeline or ensemble; a null text is scored as an empty one."""
    text = text_column(model)
    scored = model.transform(without_nulls(df.withColumn("_given", F.col(text)), text))
    record = prediction_record(F.col("_given"), probability_array(scored), F.col("prediction"))
    own = [F.col("_given").alias(c) if c == text else F.col(c) for c in df.columns]
    return scored.select(*own, record.alias("prediction"))


def text_column(model) -> str:
    pipeline = model if isinstance(model, PipelineModel) else model.features
    return pipeline.stages[0].getInputCol()


def evaluate_model(name: str, model, df: DataFrame, label: str = "label") -> DataFrame:
    """One metric row for a model on labelled rows."""
    scored = score(model, df).select(
        F.lit(name).alias("name"), F.col(label).alias("truth"),
        F.col("prediction.prediction").alias("predicted"),
    )
    return classification_metrics(scored, "truth", "predicted", by=["name"])


def compare_models(models: dict, df: DataFrame) -> DataFrame:
    """Metric rows of all models with ``error``: null, or why a model has no metrics."""
    rows = []
    for name, model in models.items():
        try:
            measured = materialize(evaluate_model(name, model, df))
            rows.append(measured.withColumn("error", F.lit(None).cast("string")))
        except Exception as error:  # noqa: BLE001 - one broken model must not hide the others
            log.exception("could not evaluate %s", name)
            told = f"{type(error).__name__}: {error}"[:500]
            rows.append(df.sparkSession.createDataFrame(
                [(name, *[None] * len(METRICS), told)], f"{METRIC_SCHEMA}, error string"))
    if not rows:
        raise ValueError("no model to evaluate")
    return union_results(*rows)


def _fitted(name: str, features: PipelineModel, data: DataFrame, **changes):
    """A classifier fitted on feature vectors, together with the feature pipeline."""
    own = {"random_forest": forest.fit, "gradient_boosting": boosting.fit, "mlp": network.fit}.get(name)
    if own is not None:
        return own(features, data, **changes)
    return PipelineModel(stages=features.stages + fit_classifier(name, data, **changes))


def train_model(name: str, train: DataFrame, text: str = "sentence", features=None, **changes):
    """Fit one classifier on ``doc_id, text, label``; returns the whole pipeline."""
    features = features or fit_features(train, text)
    data = training_vectors(features, train, ["label"]).persist()
    try:
        return _fitted(name, features, data, **changes)
    finally:
        data.unpersist()


def train_all(
    train: DataFrame, names: Sequence[str] = CLASSIFIERS, text: str = "sentence", changes=None
) -> dict[str, PipelineModel | forest.ForestModel | boosting.BoostedModel | network.NetworkModel]:
    """Fit several classifiers on one set of cached feature vectors."""
    features = fit_features(train, text)
    data = training_vectors(features, train, ["label"]).persist()
    try:
        return {
            name: _fitted(name, features, data, **(changes or {}).get(name, {})) for name in names
        }
    finally:
        data.unpersist()


def with_folds(data: DataFrame, key: str, folds: int, label: str = "label") -> DataFrame:
    """Add ``_fold``: every class is shared out evenly, by cuts through the order of a hash.

    The cuts are exact quantiles of a 16-bit hash for each class, counted in an aggregate; no
    class is sorted.
    """
    hashed = data.where(F.col(label).isin(*range(len(P.LABELS)))).withColumn(
        "_hash", F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1 << 16)).cast("int"))
    cuts = hashed.groupBy(label).agg(F.percentile("_hash", [i / folds for i in range(1, folds)]).alias("_cuts"))
    placed = hashed.join(F.broadcast(cuts), label)  # one row per class
    fold = F.size(F.filter("_cuts", lambda c: F.col("_hash") > c))
    return placed.withColumn("_fold", fold).drop("_hash", "_cuts")


# --- ensemble -----------------------------------------------------------------------------------

@dataclass
class CalibratedSvm:
    """Margins of several one-against-rest SVMs, each turned into probabilities by a sigmoid."""

    members: list[OneVsRestModel]
    sigmoids: list[list[tuple[float, float]]] = field(default_factory=list)  # slope, intercept

    @classmethod
    def fit(cls, data: DataFrame, key: str = "doc_id", folds: int = 3, **changes) -> "CalibratedSvm":
        """Fit on ``key, features, label``: each fold calibrates the SVM of the other folds. Folds are fitted side by side."""
        placed = with_folds(data, key, folds).persist()
        held_out = []

        def member(fold: int) -> OneVsRestModel:
            # weights and penalty come from the rows that the member sees
            seen, n_rows = with_weights(placed.where(F.col("_fold") != fold))
            return classifier("svm", n_rows, **changes).fit(seen)

        try:
            with ThreadPoolExecutor(folds) as pool:
                waiting = [pool.submit(inheritable_thread_target(data.sparkSession)(member), fold) for fold in range(folds)]
            members = [fitted.result() for fitted in waiting]
            for fold in range(folds):
                scored = members[fold].transform(placed.where(F.col("_fold") == fold))
                held_out.append(scored.select(
                    F.lit(fold).alias("fold"), "label", vector_to_array("rawPrediction").alias("margins")))
            margins = materialize(calibration.stacked_margins(reduce(DataFrame.unionByName, held_out)))
        finally:
            placed.unpersist()
        lines = calibration.fit_sigmoids(margins)
        unknown = (1.0, 0.0)  # a class without a row in a fold
        return cls(members, [[lines.get((f, c), unknown) for c in range(len(P.LABELS))] for f in range(folds)])

    def add_probabilities(self, df: DataFrame, out: str) -> DataFrame:
        """Mean over the members of their normalised sigmoid probabilities."""
        columns = df.columns
        for i, (member, lines) in enumerate(zip(self.members, self.sigmoids)):
            scored = member.transform(df)
            margins = vector_to_array(F.col("rawPrediction"))
            raw = F.array(*[
                1 / (1 + F.exp(-(F.get(margins, F.lit(c)) * slope + intercept)))
                for c, (slope, intercept) in enumerate(lines)
            ])
            df = scored.select(*columns, *[f"_raw{j}" for j in range(i)], raw.alias(f"_raw{i}"))
        parts = [_normalised(F.col(f"_raw{i}")) for i in range(len(self.members))]
        return df.select(*columns, soft_vote(parts).alias(out))


def _normalised(array: Column) -> Column:
    total = F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(array, lambda x: x / total)


@dataclass
class SoftVoteModel:
    """Mean probability of logistic regression, calibrated SVM and random forest."""

    features: PipelineModel
    logreg: LogisticRegressionModel
    svm: CalibratedSvm
    forest: forest.ForestModel

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction`` and ``probabilities``."""
        columns = df.columns
        base = vectors(self.features, df, columns)
        base = self.svm.add_probabilities(base, "_svm")
        kept = base.columns
        base = self.logreg.transform(base).select(*kept, vector_to_array("probability").alias("_logreg"))
        base = self.forest.add_probabilities(base, "_forest")
        voted = soft_vote([F.col("_logreg"), F.col("_svm"), F.col("_forest")])
        voted_rows = base.select(*columns, voted.alias("probabilities"))
        return voted_rows.withColumn("prediction", S.argmax(F.col("probabilities")))

    def save(self, path: str) -> None:
        self.features.write().overwrite().save(f"{path}/features")
        self.logreg.write().overwrite().save(f"{path}/logreg")
        self.forest.save(f"{path}/forest")
        for i, member in enumerate(self.svm.members):
            member.write().overwrite().save(f"{path}/svm{i}")
        spark = SparkSession.getActiveSession()
        lines = pa.table({"value": [json.dumps(self.svm.sigmoids)]})
        spark.createDataFrame(lines).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, path: str) -> "SoftVoteModel":
        spark = SparkSession.getActiveSession()
        sigmoids = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
        members = [OneVsRestModel.load(f"{path}/svm{i}") for i in range(len(sigmoids))]
        return cls(
            PipelineModel.load(f"{path}/features"),
            LogisticRegressionModel.load(f"{path}/logreg"),
            CalibratedSvm(members, [[tuple(x) for x in fold] for fold in sigmoids]),
            forest.ForestModel.load(f"{path}/forest"),
        )


def train_ensemble(
    train: DataFrame, text: str = "sentence", key: str = "doc_id", changes=None
) -> SoftVoteModel:
    """Fit the three members on one set of cached feature vectors."""
    changes = changes or {}
    features = fit_features(train, text, key)
    data = training_vectors(features, train, [key, "label"]).persist()
    try:
        of_forest = {"numTrees": 100, "maxDepth": 30, "minRows": 2}
        return SoftVoteModel(
            features,
            fit_classifier("logreg", data, **changes.get("logreg", {}))[-1],
            CalibratedSvm.fit(data, key, **changes.get("svm", {})),
            forest.fit(features, data, **{**of_forest, **changes.get("forest", {})}),
        )
    finally:
        data.unpersist()


# --- storage ------------------------------------------------------------------------------------

def versions(spark: SparkSession, path: str, name: str) -> list[tuple[int, str]]:
    """Number and folder of every published version of ``path/baseline_<name>``, the newest last."""
    try:
        rows = spark.read.text(f"{path}/baseline_{name}/manifests/*").collect()  # one for each version
    except AnalysisException:
        return []
    return sorted((m["version"], m["folder"]) for m in (json.loads(r["value"]) for r in rows))


def save_model(model, path: str, name: str) -> int:
    """Store as the next version of ``path/baseline_<name>``; returns its number.

    The model is written to a folder of its own, and a manifest that names the folder is published when all of it
    is there: a file that appears by a rename. A save that breaks off leaves the versions before as they were.
    """
    spark = SparkSession.getActiveSession()
    known = versions(spark, path, name)
    number, folder = (known[-1][0] + 1 if known else 1), f"versions/{uuid.uuid4().hex}"
    where = f"{path}/baseline_{name}"
    if isinstance(model, PipelineModel):
        model.write().save(f"{where}/{folder}")
    else:
        model.save(f"{where}/{folder}")
    manifest = pa.table({"value": [json.dumps({"version": number, "folder": folder})]})
    spark.createDataFrame(manifest).coalesce(1).write.text(f"{where}/manifests/{number:06d}-{uuid.uuid4().hex}")
    return number


def load_model(path: str, name: str, version: int | None = None):
    """Load the newest version that :func:`save_model` published, or a given one; the ensemble is named ``ensemble``."""
    known = versions(SparkSession.getActiveSession(), path, name)
    folders = [f for n, f in known if version is None or n == version]
    if not folders:
        raise FileNotFoundError(f"no model {path}/baseline_{name}" + (f" version {version}" if version else ""))
    kinds = {
        "ensemble": SoftVoteModel, "random_forest": forest.ForestModel, "gradient_boosting": boosting.BoostedModel,
        "mlp": network.NetworkModel}
    return kinds.get(name, PipelineModel).load(f"{path}/baseline_{name}/{folders[-1]}")


def score_by_name(
    path: str, name: str, df: DataFrame, text: str = "text", make_scorer=None, make_tokenizer=None
) -> DataFrame:
    """``df`` with a ``prediction`` record from the model that :func:`list_models` calls ``name``.

    Stored models are loaded from ``path`` (with or without the prefix ``baseline_``); pretrained and
    fine-tuned ones are scored by ``make_scorer``, which the caller supplies. With ``make_tokenizer`` they are given
    at most ``MAX_TOKENS`` tokens of a text.
    """
    short = name.removeprefix("baseline_")
    if short in (*CLASSIFIERS, "ensemble"):
        model = load_model(path, short)
        column = text_column(model)
        scored = score(model, df.withColumn(column, F.col(text)))
        return scored.select(*[c for c in scored.columns if c in (*df.columns, "prediction")])
    if name == PRETRAINED or name.removesuffix("_finetuned") in FINE_TUNED:
        if make_scorer is None:
            raise ValueError(f"{name!r} needs make_scorer")
        kind = "pretrained" if name == PRETRAINED else "fine_tuned"
        return score_external(
            df, make_scorer, text, external_order=name == PRETRAINED, make_tokenizer=make_tokenizer,
            max_tokens=MAX_TOKENS[kind] if make_tokenizer else None)
    raise ValueError(f"unknown model {name!r}")


def list_models(spark: SparkSession, path: str) -> list[str]:
    """Names of stored models, and the pretrained scorer, which needs no training."""
    def stored(name: str) -> bool:
        try:
            spark.read.text(f"{path}/{name}/metadata")
            return True
        except AnalysisException:
            return False

    own = [f"baseline_{n}" for n in (*CLASSIFIERS, "ensemble") if versions(spark, path, n)]
    return [*own, PRETRAINED, *[n for n in FINE_TUNED if stored(f"{n}_finetuned")]]


def linear_part(model, member: str | None = None) -> LinearModel:
    """The linear model inside a trained pipeline, or inside a member of an ensemble (``logreg``)."""
    if isinstance(model, SoftVoteModel):
        if member != "logreg":
            raise ValueError("of an ensemble only the member 'logreg' is one linear model")
        return linear_model(model.features, model.logreg)
    if not isinstance(model, PipelineModel):
        raise ValueError("model has no coefficients")
    return linear_model(model, model.stages[-1])


def explain_by_name(
    path: str, name: str, df: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """Explain the texts by the stored model ``name`` (``baseline_logreg``, ``svm``, ``ensemble`` ...): see
    :func:`explain_linear`. Models without coefficients raise an error."""
    short = name.removeprefix("baseline_")
    part = linear_part(load_model(path, short), "logreg" if short == "ensemble" else None)
    return explain_linear(df, part, lexicon, key, text, **options)


def coefficient_table(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """``term, coef_neg, coef_neu, coef_pos`` of a linear model: one row per vocabulary term."""
    return linear_part(model).coefficient_table(spark)
