"""Scoring rows: prediction records, soft voting, external scorers, failing texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from typing import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T

Scorer = Callable[[Sequence], Sequence[Sequence[float]]]
Tokenizer = Callable[[Sequence[str]], Sequence[Sequence]]


def prediction_record(text: Column, probabilities: Column, prediction: Column | None = None) -> Column:
    """``{text, prediction, label, confidence, probabilities}`` from probabilities in class order."""
    number = S.argmax(probabilities) if prediction is None else prediction.cast("int")
    return F.struct(
        T.preview(text, 100).alias("text"),
        number.alias("prediction"),
        T.decode_label(number).alias("label"),
        F.get(probabilities, number).alias("confidence"),
        S.probability_map(probabilities).alias("probabilities"),
    )


def soft_vote(members: Sequence[Column]) -> Column:
    """Mean of probability arrays of equal length."""
    total = members[0]
    for member in members[1:]:
        total = F.zip_with(total, member, lambda a, b: a + b)
    return F.transform(total, lambda x: x / len(members))


def score_or_error(
    df: DataFrame, text: str = "text", label: str = "label", confidence: str = "confidence"
) -> DataFrame:
    """Null and blank texts, and rows without a label, get label ``error`` and confidence 0."""
    failed = T.is_blank(F.col(text)) | F.col(label).isNull()
    out_label = F.when(failed, "error").otherwise(F.col(label))
    out_confidence = F.when(failed, 0.0).otherwise(F.col(confidence))
    return df.withColumns({"label": out_label, "confidence": out_confidence})


_SCORERS: dict[str, Callable] = {}


def worker_scorer(key: str, make_scorer: Callable[[], Callable]) -> Callable:
    """The scorer (or tokenizer) of this Python worker. Workers serve many tasks, so it is made once in each."""
    if key not in _SCORERS:
        _SCORERS[key] = make_scorer()
    return _SCORERS[key]


def score_external(
    df: DataFrame,
    make_scorer: Callable[[], Scorer],
    text: str = "text",
    batch_size: int = 8,
    external_order: bool = True,
    make_tokenizer: Callable[[], Tokenizer] | None = None,
    max_tokens: int | None = None,
) -> DataFrame:
    """Score texts with a model that lives outside Spark, e.g. an ONNX file shipped to workers.

    ``make_scorer`` runs once per Python worker and returns a function from texts to three raw
    scores each. Rows stay where they are; only the text column goes through Arrow. A batch that
    fails is retried row by row; a row that fails, or has no text, gets label ``error``, and
    ``error`` holds the failure's message.

    A model pads a batch to its longest text, so the texts of an Arrow batch are scored in order of
    their length and their scores put back in the order of rows. With ``make_tokenizer`` (also made once per worker)
    the scorer is given token lists instead of texts, cut after ``max_tokens``; ``n_tokens`` (before the cut) and
    ``truncated`` are added, null where there is no text or the tokenizer fails.
    """
    if max_tokens is not None and make_tokenizer is None:
        raise ValueError("max_tokens needs make_tokenizer")
    key = hashlib.sha256(cloudpickle.dumps(make_scorer)).hexdigest()
    token_key = "t" + hashlib.sha256(cloudpickle.dumps(make_tokenizer)).hexdigest()

    def failure(error: Exception) -> str:
        return f"{type(error).__name__}: {error}"

    def scores_of(score: Scorer, items: list) -> list[tuple[list[float] | None, str | None]]:
        try:
            return [(list(map(float, s)), None) for s in score(items)]
        except Exception as error:  # noqa: BLE001 - a bad row must not end the job
            if len(items) == 1:
                return [(None, failure(error))]
            return [s for t in items for s in scores_of(score, [t])]

    def tokens_of(tokenize: Tokenizer, texts: list[str]) -> list[tuple[list | None, str | None]]:
        try:
            return [(list(t), None) for t in tokenize(texts)]
        except Exception as error:  # noqa: BLE001 - as above
            if len(texts) == 1:
                return [(None, failure(error))]
            return [t for x in texts for t in tokens_of(tokenize, [x])]

    @F.pandas_udf("scores array<double>, error string, n_tokens int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = worker_scorer(key, make_scorer)
        tokenize = worker_scorer(token_key, make_tokenizer) if make_tokenizer else None
        for batch in batches:
            out: list[tuple] = [(None, "no text", None)] * len(batch)
            items, sizes = {}, {}
            for i, value in enumerate(batch):
                if isinstance(value, str) and value.strip():
                    items[i], sizes[i] = value, None
            if tokenize:
                for i, (tokens, error) in zip(list(items), tokens_of(tokenize, list(items.values())) if items else []):
                    if tokens is None:
                        out[i] = (None, error, None)
                        del items[i]
                    else:
                        items[i], sizes[i] = tokens[:max_tokens], len(tokens)
            by_length = sorted(items, key=lambda i: (len(items[i]), i))
            for start in range(0, len(by_length), batch_size):
                picked = by_length[start:start + batch_size]
                for i, found in zip(picked, scores_of(score, [items[j] for j in picked])):
                    out[i] = (*found, sizes[i])
            frame = pd.DataFrame(out, columns=["scores", "error", "n_tokens"])
            yield frame.astype({"n_tokens": "Int32"})

    scored = df.withColumn("_raw", run(F.col(text)))
    told = {"_scores": F.col("_raw.scores"), "error": F.col("_raw.error")}
    if make_tokenizer:
        n_tokens = F.col("_raw.n_tokens")
        told |= {"n_tokens": n_tokens, "truncated": n_tokens > max_tokens if max_tokens else n_tokens < 0}
    raw = scored.withColumns(told).drop("_raw")
    probabilities = S.softmax(F.col("_scores"))
    if external_order:
        probabilities = S.reorder_external(probabilities)
    with_probabilities = raw.withColumn("_p", probabilities)
    missing = F.struct(
        T.preview(F.col(text), 100).alias("text"),
        F.lit(None).cast("int").alias("prediction"),
        F.lit("error").alias("label"),
        F.lit(0.0).alias("confidence"),
        F.lit(None).cast("map<string,double>").alias("probabilities"),
    )
    record = F.when(F.col("_p").isNull() | F.col("_scores").isNull(), missing).otherwise(
        prediction_record(F.col(text), F.col("_p"))
    )
    return with_probabilities.withColumn("prediction", record).drop("_scores", "_p")
