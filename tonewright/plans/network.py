"""A neural network over sparse TF-IDF vectors that stops when a held-out part no longer improves.

Two hidden layers (256 and 128 units, rectified), softmax, Adam. Rows are held as non-zero weights in blocks; the first layer
multiplies the terms that occur in a few rows, never a row of all terms. An epoch is one job: each task gives
its part of the gradient (its own terms' rows only, for the first layer) and, for the held-out tenth of the rows, how many it
gets right. The parts are dealt by term and added up in the executors, so the driver gets one gradient in an epoch, whatever
the number of tasks. After ``patience`` epochs without a better share of the held-out rows the
training stops, and the weights of the best epoch are kept. ``start`` goes on from a stored model.

What is held out is decided by a hash of the vector, so equal texts are on the same side. The driver holds the weights (10,000
terms by 256 units are 10 MB) and their two Adam averages, whatever the number of rows. Rows with a label that is
no class are left out; a null text has the vector without weights.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, Broadcast, StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scores as S
from .boosting import sparse

CLASSES = len(P.LABELS)
HIDDEN = (256, 128)
CHUNK = 200  # rows that are multiplied at a time
TENTH = 10
BUCKETS = 16  # parts of the terms that are added up apart


@dataclass
class Rows:
    """Rows of a block: labels, whether they are held out, and the weights above zero in row order."""

    label: np.ndarray
    held_out: np.ndarray
    begin: np.ndarray  # of each row in ``term`` and ``weight``, with the end at last
    term: np.ndarray
    weight: np.ndarray


@dataclass
class Part:
    """What a block adds to an epoch: gradients (the first layer's for some terms), loss, rows, held-out hits."""

    terms: np.ndarray
    first: np.ndarray
    others: list[np.ndarray]
    loss: float
    seen: int
    held: int
    hits: int


def initial(n_terms: int, seed: int) -> list[np.ndarray]:
    """Weights and biases of the three layers."""
    rng = np.random.default_rng(seed)
    sizes = [n_terms, *HIDDEN, CLASSES]
    out = []
    for a, b in zip(sizes, sizes[1:]):
        bound = np.sqrt(6.0 / (a + b))
        out += [rng.uniform(-bound, bound, (a, b)).astype(np.float32), np.zeros(b, np.float32)]
    return out


def chunk_of(rows: Rows, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms of some rows, and the rows as a matrix of these terms."""
    span = slice(rows.begin[low], rows.begin[high])
    terms, place = np.unique(rows.term[span], return_inverse=True)
    grid = np.zeros((high - low, len(terms)), np.float32)
    grid[np.repeat(np.arange(high - low), np.diff(rows.begin[low: high + 1])), place] = rows.weight[span]
    return terms, grid


def forward(weights: list[np.ndarray], terms: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hidden layers and the class probabilities."""
    w1, b1, w2, b2, w3, b3 = weights
    one = np.maximum(grid @ w1[terms] + b1, 0)
    two = np.maximum(one @ w2 + b2, 0)
    raw = (two @ w3 + b3).astype(np.float64)
    raw = np.exp(raw - raw.max(axis=1, keepdims=True))
    return one, two, raw / raw.sum(axis=1, keepdims=True)


def epoch_part(rows: Rows, weights: list[np.ndarray]) -> Part:
    w1, _, w2, _, w3, _ = weights
    all_terms = np.unique(rows.term)
    first = np.zeros((len(all_terms), w1.shape[1]), np.float32)
    others = [np.zeros_like(w) for w in weights[1:]]
    loss, seen, held, hits = 0.0, 0, 0, 0
    for low in range(0, len(rows.label), CHUNK):
        high = min(low + CHUNK, len(rows.label))
        terms, grid = chunk_of(rows, low, high)
        label, out = rows.label[low:high], rows.held_out[low:high]
        one, two, share = forward(weights, terms, grid)
        held += int(out.sum())
        hits += int((share.argmax(axis=1) == label)[out].sum())
        loss -= float(np.log(np.maximum(share[np.arange(len(label)), label], 1e-300))[~out].sum())
        seen += int((~out).sum())
        slope = share
        slope[np.arange(len(label)), label] -= 1
        slope[out] = 0  # held-out rows teach nothing
        slope = slope.astype(np.float32)
        back_two = (slope @ w3.T) * (two > 0)
        back_one = (back_two @ w2.T) * (one > 0)
        first[np.searchsorted(all_terms, terms)] += grid.T @ back_one
        for total, more in zip(others, (back_one.sum(0), one.T @ back_two, back_two.sum(0), two.T @ slope, slope.sum(0))):
            total += more
    return Part(all_terms, first, others, loss, seen, held, hits)


def merged(a: Part | None, b: Part | None) -> Part | None:
    if a is None or b is None:
        return a or b
    terms = np.union1d(a.terms, b.terms)
    first = np.zeros((len(terms), a.first.shape[1]), np.float32)
    for part in (a, b):
        first[np.searchsorted(terms, part.terms)] += part.first
    return Part(terms, first, [x + y for x, y in zip(a.others, b.others)],
                a.loss + b.loss, a.seen + b.seen, a.held + b.held, a.hits + b.hits)


def gradient_parts(blocks: RDD, sent: Broadcast) -> list[Part]:
    """The whole gradient in parts by term; one of them has all of the layers above the first."""
    def send(part: Iterator[Rows]) -> Iterator[tuple[int, Part]]:
        whole = reduce(merged, (epoch_part(block, sent.value) for block in part), None)
        if whole is None:
            return
        for b in range(BUCKETS):
            mine = whole.terms % BUCKETS == b
            rest = (whole.others, whole.loss, whole.seen, whole.held, whole.hits) if b == 0 else ([], 0.0, 0, 0, 0)
            if b == 0 or mine.any():
                yield b, Part(whole.terms[mine], whole.first[mine], *rest)

    def add(part: Iterator[tuple[int, Part]]) -> Iterator[Part]:
        whole = reduce(merged, (p for _, p in part), None)
        return iter(()) if whole is None else iter([whole])

    return blocks.mapPartitions(send).partitionBy(BUCKETS, int).mapPartitions(add).collect()  # a row for each part


@dataclass
class NetworkModel:
    """A feature pipeline, the weights of the best epoch, and the curve: ``loss, share of held-out rows`` by epoch."""

    features: PipelineModel
    weights: list[np.ndarray]
    curve: list[tuple[float, float]] = field(default_factory=list)

    @property
    def best_epoch(self) -> int:
        shares = [s for _, s in self.curve]
        return shares.index(max(shares)) if shares else 0

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction`` and ``probabilities``."""
        columns = df.columns
        held = df.sparkSession.sparkContext.broadcast(self.weights)

        @F.arrow_udf("array<double>")
        def shares(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for vectors in batches:
                rows = rows_of(vectors, np.zeros(len(vectors), np.int64), np.zeros(len(vectors), bool))
                found = np.zeros((len(vectors), CLASSES))
                for low in range(0, len(vectors), CHUNK):
                    high = min(low + CHUNK, len(vectors))
                    found[low:high] = forward(held.value, *chunk_of(rows, low, high))[2]
                yield pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), CLASSES).cast(pa.list_(pa.float64()))

        weighed = self.features.transform(df).select(*columns, F.unwrap_udt("features").alias("_v"))
        scored = weighed.select(*columns, shares(sparse("_v")).alias("probabilities"))
        return scored.withColumn("prediction", S.argmax(F.col("probabilities")))

    def save(self, path: str) -> None:
        self.features.write().overwrite().save(f"{path}/features")
        spark = SparkSession.getActiveSession()
        layers = pa.table({
            "no": list(range(len(self.weights))), "shape": [list(w.shape) for w in self.weights],
            "data": pa.array([w.astype("<f4").tobytes() for w in self.weights], pa.binary())})
        spark.createDataFrame(layers).write.mode("overwrite").parquet(f"{path}/layers")
        facts = pa.table({"value": [json.dumps(self.curve)]})
        spark.createDataFrame(facts).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, path: str) -> "NetworkModel":
        spark = SparkSession.getActiveSession()
        layers = spark.read.parquet(f"{path}/layers").orderBy("no").collect()  # six rows
        weights = [np.frombuffer(r["data"], "<f4").reshape(r["shape"]).copy() for r in layers]
        curve = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
        return cls(PipelineModel.load(f"{path}/features"), weights, [tuple(x) for x in curve])


def rows_of(vectors: pa.Array, label: np.ndarray, held_out: np.ndarray) -> Rows:
    indices, values = vectors.field("indices"), vectors.field("values")
    if indices.null_count:  # a vector that is null has no weights
        indices, values = (x.fill_null(pa.scalar([], x.type)) for x in (indices, values))
    begin = indices.offsets.to_numpy().astype(np.int64)
    return Rows(label, held_out, begin - begin[0], indices.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                values.flatten().to_numpy(zero_copy_only=False).astype(np.float32))


def fit(
    features: PipelineModel, data: DataFrame, maxIter: int = 500, tol: float = 1e-4, patience: int = 10,
    stepSize: float = 0.01, penalty: float = 1e-4, seed: int = 42, start: NetworkModel | None = None,
) -> NetworkModel:
    """Fit on ``features, label``; ``start`` gives the first weights."""
    spark = data.sparkSession
    rows = data.where(F.col("label").isin(*range(CLASSES))).select("label", F.unwrap_udt("features").alias("_v"))
    facts = rows.select("label", sparse("_v").alias("v"), F.coalesce("_v.size", F.size("_v.values")).alias("size"))
    n_terms = facts.agg(F.max("size")).first()[0]
    if n_terms is None:
        raise ValueError("no row with a class")
    held_out = F.pmod(F.xxhash64("v.indices", "v.values"), F.lit(TENTH)) == 0

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = rows_of(batch.column(2), batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False))
            parts = (block.label.astype("<i8"), block.held_out.astype("u1"), block.begin.astype("<i8"),
                     block.term.astype("<i4"), block.weight.astype("<f4"))
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=list("abcde"))

    def unpacked(row) -> Rows:
        kinds = ("<i8", "u1", "<i8", "<i4", "<f4")
        label, out, begin, term, weight = (np.frombuffer(x, k) for x, k in zip(row, kinds))
        return Rows(label, out.astype(bool), begin, term.astype(np.int64), weight)

    # blocks of numbers that every epoch reads: the work inside a task is a program, not a query
    table = facts.select("label", held_out.alias("held_out"), "v").mapInArrow(packed, "a binary, b binary, c binary, d binary, e binary")
    blocks = table.rdd.map(unpacked).persist(StorageLevel.MEMORY_AND_DISK)
    weights = [w.copy() for w in start.weights] if start else initial(n_terms, seed)
    model = NetworkModel(features, [w.copy() for w in weights])
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    best, since = -1.0, 0
    try:
        for epoch in range(1, maxIter + 1):
            sent = spark.sparkContext.broadcast(weights)
            parts = gradient_parts(blocks, sent)
            sent.destroy()
            part = next(p for p in parts if p.others)
            # the share is that of the weights before this epoch's step
            share = part.hits / part.held if part.held else -part.loss / max(part.seen, 1)
            model.curve.append((part.loss / max(part.seen, 1), share))
            if share > best + tol or epoch == 1:
                since = 0
            else:
                since += 1
            if share > best or epoch == 1:
                best, model.weights = share, [w.copy() for w in weights]
            if since >= patience:
                break
            gradient = [np.zeros_like(weights[0]), *part.others]
            for p in parts:
                gradient[0][p.terms] = p.first
            for i, (w, g) in enumerate(zip(weights, gradient)):
                g /= max(part.seen, 1)
                if w.ndim == 2:
                    g += penalty / max(part.seen, 1) * w
                mean[i] += 0.1 * (g - mean[i])
                square[i] += 0.001 * (g * g - square[i])
                w -= stepSize * (mean[i] / (1 - 0.9**epoch)) / (np.sqrt(square[i] / (1 - 0.999**epoch)) + 1e-8)
    finally:
        blocks.unpersist()
    return model
