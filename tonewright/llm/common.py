"""Helpers shared by the operators: row packing for Arrow, texts as byte arrays, running totals."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SLICE_BYTES = 2_000_000

# Any fixed odd numbers do; they only have to be the same in every task.
MULTIPLIER = 0x9E3779B97F4A7C15
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local master without the setting gets a temporary folder; a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="tonewright-")
    return _own_folders[application]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Store ``df`` in the shared folder and go on from there; its partitions stay as they are."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder; later steps read only what they need."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_caches: list[Callable[[], None]] = []


def forgets(clear: Callable[[], None]) -> None:
    """Name a function that empties what a Python worker remembers between tasks."""
    _caches.append(clear)


def forget() -> None:
    """Empty it: a worker serves tasks of many stages, and steps that need the room begin with this."""
    for clear in _caches:
        clear()


def give_back() -> None:
    """Return freed memory to the system. Idle workers wait beside busy ones, and allocators keep what
    arrays have left."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator], keep: bool = False) -> Callable[[Iterator], Iterator]:
    """A task function that gives memory back at its end, and (but for those that ``keep`` it) begins
    without what a worker remembers of other stages."""

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        if not keep:
            forget()
        yield from run(batches)
        give_back()

    return tidied


def running_total(
    df: DataFrame, order: Sequence[Column], value: Column, name: str = "before"
) -> DataFrame:
    """Add the sum of ``value`` over all rows that come earlier in ``order``, and fix that order.

    Rows are dealt by range, so equal leading keys are still shared among tasks as long as later
    keys differ. Each range adds up on its own; the totals of the ranges (one row each) are then
    summed in order. The ranges are stored first: a second sampling could cut them elsewhere.
    Rows that tie in all keys keep the order in which they were stored.
    """
    part, line = "_tw_part", "_tw_line"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = checkpoint(
        ranged.withColumn("_tw_value", value)
        .withColumn(part, F.spark_partition_id())
        .withColumn(line, F.monotonically_increasing_id())
    )
    totals = ranged.groupBy(part).agg(F.sum("_tw_value").alias("_tw_total"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        part, F.coalesce(F.sum("_tw_total").over(earlier), F.lit(0)).alias("_tw_base")
    )
    inside = Window.partitionBy(part).orderBy(line).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range, as many as the shuffle has partitions
    return (
        ranged.withColumn("_tw_inside", F.coalesce(F.sum("_tw_value").over(inside), F.lit(0)))
        .join(F.broadcast(totals), part)
        .withColumn(name, F.col("_tw_base") + F.col("_tw_inside"))
        .drop(part, line, "_tw_value", "_tw_base", "_tw_inside")
    )


def add_by_text(
    df: DataFrame,
    text: str,
    fields: str,
    work: Callable[[pa.Array], dict[str, object]],
) -> DataFrame:
    """Add columns that ``work`` computes from the text column, batch by batch.

    All columns of ``df`` travel through unchanged inside one struct, so names can't clash there;
    a new column replaces one of the same name. ``fields`` is a DDL list of the new columns.
    """
    schema = df.sparkSession.createDataFrame([], fields).schema
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    out_names = [f"_new_{i}" for i in range(len(schema))]
    place = df.columns.index(text)
    inner = StructType([
        *packed.schema.fields, *(StructField(n, f.dataType) for n, f in zip(out_names, schema.fields))])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            made = work(row.field(place))
            arrays = [row, *(as_arrow(made[n]) for n in names)]
            yield pa.RecordBatch.from_arrays(arrays, names=["_row", *out_names])

    done = packed.mapInArrow(tidy(run), inner)
    kept = [F.col("_row").getField(c).alias(c) for c in df.columns if c not in names]
    return done.select(*kept, *[F.col(o).alias(n) for o, n in zip(out_names, names)])


def as_arrow(values) -> pa.Array:
    return values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one array of bytes, and where each begins (with the end at last).

    A null is an empty text. Nothing is copied unless there are nulls.
    """
    if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type):
        width = np.int32
    else:
        width = np.int64
    if texts.null_count:
        texts = texts.fill_null("" if "string" in str(texts.type) else b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, width)[texts.offset: texts.offset + len(texts) + 1]
    offs = offs.astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offs[0]: offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes each; a longer text is a range of its own."""
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word: a run of bytes that are not ASCII white space, in one text."""
    n = len(data)
    inside = ~SPACE[data]
    cut = np.zeros(n + 1, bool)  # a text begins here
    cut[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER)) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the multiplier, and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        inverse = pow(MULTIPLIER, -1, 1 << 64)
        for i, base in enumerate((MULTIPLIER, inverse)):
            row = np.full(max(n, SLICE_BYTES + 4096), base, np.uint64)
            row[0] = 1
            _powers[i] = np.multiply.accumulate(row)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Hash sums of all prefixes; ``span_hash`` takes the hash of any stretch from them."""
    forward, _ = powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(BYTE_CODES[data] * forward[: len(data)], out=total[1:])
    return total


def span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [start, end)."""
    _, back = powers(len(total))
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
