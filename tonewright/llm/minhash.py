"""MinHash near-duplicates with tensored banding.

Two small collections of band keys are computed for each document; a table key combines one key of
each collection. ``bands`` keys on either side give ``bands * bands`` tables while only
``2 * bands * rows`` minima are computed. Two documents of similarity s meet in a table with
probability ``(1 - (1 - s**rows)**bands)**2``. Bands are added until at most ``MISSED`` of the pairs at
the threshold don't meet: 8 at 0.85 and above, 10 at 0.8 (0.99993 at both thresholds).

What meets is verified on full shingle sets. Copies of one word sequence form a class first and take
part once. Within a table entry every document is compared with the smallest one. When that has
joined what belongs together, documents of one entry may still be in different components. Entries of
up to ``SMALL`` documents then list their pairs, which is linear in the rows. Documents that larger
entries hold together form groups; a group is cut into tiles of ``TILE`` documents, and pairs of tiles
count the shingles that their documents share as products of incidence matrices, without a row for
any pair. So every pair that met is verified, in no matter how large an entry.

Nulls and odd input: a null or blank text has an empty set and is linked with nothing; fewer words
than a shingle count as one shingle; rows with one doc_id are one document in the links (each row is
returned); a null doc_id links with nothing and is its own component (null, kept); an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tonewright.llm.common import (
    checkpoint, mix, prefix_hash, running_total, slices, span_hash, stored, text_bytes, tidy, word_bounds,
)
from tonewright.llm.components import connected_components, local_components

SHINGLE = 5
BANDS = 8
ROWS = 2
MISSED = 1e-4
SMALL = 30
TILE = 256
COLUMNS = 8192  # shingles whose incidence is multiplied at a time

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def codes(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def combine(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """One hash for each run of ``size`` neighbouring hashes."""
    factor = codes(size, seed)
    n = len(hashes) - size + 1
    total = hashes[:n] * factor[0]
    for i in range(1, size):
        total += hashes[i: n + i] * factor[i]
    return mix(total)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, their offsets by text, and words per text."""
    data = _LOWER[data]
    start, end = word_bounds(data, offsets)
    words = span_hash(prefix_hash(data), start, end)
    first = np.searchsorted(start, offsets)  # first word of each text
    count = np.diff(first)
    per = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    where = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(where[-1], np.uint64)
    if len(words) >= size:
        every = combine(words, size, 1)
        doc = np.repeat(np.arange(len(count)), per)
        spot = np.arange(where[-1]) - where[doc] + first[doc]
        out[:] = every[np.minimum(spot, len(every) - 1)]
    for i in np.flatnonzero((count > 0) & (count < size)):
        n = int(count[i])
        out[where[i]] = combine(words[first[i]: first[i] + n], n, 100 + n)[0]
    return out, where, count


def sorted_sets(hashes: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in order, and their new offsets."""
    hashes = hashes.copy()
    for i in range(len(where) - 1):
        hashes[where[i]: where[i + 1]].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[where[:-1][where[:-1] < len(hashes)]] = True
    total = np.concatenate([[0], np.cumsum(new)])
    return hashes[new], total[where]


def minima(hashes: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """``n`` minimum hashes for each text that has shingles; texts x n."""
    rows = len(where) - 1
    out = np.zeros((rows, n), np.uint64)
    full = np.flatnonzero(np.diff(where))
    if len(full):
        add, factor = codes(n, 2), codes(n, 3)
        for j in range(n):
            out[full, j] = np.minimum.reduceat((hashes ^ add[j]) * factor[j], where[:-1][full])
    return out


def bands_for(percent: int, rows: int = ROWS) -> int:
    """Bands on either side, ``BANDS`` at least, so that few pairs at the threshold meet in no table."""
    if percent <= 0:
        raise ValueError("percent has to be above zero")
    bands = BANDS
    while 1 - (1 - (1 - (percent / 100) ** rows) ** bands) ** 2 > MISSED:
        bands += 1
    return bands


def sketch(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, n_shingles, k1, k2`` (the word sequence), ``a``, ``b`` (band keys)."""

    def lists(values: np.ndarray) -> pa.Array:
        flat = pa.array(np.ascontiguousarray(values).view(np.int64).ravel())
        return pa.FixedSizeListArray.from_arrays(flat, bands).cast(pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = codes(2 * bands, 4)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in slices(offsets):
                part = data[offsets[lo]: offsets[hi]]
                hashes, where, count = shingles(part, offsets[lo: hi + 1] - offsets[lo], size)
                low = minima(hashes, where, 2 * bands * rows).reshape(hi - lo, 2 * bands, rows)
                keys = np.zeros((hi - lo, 2 * bands), np.uint64)
                for r in range(rows):
                    keys = mix(keys + low[:, :, r] + tag)
                # the sequence of shingles in order stands for the sequence of words
                place = np.arange(len(hashes)) - np.repeat(where[:-1], np.diff(where))
                exact = [
                    np.concatenate([[0], np.cumsum(
                        mix(hashes + place.astype(np.uint64) * c), dtype=np.uint64)])
                    for c in codes(2, 5)
                ]
                k1, k2 = (e[where[1:]] - e[where[:-1]] + count.astype(np.uint64) for e in exact)
                _, sets = sorted_sets(hashes, where)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(np.diff(sets)),
                    pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                    lists(keys[:, :bands]), lists(keys[:, bands:]),
                ], names=["doc_id", "n_shingles", "k1", "k2", "a", "b"])

    return docs.mapInArrow(
        tidy(run), "doc_id long, n_shingles long, k1 long, k2 long, a array<long>, b array<long>"
    )


def verify(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` of documents whose full shingle sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_bytes(batch.column(column)) for column in (2, 3)]
            for lo, hi in slices(texts[0][1] + texts[1][1]):
                sides = []
                for data, offsets in texts:
                    part = data[offsets[lo]: offsets[hi]]
                    hashes, where, _ = shingles(part, offsets[lo: hi + 1] - offsets[lo], size)
                    values, sets = sorted_sets(hashes, where)
                    sides.append([values[s:e] for s, e in zip(sets[:-1], sets[1:])])
                good = []
                for x, y in zip(*sides):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).slice(lo, hi - lo).filter(pa.array(good, pa.bool_()))

    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(tidy(run), "a long, b long")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set on the left has in common with each on the right."""
    out = np.zeros((len(left), len(right)), np.float32)
    every = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, value, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times[value] > 1
    rank = np.cumsum(times > 1) - 1
    row, value = row[shared], rank[value[shared]]
    order = np.argsort(value, kind="stable")
    row, value = row[order], value[order]
    for first in range(0, int(rank[-1]) + 1 if len(rank) else 0, COLUMNS):
        part = slice(*np.searchsorted(value, [first, first + COLUMNS]))
        grid = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        grid[row[part], value[part] - first] = 1
        out += grid[: len(left)] @ grid[len(left):].T
    return out


def verify_groups(groups: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``node, component`` (groups of documents that met) -> links ``a, b`` that join, within each pair of
    tiles, all documents that are similar; a spanning star for each set, not every pair."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for lo, hi in slices(offsets):
                part = data[offsets[lo]: offsets[hi]]
                hashes, where, _ = shingles(part, offsets[lo: hi + 1] - offsets[lo], size)
                values, at = sorted_sets(hashes, where)
                packed = [values[s:e].tobytes() for s, e in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(packed, pa.binary()),
                ], names=["part", "doc_id", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column(0)[row].as_py() == batch.column(1)[row].as_py()
                sides = []
                for column in (2, 3):
                    items = batch.column(column)[row].values
                    ids = items.field("doc_id").to_numpy(zero_copy_only=False)
                    sides.append((ids, [np.frombuffer(x, np.uint64) for x in items.field("shingles").to_pylist()]))
                (ids_x, x), (ids_y, y) = sides
                both = shared_counts(x, y)
                total = np.array([len(v) for v in x])[:, None] + np.array([len(v) for v in y])[None, :] - both
                i, j = np.nonzero((both > 0) & (100 * both.astype(np.int64) >= percent * total.astype(np.int64)))
                ids = ids_x if same else np.concatenate([ids_x, ids_y])
                label = local_components(len(ids), i, j if same else j + len(x))
                tied = np.flatnonzero(label != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[label[tied]]), pa.array(ids[tied])], names=["a", "b"])

    members = groups.select(F.col("component").alias("part"), F.col("node").alias("doc_id"))
    order = [F.col("part"), F.xxhash64("doc_id"), F.col("doc_id")]
    placed = running_total(members, order, F.lit(1).cast("long"), "place")
    begins = placed.groupBy("part").agg(F.min("place").alias("begin"), F.count("*").alias("n"))
    placed = placed.join(begins, "part").select(
        "part", "doc_id", F.floor((F.col("place") - F.col("begin")) / TILE).alias("tile"),
        F.ceil(F.col("n") / TILE).alias("tiles"),
    )
    texts = docs.join(members.select("part", "doc_id"), "doc_id").select("part", "doc_id", "text")
    packed = texts.mapInArrow(tidy(sets), "part long, doc_id long, shingles binary")
    tiles = checkpoint(
        packed.join(placed, ["part", "doc_id"]).groupBy("part", "tile", "tiles")
        .agg(F.collect_list(F.struct("doc_id", "shingles")).alias("items"))
    )
    left = tiles.select(
        "part", F.col("tile").alias("left_tile"), F.col("items").alias("left"),
        F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("right_tile"),
    )
    right = tiles.select("part", F.col("tile").alias("right_tile"), F.col("items").alias("right"))
    pairs = left.join(right, ["part", "right_tile"]).select("left_tile", "right_tile", "left", "right")
    return pairs.mapInArrow(tidy(compare), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    percent: int = 80,
    size: int = SHINGLE,
    bands: int | None = None,
    rows: int = ROWS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row; one of each component is kept.

    Documents are linked when ``100 * intersection >= percent * union`` of their shingle sets. Without ``bands``
    the threshold gives their number.
    """
    bands = bands_for(percent, rows) if bands is None else bands
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = checkpoint(sketch(docs, size, bands, rows))
    classes = (
        sketches.where("n_shingles > 0 and doc_id is not null")
        .groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    )
    reps = classes.select(F.col("rep").alias("doc_id"))
    # a table key needs an equal key of the first collection, which few documents share
    firsts = (
        sketches.join(reps, "doc_id", "left_semi").where("n_shingles > 0")
        .select("doc_id", F.explode("a").alias("key_a")).distinct()
    )
    shared = firsts.groupBy("key_a").agg(F.count("*").alias("n")).where("n > 1").select("key_a")
    firsts = firsts.join(shared, "key_a", "left_semi")
    entries = checkpoint(
        firsts.join(sketches.where("n_shingles > 0").select("doc_id", "n_shingles", "b"), "doc_id")
        .select("doc_id", "n_shingles", "key_a", F.explode("b").alias("key_b"))
        .select(F.xxhash64("key_a", "key_b").alias("entry"), "doc_id", "n_shingles").distinct()
    )
    # texts of documents that are in an entry: taken out once, for all that is verified
    met = entries.select("doc_id").distinct()
    docs = stored(docs.join(met, "doc_id", "left_semi"), "met")
    # sets of too different sizes can't reach the similarity
    close = F.least("n_shingles", "n_other") * 100 >= F.greatest("n_shingles", "n_other") * percent
    sizes = entries.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_other")).distinct()
    heads = entries.groupBy("entry").agg(
        F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").select("entry", "a")
    first_pairs = checkpoint(
        entries.join(heads, "entry").where("doc_id <> a")
        .select("a", F.col("doc_id").alias("b"), "n_shingles").distinct()
        .join(sizes, "a").where(close).select("a", "b")
    )
    links = checkpoint(verify(first_pairs, docs, size, percent))
    stars = connected_components(links)
    found = entries.join(stars.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "entry", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component")
    )
    mixed = found.groupBy("entry").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"),
        F.min("doc_id").alias("head"),
    ).where("lo < hi").select("entry", "n", "head")
    found = checkpoint(found.join(mixed, "entry"))
    few = found.where(F.col("n") <= SMALL)
    other = few.select(
        "entry", F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_other"),
        F.col("component").alias("component_b"),
    )
    rest = checkpoint(
        few.join(other, "entry").where("doc_id < b and component <> component_b").where(close)
        .select(F.col("doc_id").alias("a"), "b").distinct()
        .join(first_pairs, ["a", "b"], "left_anti")
    )
    many = found.where(F.col("n") > SMALL).select(F.col("doc_id").alias("a"), F.col("head").alias("b")).distinct()
    # the stars stand for the links they came from, so the last components go on from there
    links = stars.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    links = links.union(verify_groups(connected_components(many), docs, size, percent))
    links = links.union(verify(rest, docs, size, percent))
    found = connected_components(links)
    return (
        sketches.select("doc_id", "n_shingles", "k1", "k2")
        .join(classes, ["k1", "k2"], "left")
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "doc_id", "n_shingles",
            F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep", "doc_id"))
            .otherwise(F.col("doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Keep one row of each component: its smallest document.

    Where ids are null or come more than once, they don't tell rows apart. A row is then named by a number of its
    id and text, so rows that share an id are compared like any others, and of rows that share both
    the smallest in all columns that have an order stays (of those equal in them any one).
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("doc_id is null or n > 1").isEmpty():
        kept = near_duplicates(docs, percent=percent).where("kept").select(F.col("doc_id").alias("_tw_kept"))
        return docs.join(kept, docs["doc_id"] == kept["_tw_kept"], "left_semi")
    # two hashes find equal rows, and the rows that are left are numbered, so none takes another's name
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    ordered = F.struct(*[F.col(f"`{f.name}`") for f in docs.schema.fields if has_order(f.dataType)])
    alike = docs.groupBy(F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("h2"))
    single = alike.agg(F.min_by(whole, ordered).alias("row"))
    numbered = running_total(single.select("h1", "h2"), [F.col("h1"), F.col("h2")], F.lit(1).cast("long"), "no")
    rows = stored(single.join(numbered, ["h1", "h2"]).select("no", "row"), "rows")
    texts = rows.select("no", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    found = near_duplicates(texts.select("no", "text"), key="no", percent=percent)
    smallest = F.min(F.struct(F.col("r.doc_id").isNull(), F.col("r.doc_id"), F.col("r.no")))["no"]
    kept = (
        found.alias("f").join(texts.select("no", "doc_id").alias("r"), F.col("f.doc_id") == F.col("r.no"))
        .groupBy("component_id").agg(smallest.alias("no")).select("no")
    )
    return rows.join(kept, "no", "left_semi").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def has_order(kind: DataType) -> bool:
    """Whether values of a type can be put in order, which maps and what holds them can't."""
    return not any(name in kind.simpleString() for name in ("map<", "variant", "interval"))
