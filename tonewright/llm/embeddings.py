"""Near-duplicate vectors by int8 tile products with error bounds.

Vectors of one label are cut into tiles. For each pair of tiles the int8 codes are multiplied; each vector
carries the length of what its code leaves out, so the true product of two unit vectors differs from
the coded one by at most ``e_x |q_y| + |q_x| e_y + e_x e_y``. Only pairs that may reach the threshold
under this bound are computed again in double precision. Tiles follow a space-filling curve and know
their centre and radius; pairs of tiles that are too far apart by the triangle inequality are skipped.

Equal vectors are one class and take part once. A pair of tiles reports sums of links and a star for each
locally connected set, never pairs, so thousands of copies stay linear.

The work grows with the square of the largest label, like any exact comparison of all its vectors; tile
pairs are dealt evenly over tasks, so a hot label is shared by all of them.

Nulls and odd input: vectors that are null, empty, zero or hold a null or a non-finite component, and those
with a null label or key, link with nothing; only vectors of one length are compared; rows with equal
keys are vectors of their own for the counts and one node for the components; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.llm.common import checkpoint, running_total
from tonewright.llm.components import connected_components, local_components
from tonewright.llm.packing import hilbert_key

TILE = 1024
THRESHOLD = 0.93
SLACK = 1e-9  # far above the rounding of the sums below, far below the codes' error


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, lengths of the coded vectors and lengths of the errors, row by row."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def coded_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 codes. Single precision holds them up to 1040 components."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def unit_rows(rows: np.ndarray) -> np.ndarray:
    # scaled first: squares of very small or large components must not vanish or overflow
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def far_apart(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """No vector of ``x`` can reach the threshold with one of ``y``: centres and radii as angles."""
    cx, cy = x.mean(axis=0), y.mean(axis=0)
    if not np.linalg.norm(cx) or not np.linalg.norm(cy):
        return False
    cx, cy = cx / np.linalg.norm(cx), cy / np.linalg.norm(cy)

    def angle(v):
        return np.arccos(np.clip(v, -1, 1))

    reach = angle((x @ cx).min()) + angle((y @ cy).min()) + angle(threshold)
    return bool(angle(cx @ cy) > reach + 1e-6)


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs of unit vectors with a cosine of at least the threshold."""
    qx, sx, nx, ex = quantise(x)
    qy, sy, ny, ey = quantise(y)
    near = coded_products(qx, qy) * sx[:, None] * sy[None, :]
    bound = ex[:, None] * ny[None, :] + nx[:, None] * ey[None, :] + ex[:, None] * ey[None, :]
    i, j = np.nonzero(near + bound >= threshold - SLACK)
    good = np.zeros(len(i), bool)
    for s in range(0, len(i), 1 << 16):
        part = slice(s, s + (1 << 16))
        good[part] = np.einsum("ij,ij->i", x[i[part]], y[j[part]]) >= threshold
    return i[good], j[good]


def tile_rows(cell: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, copies and vectors of a tile, as they come in a list of structs."""
    flat = cell.values
    items = flat.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rep = flat.field("rep").to_numpy(zero_copy_only=False)
    return rep, flat.field("copies").to_numpy(zero_copy_only=False), items.reshape(len(rep), -1)


def compare_tiles(pairs: DataFrame, threshold: float) -> DataFrame:
    """``left_tile, right_tile, left, right`` -> ``rep, links, tied``: links of a class in this pair of tiles, and
    the class it is tied to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column(0)[row].as_py() == batch.column(1)[row].as_py()
                ids_x, copies_x, x = tile_rows(batch.column(2)[row])
                ids_y, copies_y, y = tile_rows(batch.column(3)[row])
                x, y = unit_rows(x), unit_rows(y)
                if not same and far_apart(x, y, threshold):
                    continue
                i, j = linked_pairs(x, y, threshold)
                if same:
                    i, j = i[i != j], j[i != j]
                    links = np.bincount(i, copies_x[j], len(x)).astype(np.int64)
                    ids = ids_x
                else:
                    links = np.concatenate([
                        np.bincount(i, copies_y[j], len(x)), np.bincount(j, copies_x[i], len(y))]).astype(np.int64)
                    ids = np.concatenate([ids_x, ids_y])
                    j = j + len(x)
                label = local_components(len(ids), i, j)
                keep = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[keep]), pa.array(links[keep]), pa.array(ids[label[keep]])],
                    names=["rep", "links", "tied"])

    return pairs.mapInArrow(run, "rep long, links long, tied long")


def add_curve(rows: DataFrame) -> DataFrame:
    """Add ``curve``: the place of a vector's direction, projected to four dimensions, on a Hilbert curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("embedding"))
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            keys = np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                unit = unit_rows(values[starts[mine][:, None] + np.arange(size)])
                point = unit @ np.random.default_rng(5).normal(size=(size, 4))
                keys[mine] = hilbert_key(np.round((np.tanh(point) + 1) * 511).astype(np.int64), 10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=[*batch.schema.names, "curve"])

    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, curve long")


def near_duplicate_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    tile: int = TILE,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row."""
    rows = vectors.select(
        F.col(key).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    limit = float("inf")
    ok = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < limit)), F.lit(False))
        & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    )
    # -0.0 and 0.0 are equal as numbers, so they have to be as keys
    plain = F.transform("embedding", lambda v: v + F.lit(0.0))
    rows = rows.withColumn("ok", ok).withColumn("h1", F.xxhash64("label", plain)).withColumn(
        "h2", F.xxhash64(F.lit(1), plain, "label"))
    classes = rows.where("ok").groupBy("label", "h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # a row of each class brings the vector
    bodies = rows.where("ok").select("label", "h1", "h2", F.col("vec_id").alias("rep"), "embedding")
    reps = classes.join(bodies, ["label", "h1", "h2", "rep"]).dropDuplicates(["label", "h1", "h2"])
    reps = reps.select("label", "rep", "copies", "embedding", F.size("embedding").alias("dims"))
    order = [F.col("label"), F.col("dims"), F.col("curve"), F.col("rep")]
    placed = running_total(add_curve(reps), order, F.lit(1).cast("long"), "place")
    begins = placed.groupBy("label", "dims").agg(F.min("place").alias("begin"), F.count("*").alias("n"))
    tiles = checkpoint(
        placed.join(begins, ["label", "dims"])
        .withColumn("tile", F.floor((F.col("place") - F.col("begin")) / tile))
        .withColumn("tiles", F.ceil(F.col("n") / tile))
        .groupBy("label", "dims", "tile", "tiles")
        .agg(F.collect_list(F.struct("rep", "copies", "embedding")).alias("items"))
    )
    left = tiles.select(
        "label", "dims", F.col("tile").alias("left_tile"), F.col("items").alias("left"),
        F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("right_tile"),
    )
    right = tiles.select("label", "dims", F.col("tile").alias("right_tile"), F.col("items").alias("right"))
    pairs = left.join(right, ["label", "dims", "right_tile"]).select("left_tile", "right_tile", "left", "right")
    found = checkpoint(compare_tiles(pairs, threshold))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    ties = found.select(F.col("rep").alias("a"), F.col("tied").alias("b")).where("a <> b")
    components = connected_components(ties).withColumnRenamed("node", "rep")
    facts = classes.join(links, "rep", "left").join(components, "rep", "left")
    return (
        rows.select("vec_id", "label", "h1", "h2", "ok").alias("v")
        .join(facts.withColumn("ok", F.lit(True)), ["label", "h1", "h2", "ok"], "left")
        .select(
            "vec_id",
            F.when(F.col("ok"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
            .otherwise(0).cast("long").alias("n_links"),
            F.when(F.col("ok"), F.coalesce("component", "rep")).otherwise(F.col("vec_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
