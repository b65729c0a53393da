"""Exact stratified 80/10/10 split without sorting a class in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DIGITS = 4  # leading hex digits of the hash: 65,536 buckets per class


def split_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def stratified_split(
    df: DataFrame,
    label: str = "label",
    key: str = "doc_id",
    seed: int = 42,
    labels: Sequence = (0, 1, 2),
    train: int = 80,
    val: int = 10,
) -> DataFrame:
    """Add ``split``: per class, the first ``train`` percent in hash order, then ``val``, rest test.

    The exact cut is the hash of the row at the cut position. It is found from bucket counts and
    a sort of the one bucket that holds it; rows are then compared with their class's cuts. Full
    rows are never shuffled: only (label, bucket) counts and the rows of two buckets per class.
    ``key`` must be unique; rows whose label is not in ``labels`` get a null split.
    """
    hashed = df.select(F.col(label).alias("_label"), F.col(key).alias("_key")).where(
        F.col("_label").isin(*labels)
    ).withColumn("_hash", split_hash("_key", seed)).withColumn(
        "_bucket", F.substring("_hash", 1, BUCKET_DIGITS)
    )
    counts = hashed.groupBy("_label", "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_label").orderBy("_bucket")
    whole = Window.partitionBy("_label")
    ranked = counts.select(
        "_label", "_bucket",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
        F.sum("_n").over(upto).alias("_through"),
        F.sum("_n").over(whole).alias("_size"),
    )
    wanted = F.explode(F.array(
        F.struct(F.lit("train").alias("cut"), F.expr(f"_size * {train} div 100").alias("at")),
        F.struct(F.lit("val").alias("cut"), F.expr(f"_size * {train + val} div 100").alias("at")),
    ))
    holding = ranked.withColumn("_cut", wanted).where(
        (F.col("_cut.at") > F.col("_before")) & (F.col("_cut.at") <= F.col("_through"))
    ).select("_label", "_bucket", F.col("_cut.cut").alias("_cut"),
             (F.col("_cut.at") - F.col("_before")).alias("_rank"))
    # at most two rows per entry of `labels`
    candidates = hashed.join(F.broadcast(holding), ["_label", "_bucket"])
    inside = Window.partitionBy("_label", "_cut").orderBy("_hash", "_key")
    cuts = (
        candidates.withColumn("_row", F.row_number().over(inside))
        .where(F.col("_row") == F.col("_rank"))
        .groupBy("_label")
        .agg(
            F.max(F.when(F.col("_cut") == "train", F.struct("_hash", "_key"))).alias("_train"),
            F.max(F.when(F.col("_cut") == "val", F.struct("_hash", "_key"))).alias("_val"),
        )
    )
    # a class too small to reach a cut has no cut row: compare false and fall through
    known = df.withColumn("_hash", split_hash(key, seed))
    here = F.struct(F.col("_hash"), F.col(key).alias("_key"))
    split = (
        F.when(~F.coalesce(F.col(label).isin(*labels), F.lit(False)), F.lit(None).cast("string"))
        .when(F.coalesce(here <= F.col("_train"), F.lit(False)), "train")
        .when(F.coalesce(here <= F.col("_val"), F.lit(False)), "val")
        .otherwise("test")
    )
    joined = known.join(F.broadcast(cuts), F.col(label) == F.col("_label"), "left")
    return joined.select(*df.columns, split.alias("split"))
