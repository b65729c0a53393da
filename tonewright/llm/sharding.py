"""Sharding by jump consistent hashing.

A key's shard is found by jumps: from shard b the next one is ``floor((b + 1) / u)`` with ``u`` drawn
from the key and the number of the jump; the last jump below the number of shards counts. So one more
shard takes 1 of n + 1 keys, all into itself, and no table of a ring is kept. Columns only, no Python.

Nulls and odd input: a null key hashes like any other and has one shard; rows with equal keys share a
shard and get slots in any order; a null text has no bytes; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.llm.common import running_total

ROW_BYTES = 16


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of ``key`` among ``shards``."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def step(state: Column, number: Column) -> Column:
        drawn = F.shiftrightunsigned(F.xxhash64(key, number), 33).cast("double")  # 31 bits
        following = F.floor((state["next"] + 1) * (2.0 ** 31) / (drawn + 1))
        go = state["next"] < shards
        return F.struct(
            F.when(go, state["next"]).otherwise(state["shard"]).alias("shard"),
            F.when(go, following).otherwise(state["next"]).alias("next"),
        )

    start = F.struct(F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
    # every jump goes on by one shard at least, so this many are enough
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["shard"].cast("int"))


def assign_shards(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", row_bytes: int = ROW_BYTES
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row.

    ``size`` is the bytes of the text and ``row_bytes``; ``slot`` numbers a shard's rows from 0 in the order of
    a hash; ``grown_shard`` is the shard if there were one more. Slots come from totals of ranges, so no
    shard is gathered in one task.
    """
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    light = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + row_bytes).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    ).withColumn("shard", jump_shard(F.col("doc_id"), shards)).withColumn(
        "grown_shard", jump_shard(F.col("doc_id"), shards + 1))
    order = [F.col("shard"), F.xxhash64("doc_id", "text_crc32"), F.col("doc_id")]
    placed = running_total(light, order, F.lit(1).cast("long"), "place")
    begins = placed.groupBy(F.col("shard").alias("s")).agg(F.min("place").alias("begin"))
    # as many rows as there are shards
    return placed.join(F.broadcast(begins), F.col("shard") == F.col("s")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("place") - F.col("begin")).cast("long").alias("slot"), "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Write whole rows as Parquet, one folder for each shard; rows need no shuffle for that."""
    docs.withColumn("shard", jump_shard(F.col(key), shards)).write.partitionBy("shard").parquet(path)
