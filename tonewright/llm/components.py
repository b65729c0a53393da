"""Connected components of a table of links, by joins, and of a few in memory."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.llm.common import checkpoint


def connected_components(links: DataFrame) -> DataFrame:
    """``a, b`` (links in either direction) -> ``node, component``: the smallest node reachable.

    Every round ties the larger neighbours of each node to the smallest one, then the smaller
    neighbours (large star, small star), until each component is a star around its smallest node, which a
    count tells, so no round is made in vain; the number of rounds grows with the logarithm of the largest component. Nodes of many links are met by grouped minima that combine
    before the shuffle and by joins that adaptive execution can split; no group is gathered. Nulls and
    links of a node to itself are left out; nodes without a link don't appear.
    """
    edges = checkpoint(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while not _are_stars(edges):
        edges = checkpoint(_small_star(_large_star(edges)))
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select("v", "v").distinct().toDF("node", "component"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger node has one edge and is no edge's smaller node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("larger")).union(edges.select("v", F.lit(None).cast("int")))
    counted = ends.groupBy("node").agg(F.count("larger").alias("larger"), F.count("*").alias("n"))
    return counted.where("larger > 0 and n > 1").count() == 0


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    lowest = both.groupBy("u").agg(F.min("v").alias("low"))
    lowest = lowest.select("u", F.least("u", "low").alias("low"))
    tied = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return tied.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge goes from the larger node to the smaller one here
    lowest = edges.groupBy("u").agg(F.min("v").alias("low"))
    tied = edges.join(lowest, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return tied.union(lowest.select("u", "low")).distinct()


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of ``n`` nodes."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low
