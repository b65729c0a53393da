"""Lexicon tables from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import CATEGORIES


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A ``category,term`` CSV with a header."""
    table = spark.read.schema("category string, term string").csv(path, header=True)
    return table.select(F.lower(F.trim("category")).alias("category"),
                        F.lower(F.trim("term")).alias("term")).where(
        F.col("category").isin(*CATEGORIES) & (F.col("term") != "")
    ).distinct()


def read_master_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The published master dictionary layout: one ``Word`` per row and one column per category
    that is non-zero (the year of entry; negative once removed) for members."""
    table = spark.read.options(header=True).csv(path)
    member = F.array_compact(F.array(*[
        F.when(F.col(c.capitalize()).cast("int") > 0, F.lit(c)) for c in CATEGORIES
    ]))
    return table.select(F.explode(member).alias("category"), F.lower("Word").alias("term"))
