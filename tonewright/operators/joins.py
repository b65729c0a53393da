"""Joins of a large side with a look-up side of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOW = ("inner", "left", "left_semi", "left_anti")


def join_lookup(
    large: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    salts: int | None = None,
) -> DataFrame:
    """Equi-join with a look-up table.

    Without ``salts`` the planner decides: it compares bytes with the broadcast threshold, and
    adaptive execution splits what is skewed. With ``salts`` every look-up row is repeated once per
    salt and the large side is spread over the salts, so that one hot key is shared by that many
    tasks. Both give the same rows. The salt is a hash of ``spread_by`` (columns that tell rows of a
    hot key apart), so a recomputed task puts its rows where they were.
    """
    if how not in HOW:
        raise ValueError(f"join kind not supported: {how}")
    if salts is None:
        return large.join(lookup, list(on), how)
    salted = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = large.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    return spread.join(salted, [*on, "_salt"], how).drop("_salt")
