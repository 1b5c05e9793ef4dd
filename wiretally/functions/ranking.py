"""Top-k per group."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1.

    The literal bound lets Catalyst put a partial limit before the shuffle, so a
    hot group sends at most k rows per input partition.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("bigint")).filter(F.col(rank) <= k)
