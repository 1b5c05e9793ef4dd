"""Turning arrays into rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def unfold(df: DataFrame, keep: list, array: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per array element, with the kept columns; empty arrays give none.

    A plain ``explode`` makes the optimizer add a size test on the array below
    it, which evaluates a costly array expression again. The outer form followed
    by a null test computes the array once.
    """
    array = F.col(array) if isinstance(array, str) else array
    made = F.posexplode_outer(array).alias(pos, name) if pos else F.explode_outer(array).alias(name)
    return df.select(*keep, made).filter(F.col(name).isNotNull())
