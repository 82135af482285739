"""Joins on group keys in which null is a key like any other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins on equal keys, null being equal to null; the keys of the left side stay.

    A struct of nulls equals another one, so the keys are compared as one struct.
    """
    group = F.struct(*keys, F.lit(0).alias("__one")).alias("__group")
    rest = [c for c in right.columns if c not in keys]
    return left.select("*", group).join(right.select(group, *rest), "__group", how).drop("__group")
