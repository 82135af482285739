"""Gapless positions of rows in the order of their group, however large a group is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewell.operators.keys import joined_on
from pricewell.session import materialized

#: Fixed value: bits of a generated id that count the rows inside a partition.
ROW_BITS = 33


def sorted_parts(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """The rows written in order of group and ``order`` columns, nulls first, with ``at`` and ``part``.

    Ranges cut the order, so a large group is split over several parts. ``at`` ascends with the order;
    rows that are equal in all these columns come in any order.
    """
    ranged = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = materialized(ranged.withColumn("at", F.monotonically_increasing_id()), name)
    return placed.withColumn("part", F.shiftright("at", ROW_BITS))


def runs(placed: DataFrame, group: list[str]) -> DataFrame:
    """One row for each group and part: where its rows begin, how many come before, and the group's size."""
    found = placed.groupBy("part", *group).agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*group)
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return found.select("part", *group, "first_at", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(whole).alias("group_rows"))


def positioned(placed: DataFrame, found: DataFrame, group: list[str]) -> DataFrame:
    """Adds ``position`` from 0, and whatever else the runs carry.

    The join is on part and group, so a large group is no hot key.
    """
    joined = joined_on(placed, found, ["part", *group])
    return joined.withColumn("position", F.col("at") - F.col("first_at") + F.col("before")).drop("first_at", "before", "at")
