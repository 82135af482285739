"""Price aggregation: outliers, quartiles, ceilings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricewell.operators.keys import joined_on
from pricewell.operators.sizing import broadcast_if_small
from pricewell.session import materialized

IQR_FACTOR = 1.5
# Fewer prices than this say nothing about outliers.
IQR_LEAST = 3


def mean_price(price: Column) -> Column:
    """Mean of decimal prices from their exact sum."""
    return F.sum(price).cast("double") / F.count(price)


def price_positions(df: DataFrame, keys: Sequence[str], price: str) -> DataFrame:
    """Each distinct positive price of a group with its count, first position and the group size.

    A group has one more row, with a null price of no copies, where rows have no positive price;
    so a group without any stays. Works for groups of any size: equal prices are counted map-side, the rest is spread
    over price steps, and only the counts per step are summed up in one place. The counts
    are kept as a table, so the rows are read once for everything derived from them.
    """
    steps = F.floor(F.ln(F.col(price).cast("double")) * F.lit(64.0))
    given = df.withColumn(price, F.when(F.col(price) > 0, F.col(price)))
    priced = given.groupBy(*keys, price).agg(F.count(price).alias("copies"))
    counted = materialized(priced, "price-counts").withColumn("__step", steps)
    before = W.partitionBy(*keys).orderBy("__step").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        counted.groupBy(*keys, "__step")
        .agg(F.sum("copies").alias("__n"))
        .withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .withColumn("group_size", F.sum("__n").over(W.partitionBy(*keys)))
        .drop("__n")
    )
    inside = W.partitionBy(*keys, "__step").orderBy(price).rowsBetween(W.unboundedPreceding, -1)
    return (
        joined_on(
            counted.withColumn("__inside", F.coalesce(F.sum("copies").over(inside), F.lit(0))), offsets, [*keys, "__step"]
        )
        .withColumn("position", F.col("__offset") + F.col("__inside"))
        .drop("__offset", "__inside", "__step")
    )


def price_at(position: Column, price: str = "unit_price") -> Column:
    """Aggregate over positions: the price at a zero-based position."""
    here = (F.col("position") <= position) & (position < F.col("position") + F.col("copies"))
    return F.max(F.when(here, F.col(price)))


def iqr_bounds(positions: DataFrame, keys: Sequence[str], price: str = "unit_price") -> DataFrame:
    """Positional quartiles of each group and the bounds a price must keep within.

    The quartiles are the prices at n/4 and 3n/4, counted from zero and not interpolated.
    """
    n = F.col("group_size")
    quartiles = positions.groupBy(*keys).agg(
        F.max(n).alias("prices"),
        price_at(F.floor(n / 4), price).cast("double").alias("q1"),
        price_at(F.floor(n * 3 / 4), price).cast("double").alias("q3"),
    )
    spread = (F.col("q3") - F.col("q1")) * F.lit(IQR_FACTOR)
    unknown = F.col("prices") < IQR_LEAST
    return quartiles.withColumns(
        {
            "low": F.when(~unknown, F.col("q1") - spread),
            "high": F.when(~unknown, F.col("q3") + spread),
        }
    )


def _within(price: Column) -> Column:
    return F.col("low").isNull() | price.cast("double").between(F.col("low"), F.col("high"))


def cleaned_mean(positions: DataFrame, keys: Sequence[str], price: str = "unit_price") -> DataFrame:
    """Mean price of each group without its outliers, for groups of any size."""
    bounds = iqr_bounds(positions, keys, price)
    keep = _within(F.col(price))
    copies = F.when(keep, F.col("copies"))
    return (
        joined_on(positions, bounds, keys)
        .groupBy(*keys, "prices", "q1", "q3")
        .agg(
            F.coalesce(F.sum(copies), F.lit(0)).alias("kept"),
            (F.sum(F.col(price).cast("decimal(18,2)") * copies).cast("double") / F.nullif(F.sum(copies), F.lit(0))).alias("mean_price"),
        )
    )


def mean_within(df: DataFrame, quartiles: DataFrame, keys: Sequence[str], price: str = "unit_price") -> DataFrame:
    """Mean price of each group without its outliers, from its number of ``prices`` and quartiles ``q1`` and ``q3``."""
    spread = (F.col("q3") - F.col("q1")) * F.lit(IQR_FACTOR)
    known = F.col("prices") >= IQR_LEAST
    bounds = quartiles.withColumns({"low": F.when(known, F.col("q1") - spread), "high": F.when(known, F.col("q3") + spread)})
    kept = joined_on(df.filter(F.col(price) > 0), broadcast_if_small(bounds), keys).filter(_within(F.col(price)))
    means = kept.groupBy(*keys).agg(F.count("*").alias("kept"), mean_price(F.col(price)).alias("mean_price"))
    return joined_on(quartiles, means, keys).select(*keys, "prices", "q1", "q3", "kept", "mean_price")


def without_outliers(df: DataFrame, keys: Sequence[str], price: str = "unit_price") -> DataFrame:
    """The rows whose price is within their group's bounds; missing prices are dropped."""
    bounds = iqr_bounds(price_positions(df, keys, price), keys, price).select(*keys, "low", "high")
    # one row per group: broadcast if there are few groups, so the rows are not shuffled
    kept = joined_on(df.filter(F.col(price) > 0), broadcast_if_small(bounds), keys).filter(_within(F.col(price)))
    return kept.drop("low", "high")


def small_group_ceiling(selected: DataFrame, keys: Sequence[str], price: str = "unit_price") -> DataFrame:
    """Ceiling price of groups that hold at most a top-k selection.

    The group size is bounded by k, so its prices fit one array; use ``cleaned_mean``
    for groups without such a bound.
    """
    valid = F.when(F.col(price) > 0, F.col(price).cast("decimal(15,2)"))
    n = F.size("__prices")
    quartile = lambda share: F.get("__prices", F.floor(n * share / 4).cast("int")).cast("double")
    spread = (F.col("__q3") - F.col("__q1")) * F.lit(IQR_FACTOR)
    kept = F.filter(
        "__prices",
        lambda p: (F.size("__prices") < IQR_LEAST)
        | p.cast("double").between(F.col("__low"), F.col("__high")),
    )
    total = F.aggregate("__kept", F.lit(0).cast("decimal(25,2)"), lambda s, p: (s + p).cast("decimal(25,2)"))
    return (
        selected.groupBy(*keys)
        .agg(F.count("*").alias("selected_count"), F.array_sort(F.collect_list(valid)).alias("__prices"))
        .withColumns({"__q1": quartile(1), "__q3": quartile(3)})
        .withColumns({"__low": F.col("__q1") - spread, "__high": F.col("__q3") + spread})
        .withColumn("__kept", kept)
        .select(
            *keys,
            "selected_count",
            F.size("__prices").cast("bigint").alias("priced_count"),
            F.size("__kept").cast("bigint").alias("kept_count"),
            F.when(F.size("__kept") > 0, total.cast("double") / F.size("__kept")).alias("ceiling"),
        )
    )


def median_price(positions: DataFrame, keys: Sequence[str], price: str = "unit_price") -> DataFrame:
    """Median of each group, the mean of the two middle prices for an even count."""
    n = F.col("group_size")
    return (
        positions.groupBy(*keys)
        .agg(
            F.max(n).alias("prices"),
            price_at(F.floor((n - 1) / 2), price).cast("double").alias("__low"),
            price_at(F.floor(n / 2), price).cast("double").alias("__high"),
        )
        .withColumn("median_price", (F.col("__low") + F.col("__high")) / F.lit(2.0))
        .drop("__low", "__high")
    )


def trimmed_mean(
    positions: DataFrame, keys: Sequence[str], price: str = "unit_price", percent: int = 10
) -> DataFrame:
    """Mean of each group without the lowest and highest ``percent`` (below 50) of its prices."""
    cut = F.floor(F.col("group_size") * percent / 100)
    first = F.greatest(F.col("position"), cut)
    last = F.least(F.col("position") + F.col("copies"), F.col("group_size") - cut)
    inside = F.greatest(F.lit(0), last - first).cast("bigint")
    return positions.groupBy(*keys).agg(
        F.sum(inside).alias("used"),
        (F.sum(F.col(price).cast("decimal(18,2)") * inside).cast("double") / F.nullif(F.sum(inside), F.lit(0))).alias("trimmed_mean"),
    )
