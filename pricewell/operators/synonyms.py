"""Groups of synonymous names from a table of pairs.

If a means b and b means c, all three are one group, whose name is its least one. Every name takes the least
name that it and its neighbours know, and then what that name itself has taken, so long chains shrink
by half a round. A round is a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.functions.text import strip
from pricewell.operators.sizing import broadcast_if_small
from pricewell.session import materialized


def plain_name(name: Column) -> Column:
    return strip(F.lower(name))


def groups(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """name and canonical for each name of the pairs; null and empty names, and pairs of one name, join nothing."""
    pairs = pairs.select(plain_name(F.col(a)).alias("a"), plain_name(F.col(b)).alias("b")).where("a != '' AND b != ''")
    both = materialized(pairs.union(pairs.select("b", "a")).distinct(), "synonyms")
    now = materialized(both.groupBy(F.col("a").alias("name")).agg(F.least(F.min("a"), F.min("b")).alias("canonical")), "names")
    while True:
        around = both.join(now.select(F.col("name").alias("b"), "canonical"), "b").groupBy(F.col("a").alias("name")).agg(F.min("canonical").alias("around"))
        hooked = now.join(around, "name").select("name", F.least("canonical", "around").alias("to"), F.col("canonical").alias("was"))
        hooked = materialized(hooked, "hooked")
        jump = hooked.select(F.col("name").alias("to"), F.col("to").alias("further"))
        later = materialized(hooked.join(jump, "to").select("name", F.least("to", "further").alias("canonical"), "was"), "names")
        now = later.select("name", "canonical")
        if later.where("canonical != was").isEmpty():
            return now


def with_canonical(rows: DataFrame, name: str, known: DataFrame, out: str = "canonical") -> DataFrame:
    """Adds the name of the group that a name is in, or else the plain name itself."""
    named = known.select(F.col("name").alias("__name"), F.col("canonical").alias("__canonical"))
    joined = rows.withColumn("__name", plain_name(F.col(name))).join(broadcast_if_small(named), "__name", "left")
    return joined.withColumn(out, F.coalesce("__canonical", "__name")).drop("__name", "__canonical")
