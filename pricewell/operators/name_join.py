"""A similarity join of names that loses no pair.

Names are alike where the best of four ratios is above a threshold t (``functions/similarity.py``). Every ratio is
that of a longest common subsequence, of length L, of two texts of N characters together: 2 L / N > t. The L
matched characters make L - 1 neighbours, of which each of the N - 2 L other characters parts at most one, so the
texts share at least 3 L - N - 1 pairs of neighbouring characters, that is more than (1.5 t - 1) N - 1. A text of x
characters meets none of less than x t / (2 - t), or no window of less, so it shares more than

    c x - 1 pairs,  c = (3 t - 2) / (2 - t).

- *Whole and partial ratio*: the pairs of a window are pairs of its text, so the bound holds between the shorter
  name and all of the longer one.
- *Ratios of sorted and of distinct words*: a text of words with a space before and behind has the same pairs in
  whatever order its words stand. The two added spaces match, which makes the bound c x + 1; x is the length of the
  distinct words. Shared words alone, against a name of x characters, are x t / (2 - t) at least: more than that.

A name that must share T of its G pairs has one among any G - T + 1 of them. The shorter name looks with its
rarest ones among all pairs of the longer names. Where the bound gives no pair (names of few characters)
single characters take their place: more than x t / (2 - t) are shared. A pair or character that occurs
again in a name counts as another one. Equal texts, and texts of equal sorted words, are joined as such.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.functions import similarity
from pricewell.operators.sizing import broadcast_if_small
from pricewell.session import materialized

#: White space as the ratios split names.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: Keeps bounds on the safe side of rounding.
EPSILON = 1e-9


def _occurrences(items: Column) -> Column:
    """The items, the n-th of equal ones told apart by n."""
    return F.transform(items, lambda x, i: F.concat(x, F.lit("\x1f"), F.size(F.filter(F.slice(items, 1, i + 1), lambda y: y == x)).cast("string")))


def _pieces(text: Column, size: int) -> Column:
    """The texts of ``size`` neighbouring characters."""
    none = F.array().cast("array<string>")
    last = F.length(text) - (size - 1)
    return F.when(last < 1, none).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(size))))


def _words(text: Column) -> Column:
    return F.array_sort(F.filter(F.split(text, SPACE), lambda w: w != ""))


def _forms(names: DataFrame, block: Sequence[str], threshold: float) -> DataFrame:
    """A row for each name and way of looking: form, x (the size to compare by), grams and how many are looked with."""
    c, share = (3 * threshold - 2) / (2 - threshold), threshold / (2 - threshold)
    words = _words(F.col("__name"))
    size = F.length("__name")
    least = lambda bound: F.floor(bound - EPSILON)
    spaced = F.flatten(F.transform(words, lambda w: _pieces(F.concat(F.lit(" "), w, F.lit(" ")), 2)))
    form = lambda name, x, grams, shared: F.struct(
        F.lit(name).alias("form"), x.alias("x"), _occurrences(grams).alias("grams"), shared.cast("int").alias("shared")
    )
    distinct = F.length(F.array_join(F.array_distinct(words), " "))
    whole = form("text", size, _pieces(F.col("__name"), 2), least(size * c))
    few = form("few", size, _pieces(F.col("__name"), 1), least(size * share) + 1)
    by_words = form("words", distinct, spaced, least(distinct * c + 1) + 1)
    rows = names.select(*block, "__name", F.inline(F.array(whole, few, by_words)))
    # pairs for names that must share one, characters for the others; the longer names of either are looked in as both
    return rows.withColumn("looks", F.when(F.col("form") == "few", F.floor(size * c - EPSILON) < 1).otherwise(F.col("shared") >= 1))


def candidates(a: DataFrame, b: DataFrame, block: Sequence[str], threshold: float) -> DataFrame:
    """Pairs (block, __a, __b) of distinct names (block, __name), among them all that are alike."""
    sides = [materialized(_forms(side, block, threshold), "forms") for side in (a, b)]
    counts = reduce(DataFrame.unionByName, [s.select("form", F.explode("grams").alias("gram")) for s in sides])
    counts = broadcast_if_small(materialized(counts.groupBy("form", "gram").agg(F.count(F.lit(1)).alias("n")), "grams"))

    def looked_with(side: DataFrame) -> DataFrame:
        grams = side.where("looks").select(*block, "__name", "form", "x", "shared", F.size("grams").alias("g"), F.explode("grams").alias("gram"))
        ranked = grams.join(counts, ["form", "gram"]).groupBy(*block, "__name", "form", "x", "shared", "g")
        first = F.slice(F.array_sort(F.collect_list(F.struct("n", "gram"))), 1, F.greatest(F.col("g") - F.col("shared") + 1, F.lit(1)))
        return ranked.agg(F.transform(first, lambda x: x["gram"]).alias("grams")).select(*block, "__name", "form", "x", F.explode("grams").alias("gram"))

    def met(one: DataFrame, other: DataFrame, names: tuple[str, str]) -> DataFrame:
        short = looked_with(one).withColumnsRenamed({"__name": "__one", "x": "__x"})
        # characters are looked up in blocks that have names of few characters only
        rows = other.join(short.select(*block, "form").distinct(), [*block, "form"], "left_semi")
        long = rows.select(*block, "form", F.col("__name").alias("__other"), F.col("x").alias("__y"), F.explode("grams").alias("gram"))
        pairs = short.join(long, [*block, "form", "gram"]).where("__x <= __y")
        return pairs.select(*block, F.col("__one").alias(names[0]), F.col("__other").alias(names[1])).select(*block, "__a", "__b")

    def equal(key: Column) -> DataFrame:
        one, other = a.withColumn("__key", key).withColumnRenamed("__name", "__a"), b.withColumn("__key", key).withColumnRenamed("__name", "__b")
        return one.join(other, [*block, "__key"]).select(*block, "__a", "__b")

    parts = [met(*sides, ("__a", "__b")), met(*sides[::-1], ("__b", "__a"))]
    parts += [equal(F.col("__name")), equal(F.array_join(_words(F.col("__name")), " "))]
    return reduce(DataFrame.unionByName, parts).distinct()


def similar_names(
    left: DataFrame, right: DataFrame, block: Sequence[str], left_name: str, right_name: str, threshold: float
) -> DataFrame:
    """All pairs of distinct lower-case names of one block whose similarity is above the threshold, and that.

    Null names and null blocks meet nothing. The threshold is above 2/3: below, alike names need not share
    a pair of neighbouring characters.
    """
    if not 2 / 3 < threshold < 1 or not math.isfinite(threshold):
        raise ValueError("the threshold must be above 2/3 and below 1")
    side = lambda df, name: df.select(*block, F.lower(name).alias("__name")).dropna().distinct()
    a, b = materialized(side(left, left_name), "names"), materialized(side(right, right_name), "names")
    scored = candidates(a, b, block, threshold).withColumn("similarity", similarity.text_similarity(F.col("__a"), F.col("__b")))
    return scored.filter(F.col("similarity") > threshold).select(
        *block, F.col("__a").alias(left_name), F.col("__b").alias(right_name), "similarity"
    )
