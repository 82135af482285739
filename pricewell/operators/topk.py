"""Top-k, dedupe, numbering and paging, per group and without hot tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.operators.keys import joined_on

# Up to this k Spark keeps only k rows per group and task before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold).
PRUNED_LIMIT = 1000
SALTS = 64


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int | Column,
    at_most: int | None = None,
    rank: str | None = None,
    salted: bool = True,
    told_by: Sequence[str] = (),
) -> DataFrame:
    """The first ``k`` rows of each group; ``order`` must be total for a repeatable result.

    With a column ``k`` every row is ranked, unless ``at_most`` says what its values were
    validated against. With a bound up to ``PRUNED_LIMIT`` each task sends at most that many
    rows per group through the shuffle. With ``salted`` the rows of a group are first cut in
    salted parts, so the task that ranks a hot group sees k rows per salt and not k rows per
    input task. Leave it out where groups are small already, or where there are so many that
    none can be hot. ``told_by`` names columns that tell rows apart (all plain ones
    otherwise); with few of them the others need not be read unless they are wanted.
    """
    bound = k if isinstance(k, int) else at_most
    if salted or bound is None or bound > PRUNED_LIMIT:
        parted = df.withColumn("__salt", F.pmod(F.xxhash64(*(told_by or _plain_columns(df))), F.lit(SALTS)))
        df = _first_rows(parted, [*keys, "__salt"], order, k, bound, "__rn").drop("__rn", "__salt")
    kept = _first_rows(df, keys, order, k, bound, rank or "__rn")
    return kept if rank else kept.drop("__rn")


def _plain_columns(df: DataFrame) -> list[str]:
    """The columns a row is told apart by: texts, numbers and dates, no nested ones."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return [field.name for field in df.schema.fields if not isinstance(field.dataType, nested)]


def _first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | Column, bound: int | None, rank: str
) -> DataFrame:
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    kept = ranked if bound is None else ranked.filter(F.col(rank) <= bound)
    return kept if isinstance(k, int) else kept.filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, chosen by ``order``; each task drops its copies before the shuffle."""
    return top_k(df, keys, order, 1, salted=False)


def numbered(
    df: DataFrame, keys: Sequence[str], steps: Sequence[tuple[Column, bool]], order: Sequence[Column], name: str
) -> DataFrame:
    """Row number over whole groups of any size.

    ``steps`` are values the order starts with, coarse to fine, each with True if it
    descends (a day, then the first letters of an id, say). Rows are numbered inside their
    step, and the sizes of the steps before it give each step its offset, so no task sorts
    more than one step of one group. Null keys and steps are a group and a step like others.
    """
    names = [f"__step{i}" for i in range(len(steps))]
    stepped = df.withColumns({step: value for step, (value, _) in zip(names, steps)})
    directions = [F.desc(step) if down else F.asc(step) for step, (_, down) in zip(names, steps)]
    before = W.partitionBy(*keys).orderBy(*directions).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        stepped.groupBy(*keys, *names)
        .agg(F.count("*").alias("__n"))
        .withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    local = F.row_number().over(W.partitionBy(*keys, *names).orderBy(*order))
    return (
        joined_on(stepped.withColumn("__local", local), offsets, [*keys, *names])
        .withColumn(name, F.col("__offset") + F.col("__local"))
        .drop(*names, "__local", "__offset")
    )


def page(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], skip: int, limit: int, rank: str = "position"
) -> DataFrame:
    """Rows ``skip+1 .. skip+limit`` of each group, with the position and the page number."""
    upto = top_k(df, keys, order, skip + limit, rank=rank)
    return upto.filter(F.col(rank) > skip).withColumn("page", F.lit(skip // limit + 1 if limit > 0 else 1))


def with_group_total(df: DataFrame, whole: DataFrame, keys: Sequence[str], name: str = "total") -> DataFrame:
    """Adds the row count of each group of ``whole``, counted map-side first."""
    return joined_on(df, whole.groupBy(*keys).agg(F.count("*").alias(name)), keys)


def page_bounds(total: Column, asked_page: Column, rows: int) -> dict[str, Column]:
    """Page number clamped to what exists, and the first and last row shown."""
    pages = F.ceil(total / F.lit(rows)).cast("bigint")
    current = F.greatest(F.lit(1), F.when(pages > 0, F.least(asked_page, pages)).otherwise(asked_page)).cast("bigint")
    start = (current - 1) * rows
    return {
        "pages": pages,
        "page": current,
        "row_from": F.when(total > 0, start + 1).otherwise(F.lit(0)).cast("bigint"),
        "row_to": F.least(start + rows, total).cast("bigint"),
    }
