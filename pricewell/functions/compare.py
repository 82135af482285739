"""Comparison of requested and delivered values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.functions.normalize import with_normalized
from pricewell.functions.similarity import text_similarity
from pricewell.functions.text import strip
from pricewell.functions.units import in_smallest_unit, units_compatible

# Tolerances and thresholds.
NUMERIC_TOLERANCE = 0.01
NUMERIC_MATCH = 0.8
STRING_THRESHOLD = 0.8
MAKER_THRESHOLD = 0.7
NAME_THRESHOLD = 0.8


def numeric_confidence(
    target: Column,
    actual: Column,
    target_unit: Column,
    actual_unit: Column,
    tolerance: float = NUMERIC_TOLERANCE,
    mode: str = "compat",
) -> Column:
    """Confidence 0 to 1 that two numbers agree.

    ``compat`` compares the bare numbers: inside the tolerance the confidence falls
    from 1 to 0, beyond it starts again from 1 minus the excess. ``strict`` converts
    compatible units first and falls linearly.
    """
    if mode == "strict":
        target, actual = in_smallest_unit(target, target_unit), in_smallest_unit(actual, actual_unit)
    gap = F.abs(target - actual) / F.greatest(F.abs(target), F.abs(actual))
    if mode == "strict":
        confidence = F.greatest(F.lit(0.0), F.lit(1.0) - gap)
    else:
        confidence = F.when(gap <= tolerance, F.lit(1.0) - gap / F.lit(tolerance)).otherwise(
            F.greatest(F.lit(0.0), F.lit(1.0) - (gap - F.lit(tolerance)))
        )
    return (
        F.when(~units_compatible(target_unit, actual_unit), F.lit(0.0))
        .when((target == 0) & (actual == 0), F.lit(1.0))
        .when((target == 0) | (actual == 0), F.lit(0.0))
        .otherwise(confidence)
    )


def with_comparison(
    df: DataFrame,
    target: str,
    actual: str,
    tolerance: float = NUMERIC_TOLERANCE,
    string_threshold: float = STRING_THRESHOLD,
    mode: str = "compat",
) -> DataFrame:
    """Adds ``method``, ``confidence`` and ``match_status`` for a pair of text columns.

    Two numbers are compared as numbers, anything else by text similarity.
    """
    parts = with_normalized(with_normalized(df, target, "__t"), actual, "__a")
    parts = parts.withColumn("__both", F.col("__t_is_numeric") & F.col("__a_is_numeric"))
    # equal texts are alike without asking the similarity function
    asked = ~F.col("__both") & (F.col("__t_normalized") != F.col("__a_normalized"))
    scored = parts.withColumn(
        "__text_score",
        text_similarity(F.when(asked, F.col("__t_normalized")), F.when(asked, F.col("__a_normalized"))),
    )
    numbers = numeric_confidence(
        F.col("__t_number"), F.col("__a_number"), F.col("__t_unit"), F.col("__a_unit"), tolerance, mode
    )
    enough = F.when(F.col("__both"), F.lit(1.0 - tolerance if mode == "strict" else NUMERIC_MATCH)).otherwise(
        F.lit(string_threshold)
    )
    return (
        scored.withColumn(
            "confidence", F.when(F.col("__both"), numbers).otherwise(F.coalesce(F.col("__text_score"), F.lit(1.0)))
        )
        .withColumns(
            {
                "method": F.when(F.col("__both"), F.lit("numeric")).otherwise(F.lit("string")),
                "match_status": F.when(F.col("confidence") >= enough, F.lit("MATCH")).otherwise(F.lit("DIFF")),
            }
        )
        .drop(*[c for c in scored.columns if c.startswith("__")])
    )


def _missing(text: Column) -> Column:
    return text.isNull() | (text == "")


def maker_exact(target: Column, found: Column) -> Column:
    """Null if either name is missing, else equality of the trimmed lower-case names."""
    return F.when(_missing(target) | _missing(found), F.lit(None).cast("boolean")).otherwise(
        strip(F.lower(target)) == strip(F.lower(found))
    )


def maker_contains(target: Column, found: Column) -> Column:
    """True if the found name contains the target name; false if either is missing."""
    return F.when(_missing(target) | _missing(found), F.lit(False)).otherwise(
        F.contains(F.lower(found), F.lower(target))
    )


def maker_contains_any(target: Column, found: Column) -> Column:
    """Whether any of an array of found names contains the target name; null where either side is missing."""
    given = F.filter(found, lambda m: ~_missing(m))
    return F.when(~_missing(target) & (F.size(given) > 0), F.exists(given, lambda m: F.contains(F.lower(m), F.lower(target))))


def maker_warning(is_recent: Column, target: Column, found: Column) -> Column:
    """True for a recent contract whose maker does not contain the wanted one."""
    return is_recent & ~_missing(target) & ~F.contains(F.lower(F.coalesce(found, F.lit(""))), F.lower(target))


def maker_similarity(target: Column, found: Column) -> Column:
    """Fuzzy maker similarity; 0 if either name is missing."""
    return F.when(_missing(target) | _missing(found), F.lit(0.0)).otherwise(
        text_similarity(strip(F.lower(target)), strip(F.lower(found)))
    )


def name_match(target: Column, actual: Column) -> Column:
    """Object names alike by more than the threshold; false if either is missing."""
    return F.when(_missing(target) | _missing(actual), F.lit(False)).otherwise(
        text_similarity(F.lower(target), F.lower(actual)) > NAME_THRESHOLD
    )


def stated_tolerance(requirement: Column) -> Column:
    """The tolerance a requirement text states after a plus-minus sign, in its own unit."""
    return F.replace(F.regexp_extract(requirement, r"±\s*([\d.,]+)", 1), F.lit(","), F.lit(".")).try_cast("double")


def within_stated_tolerance(target: Column, actual: Column, tolerance: Column) -> Column:
    """Exact equality unless a tolerance is stated."""
    return F.abs(target - actual) <= F.coalesce(tolerance, F.lit(0.0))
