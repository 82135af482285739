"""Scores and the classes read off them. The scales differ by purpose and stay apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewell.schemas import MATCH_TYPES

# Weights, thresholds and points.
HEURISTIC_WEIGHT, MODEL_WEIGHT = 0.7, 0.3
BLEND_MATCH, BLEND_UNKNOWN = 0.7, 0.3
OVERALL_HEURISTIC_WEIGHT, OVERALL_MODEL_WEIGHT = 0.4, 0.6
TYPE_RANK = {"IDENTICAL": 3, "HOMOGENEOUS": 2, "NO_MATCH": 1}
BAND_IDENTICAL, BAND_HOMOGENEOUS = 90, 70
FALLBACK_BASE, FALLBACK_CODE, FALLBACK_MAKER, FALLBACK_IDENTICAL = 50, 30, 20, 80
ANSWER_BANDS = [(95, "Identical"), (75, "Homogeneous"), (40, "Partial")]
ANSWER_LOWEST = "Mismatch"
NOTHING_PROCESSED = "No contracts were processed"


def blended_confidence(heuristic: Column, model: Column) -> Column:
    """Heuristic and model confidence, weighted; a missing model score counts as zero."""
    return heuristic * F.lit(HEURISTIC_WEIGHT) + F.coalesce(model, F.lit(0.0)) * F.lit(MODEL_WEIGHT)


def blended_status(confidence: Column) -> Column:
    return (
        F.when(confidence >= BLEND_MATCH, F.lit("MATCH"))
        .when(confidence >= BLEND_UNKNOWN, F.lit("UNKNOWN"))
        .otherwise(F.lit("DIFF"))
    )


def overall_score(heuristic: Column, model_percent: Column) -> Column:
    """Overall similarity with the model's percent score, 40 to 60."""
    return heuristic * F.lit(OVERALL_HEURISTIC_WEIGHT) + model_percent / F.lit(100.0) * F.lit(OVERALL_MODEL_WEIGHT)


def selection_score(
    match_type: Column, ai_score: Column, maker_match: Column, sign_year: Column, unit_price: Column, as_of_year: int
) -> Column:
    """Rank points for picking the contracts a ceiling price is made of."""
    rank = F.lit(1)
    for name, points in TYPE_RANK.items():
        rank = F.when(match_type == name, F.lit(points)).otherwise(rank)
    recency = F.when(sign_year >= as_of_year - 1, F.lit(10)).when(sign_year >= as_of_year - 3, F.lit(5))
    return (
        rank * F.lit(10.0)
        + F.coalesce(ai_score, F.lit(0)) * F.lit(0.5)
        + F.when(maker_match, F.lit(10.0)).otherwise(F.lit(0.0))
        + F.coalesce(recency, F.lit(0))
        + F.when(unit_price.isNotNull(), F.lit(5.0)).otherwise(F.lit(0.0))
    )


def type_of_score(score: Column) -> Column:
    return (
        F.when(score >= BAND_IDENTICAL, F.lit("IDENTICAL"))
        .when(score >= BAND_HOMOGENEOUS, F.lit("HOMOGENEOUS"))
        .otherwise(F.lit("NO_MATCH"))
    )


def answer_band(score: Column) -> Column:
    """The class a model is told to give a score."""
    chain = None
    for least, name in ANSWER_BANDS:
        chain = F.when(score >= least, F.lit(name)) if chain is None else chain.when(score >= least, F.lit(name))
    return chain.otherwise(F.lit(ANSWER_LOWEST))


def known_match_type(text: Column, mapped: bool = False) -> Column:
    """Model match-type text as an enum value, unknown texts as no match.

    ``mapped`` also reads the names of the answer scale.
    """
    value = F.upper(text) if mapped else text
    return F.when(value.isin(MATCH_TYPES), value).otherwise(F.lit("NO_MATCH"))


def acceptable(match_type: Column, maker_match: Column, is_recent: Column) -> Column:
    """Alike, by the wanted maker, and recent."""
    return (
        match_type.isin("IDENTICAL", "HOMOGENEOUS")
        & F.coalesce(maker_match, F.lit(False))
        & F.coalesce(is_recent, F.lit(False))
    )


def fallback_score(code_match: Column, maker_match: Column) -> Column:
    """Score without a model: a base with points for code and maker, at most 100."""
    points = (
        F.lit(FALLBACK_BASE)
        + F.when(code_match, F.lit(FALLBACK_CODE)).otherwise(F.lit(0))
        + F.when(maker_match, F.lit(FALLBACK_MAKER)).otherwise(F.lit(0))
    )
    return F.least(F.lit(100), points)


def fallback_type(score: Column) -> Column:
    return F.when(score >= FALLBACK_IDENTICAL, F.lit("IDENTICAL")).otherwise(F.lit("HOMOGENEOUS"))


def final_status(error: Column, processed: Column) -> Column:
    failed = (error.isNotNull() & (error != "")) | (processed == 0)
    return F.when(failed, F.lit("ERROR")).otherwise(F.lit("DONE"))


def final_error(error: Column, processed: Column) -> Column:
    given = F.nullif(error, F.lit(""))
    return F.coalesce(given, F.when(processed == 0, F.lit(NOTHING_PROCESSED)))
