"""Specification matching: requested against delivered characteristics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.functions import compare, scoring
from pricewell.operators.sizing import BROADCAST_ROWS
from pricewell.session import materialized


def spec_pairs(
    df: DataFrame, target: str = "target_specs", actual: str = "actual_specs", keep_empty: bool = False
) -> DataFrame:
    """Explodes two maps of characteristics into one row per name found in either.

    This is the full outer join by name, done inside each row: no shuffle. With ``keep_empty`` a
    row without characteristics on either side stays, with a null name.
    """
    pairs = F.map_zip_with(
        F.coalesce(F.col(target), F.create_map().cast("map<string,string>")),
        F.coalesce(F.col(actual), F.create_map().cast("map<string,string>")),
        lambda name, t, a: F.struct(
            F.coalesce(t, F.lit("")).alias("target_value"), F.coalesce(a, F.lit("")).alias("actual_value")
        ),
    )
    rest = [c for c in df.columns if c not in (target, actual)]
    explode = F.explode_outer if keep_empty else F.explode
    value = lambda side: F.coalesce(f"__pair.{side}", F.lit("")).alias(side)
    return df.select(*rest, explode(pairs).alias("name", "__pair")).select(
        *rest, "name", value("target_value"), value("actual_value")
    )


def spec_pairs_long(target: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same from long tables ``(keys, name, value)``: one grouping instead of an outer join."""
    sides = target.select(*keys, "name", F.col("value").alias("target_value"), F.lit(None).cast("string").alias("actual_value")).unionByName(
        actual.select(*keys, "name", F.lit(None).cast("string").alias("target_value"), F.col("value").alias("actual_value"))
    )
    return sides.groupBy(*keys, "name").agg(
        F.coalesce(F.max("target_value"), F.lit("")).alias("target_value"),
        F.coalesce(F.max("actual_value"), F.lit("")).alias("actual_value"),
    )


def spec_names(target: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct characteristic names of both sides."""
    return target.select(*keys, "name").union(actual.select(*keys, "name")).distinct()


def spec_comparison_rows(pairs: DataFrame, model_score: Column, **options) -> DataFrame:
    """Compared pairs with the heuristic confidence blended with the model's score."""
    compared = compare.with_comparison(pairs, "target_value", "actual_value", **options)
    return (
        compared.drop("match_status")
        .withColumnRenamed("confidence", "heuristic_confidence")
        .withColumn("ai_confidence", F.coalesce(model_score, F.lit(0.0)))
        .withColumn("confidence", scoring.blended_confidence(F.col("heuristic_confidence"), F.col("ai_confidence")))
        .withColumns({"match_status": scoring.blended_status(F.col("confidence")), "weight": F.lit(1)})
    )


def spec_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts by status and the mean confidence of each group.

    A row without a name stands for a group without characteristics and counts nothing: all
    numbers of such a group are zero.
    """
    named = F.col("name").isNotNull()
    exact = F.round(F.when(named, F.col("confidence")) * F.lit(1e9)).cast("bigint")
    status = F.when(named, F.col("match_status"))
    total = F.nullif(F.count("name"), F.lit(0))
    return rows.groupBy(*keys).agg(
        F.count("name").alias("total_specs"),
        F.count_if(status == "MATCH").alias("match_count"),
        F.count_if(status == "DIFF").alias("diff_count"),
        F.count_if(status == "UNKNOWN").alias("unknown_count"),
        F.coalesce(F.sum(exact) / total / F.lit(1e9), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.count_if(status == "MATCH") / total * F.lit(100.0), F.lit(0.0)).alias("match_percentage"),
    )


def match_specifications(
    contracts: DataFrame,
    keys: Sequence[str],
    target_maker: str,
    found_maker: str,
    model_score: Column,
    **options,
) -> DataFrame:
    """Summary of every contract's comparison, with the fuzzy maker comparison.

    ``contracts`` holds the maps ``target_specs`` and ``actual_specs``; a contract without any
    characteristics has a summary of zeros. The maker comparison is null where either maker is missing.
    """
    given = F.length(F.col(target_maker)) > 0
    both = given & (F.length(F.col(found_maker)) > 0)
    makers = contracts.withColumn(
        "manufacturer_confidence",
        F.when(both, compare.maker_similarity(F.col(target_maker), F.col(found_maker))),
    ).withColumn("manufacturer_match", F.col("manufacturer_confidence") >= compare.MAKER_THRESHOLD)
    carried = [*keys, "manufacturer_confidence", "manufacturer_match"]
    rows = spec_comparison_rows(spec_pairs(makers, keep_empty=True), model_score, **options)
    return spec_summary(rows, carried)


def makers_alike(df: DataFrame, target: str, found: Column, name: str, threshold: float = compare.MAKER_THRESHOLD) -> DataFrame:
    """Adds whether any maker of a list is alike to the wanted one; null where either side is missing.

    Only the distinct pairs of names are compared. ``found`` is an array; missing names in it are left out.
    The rows are stored first, as they are read for the pairs and for the result. Few makers are wanted, so that
    what is alike to each is broadcast if it is counted-small, and the rows of a maker many want meet in no task.
    """
    given = F.filter(F.transform(found, F.lower), lambda m: m.isNotNull() & (m != ""))
    wanted = F.nullif(F.lower(F.col(target)), F.lit(""))
    rows = materialized(df.withColumns({"__wanted": wanted, "__given": F.when(F.size(given) > 0, given)}), "makers")
    pairs = rows.select("__wanted", F.explode("__given").alias("__maker")).where("__wanted is not null").distinct()
    scored = pairs.withColumn("__score", compare.text_similarity(F.col("__wanted"), F.col("__maker")))
    alike = materialized(scored.where(F.col("__score") > threshold).select("__wanted", "__maker"), "alike")
    found_pairs = alike.limit(BROADCAST_ROWS + 1).count()
    alike = alike.groupBy("__wanted").agg(F.collect_set("__maker").alias("__alike"))
    if found_pairs <= BROADCAST_ROWS:
        alike = F.broadcast(alike)
    hit = F.coalesce(F.arrays_overlap("__given", "__alike"), F.lit(False))
    return (
        rows.join(alike, "__wanted", "left")
        .withColumn(name, F.when(F.col("__wanted").isNotNull() & F.col("__given").isNotNull(), hit))
        .drop("__wanted", "__given", "__alike")
    )


def key_comparison_rows(
    results: DataFrame, keys: Sequence[str], target_code: str, found_code: Column, code_match: str, maker_match: str
) -> DataFrame:
    """Three fixed rows per contract: code (weight 2), maker and object name (weight 1).

    ``code_match`` and ``maker_match`` name the flags of the comparison; an unset flag is no match.
    """
    matched = results.withColumns(
        {
            "__code": found_code,
            "__name_match": compare.name_match(F.col("target_name"), F.col("object_name")),
        }
    )

    def row(name: str, target: str, actual: str, match: str, weight: int) -> Column:
        status = F.when(F.col(match), F.lit("MATCH")).otherwise(F.lit("DIFF"))
        return F.struct(
            F.lit(name).alias("name"),
            F.nullif(F.col(target), F.lit("")).alias("target_value"),
            F.nullif(F.col(actual), F.lit("")).alias("actual_value"),
            status.alias("match_status"),
            F.lit(weight).alias("weight"),
        )

    rows = F.array(
        row("KTRU Code", target_code, "__code", code_match, 2),
        row("Manufacturer", "target_manufacturer", "manufacturer", maker_match, 1),
        row("Object Name", "target_name", "object_name", "__name_match", 1),
    )
    return (
        matched.select(*keys, F.inline(rows))
        .filter(F.coalesce(F.col("target_value"), F.col("actual_value")).isNotNull())
    )


def classify_by_fields(
    rows: DataFrame, keys: Sequence[str], mandatory: Sequence[str], least_share: float
) -> DataFrame:
    """Class and decision from the comparison rows of each contract.

    Identical if every mandatory field is there and matches; homogeneous if the weighted share of
    matching fields is large enough and no mandatory field conflicts; else no match.
    """
    match = F.col("match_status") == "MATCH"
    required = F.col("name").isin(*mandatory)
    # one flag a field, so that each task has one row of a contract to shuffle
    flags = [F.coalesce(F.bool_or(F.when(F.col("name") == field, match)), F.lit(False)) for field in sorted(set(mandatory))]
    met = reduce(Column.__and__, flags, F.lit(True))
    # a field that occurs twice must match both times
    unmet = F.coalesce(F.bool_or(F.when(required, ~match)), F.lit(False))
    grouped = rows.groupBy(*keys).agg(
        (met & ~unmet).alias("__all_required"),
        F.coalesce(F.bool_or(F.when(required, F.col("match_status") == "DIFF")), F.lit(False)).alias("__conflict"),
        (F.sum(F.when(match, F.col("weight")).otherwise(F.lit(0))) / F.sum("weight")).alias("match_share"),
    )
    alike = (F.col("match_share") >= least_share) & ~F.col("__conflict")
    match_type = (
        F.when(F.col("__all_required"), F.lit("IDENTICAL"))
        .when(alike, F.lit("HOMOGENEOUS"))
        .otherwise(F.lit("NO_MATCH"))
    )
    decision = (
        F.when(F.col("match_type") == "IDENTICAL", F.lit("ACCEPT"))
        .when(F.col("match_type") == "HOMOGENEOUS", F.lit("REVIEW"))
        .otherwise(F.lit("REJECT"))
    )
    return (
        grouped.withColumn("match_type", match_type)
        .withColumn("decision", decision)
        .drop("__all_required", "__conflict")
    )
