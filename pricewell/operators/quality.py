"""Constraints as data-quality checks: one pass per table, counts per rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.operators.sizing import broadcast_if_small
from pricewell.schemas import (
    AI_SCORE_RANGE,
    INPUT_SOURCES,
    LENGTH_BOUNDS,
    LIMIT_RANGE,
    MATCH_STATUSES,
    MATCH_TYPES,
    SEARCH_STATUSES,
    WEIGHT_RANGE,
)

# Columns that must not be null.
REQUIRED = {
    "requests": [
        "object_name", "ktru_code", "customer_region", "law", "date_from", "date_to", "execution_statuses",
        "limit_contracts", "status", "input_source",
    ],
    "results": [
        "search_id", "reestr_number", "contract_url", "sign_date", "currency", "match_type", "ai_score",
        "accepted_for_nmc",
    ],
    "spec_rows": ["contract_result_id", "name", "match_status", "weight"],
}


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking each rule; a rule is a column that is true where it is broken."""
    counts = df.agg(*[F.count_if(broken).alias(name) for name, broken in rules.items()])
    pairs = [F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("violations")) for name in rules]
    return counts.select(F.inline(F.array(*pairs)))


def violations_with_repeats(
    df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str], repeated: str
) -> DataFrame:
    """The same with one more rule, the keys that occur more than once, in one pass over the rows.

    Each task counts by key before the shuffle, so a hot key is one row of a task.
    """
    columns = {f"__rule{i}": broken for i, broken in enumerate(rules.values())}
    by_key = df.groupBy(*keys).agg(
        F.count("*").alias("__n"), *[F.count_if(broken).alias(name) for name, broken in columns.items()]
    )
    counts = by_key.agg(
        F.count_if(F.col("__n") > 1).alias("__repeated"), *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in columns]
    )
    named = {**dict(zip(rules, columns)), repeated: "__repeated"}
    pairs = [F.struct(F.lit(rule).alias("rule"), F.col(name).cast("bigint").alias("violations")) for rule, name in named.items()]
    return counts.select(F.inline(F.array(*pairs)))


def with_parent_flag(children: DataFrame, parents: DataFrame, on: str, flag: str) -> DataFrame:
    """Children with a flag that says whether their parent exists."""
    known = broadcast_if_small(parents.select(on).distinct().withColumn("__known", F.lit(True)))
    return children.join(known, on, "left").withColumn(flag, F.col("__known").isNotNull()).drop("__known")


def outside(value: Column, bounds: tuple[int, int]) -> Column:
    return ~value.between(*bounds)


def score_rule(score: Column) -> Column:
    return outside(score, AI_SCORE_RANGE)


def weight_rule(weight: Column) -> Column:
    return outside(weight, WEIGHT_RANGE)


def limit_rule(limit: Column) -> Column:
    return outside(limit, LIMIT_RANGE)


def period_rule(date_from: Column, date_to: Column) -> Column:
    return date_to < date_from


def length_rules(table: str, bounds: Mapping[str, int]) -> dict[str, Column]:
    return {f"{table}.{name} too long": F.length(name) > limit for name, limit in bounds.items()}


def required_rules(table: str, columns: Sequence[str]) -> dict[str, Column]:
    return {f"{table}.{name} missing": F.col(name).isNull() for name in columns}


def domain_rule(value: Column, domain: Sequence[str]) -> Column:
    return ~value.isin(*domain)


def duplicate_keys(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Keys that occur more than once, as one counted rule."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > 1)
    return repeated.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def missing_parents(children: DataFrame, parents: DataFrame, on: str, rule: str) -> DataFrame:
    """Children without a parent, as one counted rule."""
    lost = children.select(on).join(parents.select(on), on, "left_anti")
    return lost.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def request_rules() -> dict[str, Column]:
    """All constraints of the request table."""
    return {
        "requests.status unknown": domain_rule(F.col("status"), SEARCH_STATUSES),
        "requests.input_source unknown": domain_rule(F.col("input_source"), INPUT_SOURCES),
        "requests.period reversed": period_rule(F.col("date_from"), F.col("date_to")),
        "requests.limit_contracts out of range": limit_rule(F.col("limit_contracts")),
        **length_rules("requests", LENGTH_BOUNDS["requests"]),
        **required_rules("requests", REQUIRED["requests"]),
    }


def result_rules() -> dict[str, Column]:
    """All constraints of the result table."""
    return {
        "results.ai_score out of range": score_rule(F.col("ai_score")),
        "results.match_type unknown": domain_rule(F.col("match_type"), MATCH_TYPES),
        **length_rules("results", LENGTH_BOUNDS["results"]),
        **required_rules("results", REQUIRED["results"]),
    }


def spec_row_rules() -> dict[str, Column]:
    """All constraints of the comparison rows."""
    return {
        "spec_rows.match_status unknown": domain_rule(F.col("match_status"), MATCH_STATUSES),
        "spec_rows.weight out of range": weight_rule(F.col("weight")),
        **length_rules("spec_rows", LENGTH_BOUNDS["spec_rows"]),
        **required_rules("spec_rows", REQUIRED["spec_rows"]),
    }
