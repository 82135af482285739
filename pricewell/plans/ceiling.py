"""Price ceiling per request, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.operators import joins, prices, topk
from pricewell.operators.dedupe import one_per_search_and_number
from pricewell.schemas import LIMIT_RANGE
from pricewell.sources import tables

SELECTED_PER_REQUEST = 3


def candidate_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.candidates(tables.contracts(spark, sf_dir), tables.requests(spark, sf_dir))


def candidates_of(spark: SparkSession, sf_dir: str, search_id: str) -> DataFrame:
    """The candidates of one search: what it asks for is handed to the scans."""
    wanted = tables.requests(spark, sf_dir).filter(F.col("id") == search_id)
    return joins.candidates(tables.contracts(spark, sf_dir, wanted), wanted)


def deduped(candidates: DataFrame) -> DataFrame:
    """One candidate per search and registry number."""
    return one_per_search_and_number(candidates, [F.asc("contract_id")])


def freshest(candidates: DataFrame) -> DataFrame:
    """The freshest candidates of each search, as many as its limit."""
    order = [F.desc("sign_date"), F.desc("registry_no")]
    return topk.top_k(
        deduped(candidates), ["search_id"], order, F.col("limit_contracts"), at_most=LIMIT_RANGE[1], told_by=["registry_no"]
    )


def best(scored: DataFrame, k: int = SELECTED_PER_REQUEST) -> DataFrame:
    """The best of the scored contracts processed for each search, of which there are at most its limit."""
    order = [F.desc("selection_score"), F.asc("contract_id")]
    return topk.top_k(scored, ["search_id"], order, k, salted=False)


def deduped_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(candidate_contracts(spark, sf_dir))


def freshest_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshest(candidate_contracts(spark, sf_dir))


def scored_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.with_match_attributes(freshest_contracts(spark, sf_dir))


def selected_contracts(spark: SparkSession, sf_dir: str, k: int = SELECTED_PER_REQUEST) -> DataFrame:
    return best(scored_contracts(spark, sf_dir), k)


def price_ceiling_per_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every request that may run; without a candidate its counts are 0 and its ceiling is null."""
    found = prices.small_group_ceiling(selected_contracts(spark, sf_dir), ["search_id"])
    searches = joins.valid_requests(tables.requests(spark, sf_dir)).select(F.col("id").alias("search_id"))
    counts = ["selected_count", "priced_count", "kept_count"]
    return searches.join(found, "search_id", "left").fillna(0, counts)
