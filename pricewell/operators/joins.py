"""Joins of requests, contracts, results and their rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.functions.labels import law_code, status_codes
from pricewell.operators.sizing import broadcast_if_small
from pricewell.schemas import DEFAULT_LIMIT, DEFAULT_STATUS, INPUT_SOURCES, LIMIT_RANGE


def with_defaults(requests: DataFrame) -> DataFrame:
    """Requests with the default limit, statuses and input source where none is given."""
    given = F.col("execution_statuses")
    return requests.withColumns(
        {
            "limit_contracts": F.coalesce("limit_contracts", F.lit(DEFAULT_LIMIT)),
            "execution_statuses": F.coalesce(given, F.array(F.lit(DEFAULT_STATUS))),
            "input_source": F.coalesce("input_source", F.lit(INPUT_SOURCES[0])),
        }
    )


def request_faults() -> Column:
    """What is wrong with a request that has its defaults, as texts."""
    low, high = LIMIT_RANGE
    needed = ["object_name", "ktru_code", "customer_region", "law", "date_from", "date_to"]
    missing = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in needed]
    return F.array_compact(
        F.array(
            *missing,
            F.when(F.col("date_to") < F.col("date_from"), F.lit("date_to is before date_from")),
            F.when(~F.col("limit_contracts").between(low, high), F.lit(f"limit_contracts is not in {low} to {high}")),
        )
    )


def valid_requests(requests: DataFrame) -> DataFrame:
    """Requests that may run, with their defaults."""
    return with_defaults(requests).filter(F.size(request_faults()) == 0)


def rejected_requests(requests: DataFrame) -> DataFrame:
    """Requests that may not run, each with its ``faults``."""
    return with_defaults(requests).withColumn("faults", request_faults()).filter(F.size("faults") > 0)


def candidates(contracts: DataFrame, requests: DataFrame) -> DataFrame:
    """Every contract each valid request asks for: code, region, law, period and status.

    A counted-small request side is broadcast, so the contracts are not shuffled; a
    large one is joined on code, region and law, hot keys being split at run time.
    """
    wanted = valid_requests(requests).select(
        F.col("id").alias("search_id"),
        F.col("ktru_code").alias("code"),
        F.col("customer_region").alias("region"),
        law_code(F.col("law")).alias("law"),
        "date_from",
        "date_to",
        status_codes(F.col("execution_statuses")).alias("wanted_status"),
        "limit_contracts",
        F.col("object_name").alias("target_name"),
        F.col("manufacturer").alias("target_manufacturer"),
        F.col("size_mm").alias("target_size_mm"),
        F.col("retail_price").alias("target_retail_price"),
    )
    return (
        contracts.join(broadcast_if_small(wanted), ["code", "region", "law"])
        .filter(F.col("sign_date").between(F.col("date_from"), F.col("date_to")))
        # a request whose labels are all unknown asks for completed contracts
        .filter(
            F.when(
                F.size("wanted_status") > 0, F.array_contains("wanted_status", F.col("execution_status"))
            ).otherwise(F.col("execution_status") == "EXECUTION_COMPLETED")
        )
        .drop("date_from", "date_to", "wanted_status")
    )


def with_selected_flag(
    results: DataFrame, selected: DataFrame, keys: Sequence[str], flag: str = "accepted_for_nmc"
) -> DataFrame:
    """Marks results whose keys are among the selected ones.

    A counted-small selection is broadcast, so the results are not shuffled.
    """
    chosen = broadcast_if_small(selected.select(*keys).distinct().withColumn("__hit", F.lit(True)))
    return results.join(chosen, list(keys), "left").withColumn(flag, F.col("__hit").isNotNull()).drop("__hit")


def with_rows_only(results: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Results that have at least one child row."""
    return results.join(rows.select(*keys), list(keys), "left_semi")


def orphans(children: DataFrame, parents: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Children whose parent is missing."""
    return children.join(parents, on, "left_anti")


def cascade_delete(children: DataFrame, remaining_parents: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Children that survive the deletion of the other parents."""
    return children.join(remaining_parents, on, "left_semi")


def stoppable(requests: DataFrame) -> DataFrame:
    """Searches that may be stopped: the running ones."""
    return requests.filter(F.col("status") == "RUNNING")


def reportable(requests: DataFrame) -> DataFrame:
    """Searches that have a report: the finished ones."""
    return requests.filter(F.col("status") == "DONE")


def with_printed_text(contracts: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Contracts with the text of their printed form, null where there is none."""
    return contracts.join(texts, key, "left")


def without_stopped(running: DataFrame, stopped: DataFrame, key: str) -> DataFrame:
    """Searches still running: those without a stop flag."""
    return running.join(stopped, key, "left_anti")


def contract_pages(common: DataFrame, payments: DataFrame, attachments: DataFrame, key: str) -> DataFrame:
    """The three tabs of a contract; a missing tab leaves an empty list.

    What is read from pages is far larger than the tables they are estimated by, so that no tab is broadcast.
    """
    joined = common.join(payments.hint("merge"), key, "left").join(attachments.hint("merge"), key, "left")
    empty = {
        c: F.coalesce(F.col(c), F.array().cast(joined.schema[c].dataType))
        for c in ("line_items", "attachments")
        if c in joined.columns
    }
    return joined.withColumns(empty)
