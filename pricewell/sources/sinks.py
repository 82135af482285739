"""Writing results, snapshots, reports and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.functions.scoring import known_match_type
from pricewell.schemas import CONTRACT_RESULTS, SPEC_ROWS

# Rows of one file, so that no file of a hot partition grows without a bound.
FILE_ROWS = 5_000_000


def write_partitioned(df: DataFrame, path: str, by: str, file_rows: int = FILE_ROWS) -> None:
    """A parquet table partitioned for lookups by one column.

    Rows are rebalanced by partition before writing: small partitions share a task and get one
    file, and the adaptive optimizer splits a hot one by its size over as many tasks as it needs.
    """
    rebalanced = df.hint("rebalance", F.col(by))
    rebalanced.write.mode("overwrite").option("maxRecordsPerFile", file_rows).partitionBy(by).parquet(path)


def result_id() -> Column:
    """The id of a result, which follows from its search and contract."""
    digest = F.md5(F.concat_ws("/", "search_id", "contract_id"))
    return F.concat_ws("-", *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def result_records(results: DataFrame, raw_data: str = "raw_data_json") -> DataFrame:
    """Results as stored, with all columns of the result table."""
    return results.select(
        result_id().alias("id"),
        "search_id",
        F.col("registry_no").alias("reestr_number"),
        "contract_url",
        "sign_date",
        "unit_price",
        "currency",
        known_match_type(F.col("match_type")).alias("match_type"),
        F.col("ai_score").cast("int").alias("ai_score"),
        F.nullif("target_manufacturer", F.lit("")).alias("manufacturer_target"),
        F.nullif("manufacturer", F.lit("")).alias("manufacturer_found"),
        "manufacturer_match",
        F.col("is_recent").alias("is_2025_plus"),
        F.col("accepted_for_nmc"),
        F.col(raw_data).alias("raw_data_json"),
        F.col("created_date").cast("timestamp").alias("created_at"),
    ).to(T.StructType.fromDDL(CONTRACT_RESULTS.replace(" NOT NULL", "")))


def spec_row_records(rows: DataFrame) -> DataFrame:
    """Comparison rows as stored, with all columns of their table, and the search they belong to."""
    return rows.select(
        "search_id",
        F.md5(F.concat_ws("/", "search_id", "contract_id", "name")).alias("id"),
        result_id().alias("contract_result_id"),
        "name",
        "target_value",
        "actual_value",
        "match_status",
        F.col("weight").cast("int").alias("weight"),
    ).to(T.StructType.fromDDL(f"search_id STRING, {SPEC_ROWS}".replace(" NOT NULL", "")))


def write_results(results: DataFrame, rows: DataFrame, path: str) -> None:
    """The records of results and of their comparison rows, both partitioned by search."""
    write_partitioned(result_records(results), f"{path}/contract_results", "search_id")
    write_partitioned(spec_row_records(rows), f"{path}/spec_comparison_rows", "search_id")


def write_report(sheets: dict[str, DataFrame], path: str, kind: str = "csv") -> None:
    """The report sheets in one format: csv with header, json or parquet."""
    for name, sheet in sheets.items():
        writer = sheet.write.mode("overwrite")
        if kind == "csv":
            writer = writer.option("header", True).option("escape", '"')
        writer.format(kind).save(f"{path}/{name}")
