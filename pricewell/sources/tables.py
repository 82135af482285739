"""The sample tables as procurement data: contracts, requests and specifications."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.functions import compare, scoring
from pricewell.schemas import PRICE

AS_OF_YEAR = 2001
RECENT_YEAR = 2000
PAGE_HOST = "https://contracts.example.org"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """A table scan with at least one task per core.

    Only inputs of few splits are redistributed, by keys that are nearly unique; a large
    table already has more splits than there are cores and is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *keys) if scan.rdd.getNumPartitions() < cores else scan


# Rows of one task that makes or reads a page of each.
TASK_PAGES = 100_000
# Contracts of one task that tells the values of each order apart.
TASK_CONTRACTS = 500_000


def spread_pages(rows: DataFrame, counted: DataFrame, *keys: str) -> DataFrame:
    """Rows of which each becomes a page, in tasks of a bounded number of pages, as many for each core.

    Rows are small beside their pages, so the number of tasks follows from the rows of ``counted``, a table scan of as many.
    """
    return in_bounded_tasks(rows, counted, TASK_PAGES, *keys)


def in_bounded_tasks(rows: DataFrame, counted: DataFrame, most: int, *keys: str) -> DataFrame:
    """Rows by their keys in tasks of about ``most`` rows, as many for each core; ``counted`` is a scan of as many rows."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    rounds = max(1, -(-counted.count() // (most * cores)))
    return rows.repartition(rounds * cores, *keys)


def cents(amount: Column) -> Column:
    """A money amount in double as whole cents."""
    return F.round(amount * 100).cast("bigint")


def as_price(whole_cents: Column) -> Column:
    return (whole_cents / F.lit(100.0)).cast(PRICE)


# Up to so many requests their codes, regions and periods are handed to the scans as values.
PUSHED_REQUESTS = 1_000


def _wanted(wanted: DataFrame) -> dict[str, list]:
    """Codes, regions and the joint period of some requests; nothing if there are too many to list."""
    columns = ["ktru_code", "customer_region", "date_from", "date_to"]
    rows = wanted.select(*columns).limit(PUSHED_REQUESTS + 1).collect()
    if not rows or len(rows) > PUSHED_REQUESTS:
        return {}
    return {column: sorted({r[column] for r in rows if r[column] is not None}) for column in columns}


def contracts(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> DataFrame:
    """One executed contract per order line, with its customer, supplier and item.

    Only the columns a query uses are read: everything here is a projection over joins. Given the
    ``wanted`` requests, the tables are cut by their codes, regions and joint period before they are joined.
    """
    line = spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")
    order = table(spark, sf_dir, "orders")
    part = table(spark, sf_dir, "part")
    customer = table(spark, sf_dir, "customer")
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    if wanted is not None and (values := _wanted(wanted)):
        part = part.where(F.col("p_type").isin(values["ktru_code"]))
        region = region.where(F.col("r_name").isin(values["customer_region"]))
        if values["date_from"] and values["date_to"]:
            # the column is a timestamp, and the last day counts to its end
            end = values["date_to"][-1] + datetime.timedelta(days=1)
            order = order.where((F.col("o_orderdate") >= F.lit(values["date_from"][0])) & (F.col("o_orderdate") < F.lit(end)))
    # the buyer is joined to the orders, so the larger lines are only shuffled for their own keys
    buyer = (
        order.join(customer, order.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
    )
    joined = (
        line.join(part, line.l_partkey == part.p_partkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
        .join(buyer, line.l_orderkey == buyer.o_orderkey)
    )
    quantity = F.col("l_quantity").cast("bigint")
    total = cents(F.col("l_extendedprice"))
    unit = F.expr(
        "(2 * cast(round(l_extendedprice * 100) as bigint) + cast(l_quantity as bigint))"
        " div nullif(2 * cast(l_quantity as bigint), 0)"
    )
    status = (
        F.when(F.col("o_orderstatus") == "F", F.lit("EXECUTION_COMPLETED"))
        .when(F.col("o_orderstatus") == "O", F.lit("EXECUTION_IN_PROGRESS"))
        .otherwise(F.lit("TERMINATED"))
    )
    registry = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return joined.select(
        registry.alias("registry_no"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", quantity, total).alias("contract_id"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.to_date("o_orderdate").alias("sign_date"),
        F.to_date("l_shipdate").alias("created_date"),
        F.col("r_name").alias("region"),
        F.col("p_type").alias("code"),
        F.when(F.col("l_returnflag") == "R", F.lit("fz223")).otherwise(F.lit("fz44")).alias("law"),
        status.alias("execution_status"),
        F.col("p_name").alias("object_name"),
        F.nullif("p_brand", F.lit("Brand#13")).alias("manufacturer"),
        F.col("c_name").alias("customer"),
        F.col("s_name").alias("supplier"),
        quantity.alias("quantity"),
        as_price(total).alias("total_price"),
        as_price(unit).alias("unit_price"),
        F.col("p_size").alias("size_mm"),
        F.col("p_retailprice").alias("retail_price"),
        F.pmod(F.col("l_partkey") * 7 + F.col("l_suppkey") * 13, F.lit(101)).cast("int").alias("ai_score"),
        F.lit("RUB").alias("currency"),
        F.concat(F.lit(f"{PAGE_HOST}/contract/common-info.html?reestrNumber="), registry).alias("contract_url"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One purchase request per catalogue code and customer region."""
    part = table(spark, sf_dir, "part").withColumn("r_regionkey", F.pmod("p_partkey", F.lit(5)).cast("int"))
    wanted = part.groupBy("p_type", "r_regionkey").agg(
        F.min("p_name").alias("object_name"),
        F.max("p_brand").alias("manufacturer"),
        F.min("p_size").alias("size_mm"),
        F.max("p_retailprice").alias("retail_price"),
    )
    key = F.col("r_regionkey")
    statuses = F.when(
        key % 2 == 0, F.array(F.lit("Исполнение завершено"), F.lit("Исполняется"))
    ).otherwise(F.array(F.lit("Исполнение завершено"), F.lit("Расторгнут"), F.lit("Черновик")))
    return wanted.join(table(spark, sf_dir, "region"), "r_regionkey").select(
        F.concat_ws("/", "r_name", "p_type").alias("id"),
        F.date_add(F.lit("2001-06-01").cast("date"), key).alias("created_date"),
        F.lit("RUNNING").alias("status"),
        F.lit("MANUAL").alias("input_source"),
        "object_name",
        F.col("p_type").alias("ktru_code"),
        F.lit(None).cast("string").alias("okpd2_code"),
        F.col("r_name").alias("customer_region"),
        F.when(key == 4, F.lit("223-ФЗ")).otherwise(F.lit("44-ФЗ")).alias("law"),
        F.date_add(F.lit("1996-01-01").cast("date"), key * 90).alias("date_from"),
        F.lit("2000-12-31").cast("date").alias("date_to"),
        statuses.alias("execution_statuses"),
        F.lit(30).alias("limit_contracts"),
        "manufacturer",
        "size_mm",
        "retail_price",
    )


def with_match_attributes(candidates: DataFrame) -> DataFrame:
    """Match type, maker match, recency and selection score of candidate contracts."""
    typed = candidates.withColumns(
        {
            "match_type": scoring.type_of_score(F.col("ai_score")),
            "manufacturer_match": compare.maker_exact(F.col("target_manufacturer"), F.col("manufacturer")),
            "is_recent": F.year("sign_date") >= RECENT_YEAR,
        }
    )
    return typed.withColumn(
        "selection_score",
        scoring.selection_score(
            F.col("match_type"),
            F.col("ai_score"),
            F.col("manufacturer_match"),
            F.year("sign_date"),
            F.col("unit_price"),
            AS_OF_YEAR,
        ),
    )
