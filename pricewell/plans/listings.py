"""Result pages, filters, reports, integrity and quality queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.operators import joins, prices, quality, reports, topk
from pricewell.plans import ceiling
from pricewell.plans.output import shown
from pricewell.plans.registry import Registry
from pricewell.plans.selection import query as selection_query
from pricewell.plans.selection import KEY_FIELDS, key_rows_of, result_rows, scored_candidates
from pricewell.plans.sql_views import add_view, with_views
from pricewell.schemas import LENGTH_BOUNDS, LIMIT_RANGE, MATCH_TYPES, PRICE
from pricewell.session import materialized, scratch_dir
from pricewell.sources import paged, tables

query = Registry()


RESULT_FIELDS = [
    "contract_id", "search_id", "registry_no", "contract_url", "sign_date", "unit_price", "currency", "match_type",
    "ai_score", "target_manufacturer", "manufacturer", "manufacturer_match", "is_recent", "accepted_for_nmc",
    "created_date",
]


def newest() -> list:
    return [F.desc("created_date"), F.asc("contract_id")]


def all_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scored candidate, the three selected ones of each search marked.

    The candidates are stored first, so that selecting and everything read from the
    results later starts from that table.
    """
    return results_and_fresh(spark, sf_dir, [])[0]


def results_and_fresh(spark: SparkSession, sf_dir: str, more: list[str] = KEY_FIELDS) -> tuple[DataFrame, DataFrame]:
    """Every scored candidate with the selected ones marked, and the fresh ones, both from one pass over the contracts.

    ``more`` names what the candidates carry beside the fields of a result.
    """
    wanted = [c for c in RESULT_FIELDS if c != "accepted_for_nmc"] + ["limit_contracts", "selection_score"]
    carried = wanted + [c for c in more if c not in wanted]
    stored = materialized(scored_candidates(spark, sf_dir).select(*carried), "scored")
    fresh = materialized(ceiling.freshest(stored), "fresh")
    chosen = materialized(ceiling.best(fresh).select("search_id", "contract_id"), "selected")
    return joins.with_selected_flag(stored.select(*wanted), chosen, ["search_id", "contract_id"]), fresh


add_view(
    "results",
    """SELECT c.*, s.contract_id IS NOT NULL AS accepted_for_nmc FROM scored c LEFT JOIN
    (SELECT search_id, contract_id FROM selected) s ON c.search_id = s.search_id AND c.contract_id = s.contract_id""",
    ["scored", "selected"],
)

# ---------------------------------------------------------------- pages and filters



@query(
    "results_page",
    with_views(
        """SELECT contract_id, search_id, registry_no, contract_url, CAST(sign_date AS VARCHAR) AS sign_date,
          CAST(unit_price AS DOUBLE) AS unit_price, currency, match_type, ai_score::BIGINT AS ai_score,
          target_manufacturer, manufacturer, CAST(manufacturer_match AS VARCHAR) AS manufacturer_match,
          CAST(is_recent AS VARCHAR) AS is_recent, CAST(accepted_for_nmc AS VARCHAR) AS accepted_for_nmc,
          CAST(created_date AS VARCHAR) AS created_date, position, 2::BIGINT AS page, total
        FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY created_date DESC, contract_id) AS position,
          count(*) OVER (PARTITION BY search_id) AS total FROM results) WHERE position BETWEEN 101 AND 200""",
        "results",
    ),
)
def results_page(spark, sf_dir):
    """The second page of a hundred results of every search."""
    results = all_results(spark, sf_dir)
    paged = topk.page(results, ["search_id"], newest(), skip=100, limit=100)
    counted = topk.with_group_total(paged, results, ["search_id"])
    return shown(counted, *RESULT_FIELDS, "position", "page", "total")


@query(
    "history_page",
    with_views(
        """SELECT id, status, CAST(created_date AS VARCHAR) AS created_date, object_name, ktru_code, law,
          customer_region, array_to_string(execution_statuses, ', ') AS execution_statuses,
          limit_contracts::BIGINT AS limit_contracts, (SELECT count(*) FROM requests) AS total, 2::BIGINT AS page
        FROM requests ORDER BY created_date DESC, id LIMIT 10 OFFSET 10""",
        "requests",
    ),
)
def history_page(spark, sf_dir):
    """Searches 11 to 20, newest first, with the total as the listing shows it."""
    searches = tables.requests(spark, sf_dir)
    listed = searches.orderBy(F.desc("created_date"), "id").offset(10).limit(10)
    return shown(
        listed.select(
            "id", "status", "created_date", "object_name", "ktru_code", "law", "customer_region",
            F.array_join("execution_statuses", ", ").alias("execution_statuses"), "limit_contracts",
            searches.agg(F.count(F.lit(1))).scalar().alias("total"), F.lit(10 // 10 + 1).alias("page"),
        )
    )


ORDERS_NEWEST = [("o_orderdate", True), ("o_orderkey", False)]
DEEP_SKIP, DEEP_LIMIT = 5_000, 50


@query(
    "deep_pages",
    f"""SELECT o_orderkey, CAST(o_orderdate::DATE AS VARCHAR) AS day, position, total,
        CASE WHEN position < {DEEP_SKIP + DEEP_LIMIT} THEN 'by number' ELSE 'behind a row' END AS found
      FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS position, count(*) OVER () AS total FROM orders)
      WHERE position BETWEEN {DEEP_SKIP} AND {DEEP_SKIP + 2 * DEEP_LIMIT - 1}""",
)
def deep_pages(spark, sf_dir):
    """A page far down the orders, newest first, by its number, and the page behind its last row."""
    out = scratch_dir(spark, "paged")
    orders = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    paged.write(orders, out, ORDERS_NEWEST, file_rows=2_000)
    first = paged.page(spark, out, DEEP_SKIP, DEEP_LIMIT)
    parts = [first.withColumn("found", F.lit("by number"))]
    last = first.orderBy(F.desc("position")).first()
    if last is not None:
        after = paged.page_behind(spark, out, ORDERS_NEWEST, last.asDict(), DEEP_LIMIT)
        parts.append(after.withColumn("found", F.lit("behind a row")))
    both = reduce(DataFrame.union, parts).withColumn("total", F.lit(paged.total(spark, out)).cast("bigint"))
    return both.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "position", "total", "found")


def filtered_results(results: DataFrame, id_part: str = "", match_type: str = "", min_score: int = 0) -> DataFrame:
    """Results whose id contains a text, of one type or any, with at least a score."""
    kept = results.filter(F.contains("registry_no", F.lit(id_part)) & (F.col("ai_score") >= min_score))
    return kept.filter(F.col("match_type") == match_type) if match_type else kept


@query(
    "results_filter",
    with_views(
        """SELECT search_id, contract_id, match_type, ai_score::BIGINT AS ai_score FROM results
        WHERE contains(registry_no, '27') AND match_type = 'HOMOGENEOUS' AND ai_score >= 75""",
        "results",
    ),
)
def results_filter(spark, sf_dir):
    kept = filtered_results(all_results(spark, sf_dir), "27", "HOMOGENEOUS", 75)
    return shown(kept, "search_id", "contract_id", "match_type", "ai_score")


@query(
    "contracts_of_search",
    with_views(
        """SELECT contract_id, ai_score::BIGINT AS ai_score FROM scored
        WHERE search_id = 'EUROPE/PROMO' AND ai_score >= 60""",
        "scored",
    ),
)
def contracts_of_search(spark, sf_dir):
    """Results of one search above a score; its code, region and period reach the scans as values."""
    rows = tables.with_match_attributes(ceiling.candidates_of(spark, sf_dir, "EUROPE/PROMO"))
    return shown(filtered_results(rows, min_score=60), "contract_id", "ai_score")


def filtered_history(requests: DataFrame, name: str = "", status: str = "", date: str = "") -> DataFrame:
    """Searches whose name contains a text, of one status or any, of one day or any."""
    kept = requests.filter(F.contains(F.lower("object_name"), F.lower(F.lit(name))))
    kept = kept.filter(F.col("status") == status) if status else kept
    return kept.filter(F.col("created_date") == F.lit(date).cast("date")) if date else kept


@query(
    "history_filter",
    with_views(
        """SELECT id, object_name, CAST(created_date AS VARCHAR) AS created_date FROM requests
        WHERE contains(lower(object_name), 'e b') AND status = 'RUNNING'""",
        "requests",
    ),
)
def history_filter(spark, sf_dir):
    kept = filtered_history(tables.requests(spark, sf_dir), "E B", "RUNNING")
    return shown(kept, "id", "object_name", "created_date")


@query(
    "page_bounds",
    with_views(
        """, counted AS (SELECT search_id, count(*) AS total FROM scored WHERE match_type = 'IDENTICAL' GROUP BY ALL),
        paged AS (SELECT id AS search_id, coalesce(total, 0) AS total, CAST(ceil(coalesce(total, 0) / 10.0) AS BIGINT)
          AS pages FROM requests LEFT JOIN counted ON id = search_id),
        bounded AS (SELECT *, greatest(1, CASE WHEN pages > 0 THEN least(7, pages) ELSE 7 END)::BIGINT AS page
          FROM paged)
        SELECT *, CASE WHEN total > 0 THEN (page - 1) * 10 + 1 ELSE 0 END AS row_from,
          least(page * 10, total) AS row_to FROM bounded""",
        "scored",
    ),
)
def page_bounds(spark, sf_dir):
    """Page 7 of the identical contracts of each search, clamped to the pages there are."""
    identical = scored_candidates(spark, sf_dir).filter(F.col("match_type") == "IDENTICAL")
    counted = identical.groupBy("search_id").agg(F.count("*").alias("total"))
    searches = tables.requests(spark, sf_dir).select(F.col("id").alias("search_id"))
    totals = searches.join(counted, "search_id", "left").fillna(0, ["total"])
    bounds = topk.page_bounds(F.col("total"), F.lit(7), 10)
    return shown(totals.select("search_id", "total", *[col.alias(name) for name, col in bounds.items()]))


@query(
    "display_order",
    with_views(
        """SELECT search_id, contract_id, row_number() OVER (PARTITION BY search_id
          ORDER BY selected DESC, ai_score DESC, contract_id) AS position
        FROM (SELECT f.*, s.contract_id IS NOT NULL AS selected FROM scored_fresh f LEFT JOIN selected s
          ON f.search_id = s.search_id AND f.contract_id = s.contract_id)""",
        "selected",
    ),
)
def display_order(spark, sf_dir):
    """Selected contracts first, then by score; at most the search limit per search."""
    ordered = topk.top_k(
        result_rows(spark, sf_dir),
        ["search_id"],
        [F.desc("accepted_for_nmc"), F.desc("ai_score"), F.asc("contract_id")],
        F.col("limit_contracts"),
        at_most=LIMIT_RANGE[1],
        rank="position",
        salted=False,
    )
    return shown(ordered, "search_id", "contract_id", "position")


# ---------------------------------------------------------------- reports


def request_snapshot(spark: SparkSession, sf_dir: str, results: DataFrame) -> DataFrame:
    """Requests with the final values of the run that gave the results."""
    searches = tables.requests(spark, sf_dir).withColumn("created_at", F.col("created_date").cast("timestamp"))
    found = results.groupBy("search_id").agg(F.count("*").alias("found_total"))
    processed = ceiling.freshest(results).groupBy("search_id").agg(F.count("*").alias("processed_count"))
    selected = results.filter("accepted_for_nmc")
    chosen = prices.small_group_ceiling(selected, ["search_id"]).join(
        selected.groupBy("search_id").agg(F.sort_array(F.collect_list("contract_id")).alias("selected_contract_ids")),
        "search_id",
    )
    # every search that ran is finished, also one that found nothing
    ran = joins.valid_requests(searches).select(F.col("id").alias("search_id"))
    joined = ran.join(found, "search_id", "left").join(processed, "search_id", "left").join(chosen, "search_id", "left")
    finals = joined.select(
        F.col("search_id").alias("id"),
        F.coalesce("found_total", F.lit(0)).alias("found_total"),
        F.coalesce("processed_count", F.lit(0)).alias("processed_count"),
        F.col("ceiling").cast(PRICE).alias("nmc_value"),
        F.coalesce("selected_contract_ids", F.array().cast("array<string>")).alias("selected_contract_ids"),
        F.lit(None).cast("bigint").alias("runtime_ms"),
        F.lit(None).cast("string").alias("error_message"),
    )
    return reports.with_final_values(searches, finals, F.lit("2001-09-01").cast("timestamp"))


add_view(
    "finals",
    """SELECT q.*, coalesce(found_total, 0) AS found_total, coalesce(processed_count, 0) AS processed_count,
      coalesce(ids, []) AS ids, nmc FROM requests q
    LEFT JOIN (SELECT search_id, count(*) AS found_total FROM candidates GROUP BY ALL) a ON q.id = a.search_id
    LEFT JOIN (SELECT search_id, count(*) AS processed_count FROM fresh GROUP BY ALL) b ON q.id = b.search_id
    LEFT JOIN (SELECT search_id, CAST(sum(unit_price) AS DOUBLE) / count(*) AS nmc,
      list(contract_id ORDER BY contract_id) AS ids FROM selected GROUP BY ALL) c ON q.id = c.search_id""",
    ["candidates", "fresh", "selected"],
)


@query(
    "request_detail",
    with_views(
        """SELECT id, CASE WHEN processed_count = 0 THEN 'ERROR' ELSE 'DONE' END AS status, object_name, ktru_code, okpd2_code, customer_region, law, CAST(date_from AS VARCHAR) AS date_from,
          CAST(date_to AS VARCHAR) AS date_to, limit_contracts::BIGINT AS limit_contracts, input_source, found_total,
          processed_count, CAST(round(nmc * 100) AS BIGINT) / 100.0 AS nmc_value,
          array_to_string(ids, ', ') AS selected_contract_ids,
          CASE WHEN processed_count = 0 THEN 'No contracts were processed' END AS error_message,
          '2001-09-01 00:00:00.000000' AS updated_at FROM finals""",
        "finals",
    ),
)
def request_detail(spark, sf_dir):
    """The request snapshot after the run."""
    return shown_snapshot(request_snapshot(spark, sf_dir, all_results(spark, sf_dir)))


@query(
    "request_detail_rare",
    with_views(
        """, rare AS (SELECT * FROM results WHERE accepted_for_nmc AND ai_score >= 97),
        counted AS (SELECT search_id, count(*) AS n, (2 * CAST(sum(unit_price) * 100 AS BIGINT) + count(*)) // (2 * count(*))
          AS cents, list(contract_id ORDER BY contract_id) AS ids FROM rare GROUP BY ALL)
        SELECT id, CASE WHEN n IS NULL THEN 'ERROR' ELSE 'DONE' END AS status, object_name, ktru_code, okpd2_code,
          customer_region, law, CAST(date_from AS VARCHAR) AS date_from, CAST(date_to AS VARCHAR) AS date_to,
          limit_contracts::BIGINT AS limit_contracts, input_source, coalesce(n, 0) AS found_total,
          coalesce(n, 0) AS processed_count, cents / 100.0 AS nmc_value,
          array_to_string(coalesce(ids, []), ', ') AS selected_contract_ids,
          CASE WHEN n IS NULL THEN 'No contracts were processed' END AS error_message,
          '2001-09-01 00:00:00.000000' AS updated_at FROM requests LEFT JOIN counted ON id = search_id""",
        "results",
    ),
)
def request_detail_rare(spark, sf_dir):
    """The same where only the best scores count, so that some searches end without a contract."""
    rare = all_results(spark, sf_dir).where("accepted_for_nmc AND ai_score >= 97")
    return shown_snapshot(request_snapshot(spark, sf_dir, rare))


def shown_snapshot(snapshot: DataFrame) -> DataFrame:
    return shown(
        snapshot.select(
            "id", "status", "object_name", "ktru_code", "okpd2_code", "customer_region", "law", "date_from", "date_to",
            "limit_contracts", "input_source", "found_total", "processed_count", "nmc_value",
            F.array_join("selected_contract_ids", ", ").alias("selected_contract_ids"), "error_message", "updated_at",
        )
    )


_SUMMARY_VALUES = [
    "f.id", "strftime(created_date, '%d.%m.%Y') || ' 00:00'", "'DONE'", "object_name", "ktru_code", "'Не указан'",
    "customer_region", "law", "strftime(date_from, '%d.%m.%Y')", "strftime(date_to, '%d.%m.%Y')",
    "array_to_string(execution_statuses, ', ')", "limit_contracts::VARCHAR", "input_source", "found_total::VARCHAR",
    "processed_count::VARCHAR", "total::VARCHAR", "accepted::VARCHAR", "identical::VARCHAR", "homogeneous::VARCHAR",
    "no_match::VARCHAR", "format('{:,.2f}', CAST(round(nmc * 100) AS BIGINT) / 100.0) || ' RUB'", "'Не измерено'",
]
_SUMMARY_STRUCTS = ", ".join(
    f"{{'row_no': {i}::BIGINT, 'label': '{label}', 'value': {value}}}"
    for i, (label, value) in enumerate(zip(reports.PARAMETER_LABELS + reports.RESULT_LABELS, _SUMMARY_VALUES), start=1)
)


@query(
    "report_summary",
    with_views(
        f""", counts AS (SELECT search_id, count(*) AS total, count(CASE WHEN accepted_for_nmc THEN 1 END) AS accepted,
          count(CASE WHEN match_type = 'IDENTICAL' THEN 1 END) AS identical,
          count(CASE WHEN match_type = 'HOMOGENEOUS' THEN 1 END) AS homogeneous,
          count(CASE WHEN match_type = 'NO_MATCH' THEN 1 END) AS no_match FROM results GROUP BY ALL)
        SELECT id AS search_id, unnest([{_SUMMARY_STRUCTS}], recursive := true)
        FROM finals f JOIN counts c ON f.id = c.search_id""",
        "finals",
        "results",
    ),
)
def report_summary(spark, sf_dir):
    results = all_results(spark, sf_dir)
    counts = reports.result_counts(results)
    return shown(reports.summary_rows(request_snapshot(spark, sf_dir, results), counts))


@query(
    "report_detail",
    with_views(
        """SELECT search_id, row_number() OVER (PARTITION BY search_id ORDER BY created_date DESC, contract_id) AS seq,
          registry_no, strftime(sign_date, '%d.%m.%Y') AS signed, match_type,
          format('{:,.2f}', unit_price::DOUBLE) AS unit_price, currency, ai_score::BIGINT AS ai_score,
          target_manufacturer AS manufacturer_target, coalesce(manufacturer, '') AS manufacturer_found,
          CASE WHEN manufacturer_match THEN 'Да' WHEN NOT manufacturer_match THEN 'Нет' ELSE 'Не указано' END
            AS manufacturer_match,
          CASE WHEN is_recent THEN 'Да' ELSE 'Нет' END AS is_recent,
          CASE WHEN accepted_for_nmc THEN 'Да' ELSE 'Нет' END AS accepted_for_nmc, contract_url FROM results""",
        "results",
    ),
)
def report_detail(spark, sf_dir):
    return shown(reports.detail_rows(all_results(spark, sf_dir)))


_KEY_ROWS_SQL = selection_query.sql["key_rows"].strip()


@query(
    "report_comparison",
    f"""WITH key_rows AS ({_KEY_ROWS_SQL}), """
    + with_views(
        """SELECT k.search_id, k.contract_id, 'Контракт: ' || registry_no || ' - ' || match_type AS contract_header,
          name, coalesce(target_value, '') AS target_value, coalesce(actual_value, '') AS actual_value,
          match_status, weight
        FROM key_rows k JOIN selected s ON k.search_id = s.search_id AND k.contract_id = s.contract_id""",
        "selected",
    ).removeprefix("WITH "),
)
def report_comparison(spark, sf_dir):
    rows = key_rows_of(spark, sf_dir)
    return shown(reports.comparison_rows(result_rows(spark, sf_dir), rows, ["search_id", "contract_id"]))


@query(
    "accepted_with_rows",
    with_views(
        """SELECT search_id, contract_id FROM selected WHERE manufacturer IS NOT NULL""",
        "selected",
    ),
)
def accepted_with_rows(spark, sf_dir):
    """Selected contracts that have a comparison row for a found maker; the others are skipped."""
    results = result_rows(spark, sf_dir).filter("accepted_for_nmc")
    rows = key_rows_of(spark, sf_dir).filter((F.col("name") == "Manufacturer") & F.col("actual_value").isNotNull())
    return shown(joins.with_rows_only(results, rows, ["search_id", "contract_id"]), "search_id", "contract_id")


@query(
    "comparison_summary",
    f"""SELECT search_id, contract_id, count(*) AS total_rows,
      count(CASE WHEN match_status = 'MATCH' THEN 1 END) AS matched_rows,
      count(CASE WHEN match_status = 'DIFF' THEN 1 END) AS different_rows,
      count(CASE WHEN match_status = 'MATCH' THEN 1 END) / count(*) * 100.0 AS match_percentage
    FROM ({_KEY_ROWS_SQL}) GROUP BY ALL""",
)
def comparison_summary(spark, sf_dir):
    status = F.col("match_status")
    return shown(
        key_rows_of(spark, sf_dir)
        .groupBy("search_id", "contract_id")
        .agg(
            F.count("*").alias("total_rows"),
            F.count_if(status == "MATCH").alias("matched_rows"),
            F.count_if(status == "DIFF").alias("different_rows"),
            (F.count_if(status == "MATCH") / F.count("*") * F.lit(100.0)).alias("match_percentage"),
        )
    )


@query(
    "history_prices",
    with_views(
        """SELECT id, found_total, nmc AS average_price FROM finals""",
        "finals",
    ),
)
def history_prices(spark, sf_dir):
    """Number found and mean price of the selected contracts per search."""
    found = ceiling.candidate_contracts(spark, sf_dir).groupBy("search_id").agg(F.count("*").alias("found_total"))
    means = ceiling.selected_contracts(spark, sf_dir).groupBy("search_id").agg(
        prices.mean_price(F.col("unit_price")).alias("average_price")
    )
    searches = tables.requests(spark, sf_dir).select("id", F.col("id").alias("search_id"))
    joined = searches.join(found, "search_id", "left").join(means, "search_id", "left")
    return shown(joined, "id", "found_total", "average_price")


# ---------------------------------------------------------------- integrity


@query(
    "orphans",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey FROM lineitem
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')""",
)
def orphans(spark, sf_dir):
    """Lines whose order is not among the finished and open ones."""
    line = tables.table(spark, sf_dir, "lineitem")
    kept = tables.table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != "P")
    lost = joins.orphans(line, kept.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    return shown(lost, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "cascade_delete",
    """SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey IN
    (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY'))
    GROUP BY ALL""",
)
def cascade_delete(spark, sf_dir):
    """Lines left once the customers of a segment, and with them their orders, are deleted."""
    customer = tables.table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") != "MACHINERY")
    order = joins.cascade_delete(
        tables.table(spark, sf_dir, "orders"), customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey"
    )
    line = joins.cascade_delete(
        tables.table(spark, sf_dir, "lineitem"), order.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey"
    )
    return line.groupBy("l_orderkey").agg(F.count("*").alias("lines"))


@query(
    "distinct_code_lists",
    with_views(
        """SELECT l_orderkey, kind, value FROM (SELECT l_orderkey, unnest([
          {'kind': 'code', 'value': code}, {'kind': 'manufacturer', 'value': manufacturer},
          {'kind': 'unit', 'value': CASE WHEN l_linenumber % 2 = 0 THEN 'шт' END}], recursive := true) FROM contracts)
        WHERE value IS NOT NULL GROUP BY ALL""",
        "contracts",
    ),
)
def distinct_code_lists(spark, sf_dir):
    """Distinct codes, makers and units of each order, one row per value, so no list can grow too long.

    An order's contracts are in one task, of a bounded number of contracts, which bounds what it tells apart.
    """
    kinds = F.array(
        F.struct(F.lit("code").alias("kind"), F.col("code").alias("value")),
        F.struct(F.lit("manufacturer").alias("kind"), F.col("manufacturer").alias("value")),
        F.struct(F.lit("unit").alias("kind"), F.when(F.col("l_linenumber") % 2 == 0, F.lit("шт")).alias("value")),
    )
    narrow = tables.contracts(spark, sf_dir).select("l_orderkey", "code", "manufacturer", "l_linenumber")
    line = tables.table(spark, sf_dir, "lineitem")
    parted = tables.in_bounded_tasks(narrow, line, tables.TASK_CONTRACTS, "l_orderkey")
    listed = parted.select("l_orderkey", F.inline(kinds))
    return listed.filter(F.col("value").isNotNull()).distinct()


# ---------------------------------------------------------------- quality

def _rule_counts(rules: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, count(CASE WHEN {broken} THEN 1 END) AS violations FROM {source}"
        for rule, broken in rules.items()
    )


_Q = {
    "results.ai_score out of range": "NOT score BETWEEN 0 AND 100",
    "results.match_type unknown": "mtype NOT IN ('IDENTICAL', 'HOMOGENEOUS', 'NO_MATCH')",
    "results.reestr_number too long": "length(reestr_number) > 100",
    "results.contract_url too long": "length(contract_url) > 500",
    "results.currency too long": "length(currency) > 10",
    "results.manufacturer_target too long": "length(manufacturer_target) > 200",
    "results.manufacturer_found too long": "length(manufacturer_found) > 200",
    "results.manufacturer_found missing": "manufacturer_found IS NULL",
    "results.unit_price missing": "unit_price IS NULL",
    "spec_rows.weight out of range": "NOT weight BETWEEN 1 AND 10",
    "requests.period reversed": "date_to < date_from",
    "requests.limit_contracts out of range": "NOT limit_contracts BETWEEN 1 AND 1000",
}


@query(
    "quality_violations",
    with_views(
        """, dirty AS (SELECT l_orderkey % 997 AS search_id, (l_partkey + l_suppkey) % 104 - 1 AS score,
            CASE WHEN l_linenumber = 7 THEN 'Partial' ELSE 'IDENTICAL' END AS mtype,
            repeat(registry_no, (1 + quantity // 5)::BIGINT) AS reestr_number, contract_url, currency,
            repeat(supplier, (1 + l_linenumber * 2)::BIGINT) AS manufacturer_target, manufacturer AS manufacturer_found,
            CASE WHEN quantity < 3 THEN NULL ELSE unit_price END AS unit_price, l_linenumber * 2 AS weight,
            sign_date AS date_from, created_date AS date_to, (quantity - 1) * 25 AS limit_contracts,
            registry_no, l_suppkey FROM contracts)
        """
        + _rule_counts(_Q, "dirty")
        + """ UNION ALL SELECT 'results.search and number repeated', count(*) FROM
            (SELECT 1 FROM dirty GROUP BY search_id, registry_no HAVING count(*) > 1)
          UNION ALL SELECT 'results.supplier unknown', count(*) FROM dirty
            WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""",
        "contracts",
    ),
)
def quality_violations(spark, sf_dir):
    """All constraints over contract rows that are dirty by rule."""
    rows = tables.contracts(spark, sf_dir)
    dirty = rows.select(
        F.pmod("l_orderkey", F.lit(997)).alias("search_id"),
        (F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.lit(104)) - 1).alias("ai_score"),
        F.when(F.col("l_linenumber") == 7, F.lit("Partial")).otherwise(F.lit("IDENTICAL")).alias("match_type"),
        F.repeat("registry_no", F.expr("cast(1 + quantity div 5 as int)")).alias("reestr_number"),
        "contract_url",
        "currency",
        F.repeat("supplier", F.expr("cast(1 + l_linenumber * 2 as int)")).alias("manufacturer_target"),
        F.col("manufacturer").alias("manufacturer_found"),
        F.when(F.col("quantity") >= 3, F.col("unit_price")).alias("unit_price"),
        (F.col("l_linenumber") * 2).alias("weight"),
        F.col("sign_date").alias("date_from"),
        F.col("created_date").alias("date_to"),
        ((F.col("quantity") - 1) * 25).alias("limit_contracts"),
        "registry_no",
        "l_suppkey",
    )
    rules = {
        "results.ai_score out of range": quality.score_rule(F.col("ai_score")),
        "results.match_type unknown": quality.domain_rule(F.col("match_type"), MATCH_TYPES),
        **quality.length_rules("results", LENGTH_BOUNDS["results"]),
        **quality.required_rules("results", ["manufacturer_found", "unit_price"]),
        "spec_rows.weight out of range": quality.weight_rule(F.col("weight")),
        "requests.period reversed": quality.period_rule(F.col("date_from"), F.col("date_to")),
        "requests.limit_contracts out of range": quality.limit_rule(F.col("limit_contracts")),
    }
    known = tables.table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    flagged = quality.with_parent_flag(dirty, known, "l_suppkey", "has_supplier")
    rules["results.supplier unknown"] = ~F.col("has_supplier")
    return shown(
        quality.violations_with_repeats(
            flagged, rules, ["search_id", "registry_no"], "results.search and number repeated"
        )
    )


_DIRTY_REQUESTS = """SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'PAUSED' WHEN o_orderkey % 3 = 0 THEN 'RUNNING'
    ELSE 'DONE' END AS status, CASE WHEN o_orderkey % 40 = 0 THEN 'EMAIL' ELSE 'FILE' END AS input_source,
  CASE WHEN o_orderkey % 30 <> 0 THEN repeat(o_orderpriority, (1 + o_orderkey % 60)::BIGINT) END AS object_name,
  o_orderkey::VARCHAR AS ktru_code, repeat('7', (o_orderkey % 120)::BIGINT) AS okpd2_code, 'ASIA' AS customer_region,
  o_orderpriority AS law, o_orderdate::DATE AS date_from, DATE '2000-06-01' AS date_to,
  (o_orderkey % 1100)::BIGINT AS limit_contracts FROM orders"""
_REQUEST_RULES = {
    "requests.status unknown": "status NOT IN ('RUNNING', 'DONE', 'STOPPED', 'ERROR')",
    "requests.input_source unknown": "input_source NOT IN ('MANUAL', 'FILE')",
    "requests.period reversed": "date_to < date_from",
    "requests.limit_contracts out of range": "NOT limit_contracts BETWEEN 1 AND 1000",
    "requests.object_name too long": "length(object_name) > 500",
    "requests.ktru_code too long": "length(ktru_code) > 100",
    "requests.okpd2_code too long": "length(okpd2_code) > 100",
    "requests.customer_region too long": "length(customer_region) > 200",
    "requests.law too long": "length(law) > 50",
    **{f"requests.{name} missing": f"{name} IS NULL" for name in quality.REQUIRED["requests"]},
}


def dirty_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per order, dirty by rule."""
    key = F.col("o_orderkey")
    status = F.when(key % 50 == 0, F.lit("PAUSED")).when(key % 3 == 0, F.lit("RUNNING")).otherwise(F.lit("DONE"))
    return tables.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        status.alias("status"),
        F.when(key % 40 == 0, F.lit("EMAIL")).otherwise(F.lit("FILE")).alias("input_source"),
        F.when(key % 30 != 0, F.repeat("o_orderpriority", (1 + key % 60).cast("int"))).alias("object_name"),
        key.cast("string").alias("ktru_code"),
        F.repeat(F.lit("7"), (key % 120).cast("int")).alias("okpd2_code"),
        F.lit("ASIA").alias("customer_region"),
        F.col("o_orderpriority").alias("law"),
        F.to_date("o_orderdate").alias("date_from"),
        F.lit("2000-06-01").cast("date").alias("date_to"),
        F.array(F.col("o_orderpriority")).alias("execution_statuses"),
        (key % 1100).cast("int").alias("limit_contracts"),
    )


@query(
    "request_violations",
    f"WITH dirty AS (SELECT *, 1 AS execution_statuses FROM ({_DIRTY_REQUESTS})) "
    + _rule_counts(_REQUEST_RULES, "dirty"),
)
def request_violations(spark, sf_dir):
    """All constraints of the request table, in one pass."""
    return shown(quality.violations(dirty_requests(spark, sf_dir), quality.request_rules()))


_RESULT_RULES = {
    "results.ai_score out of range": "NOT ai_score BETWEEN 0 AND 100",
    "results.match_type unknown": "match_type NOT IN ('IDENTICAL', 'HOMOGENEOUS', 'NO_MATCH')",
    **{f"results.{name} too long": f"length({name}) > {most}" for name, most in LENGTH_BOUNDS["results"].items()},
    **{f"results.{name} missing": f"{name} IS NULL" for name in quality.REQUIRED["results"]},
}
_SPEC_ROW_RULES = {
    "spec_rows.match_status unknown": "match_status NOT IN ('MATCH', 'DIFF', 'UNKNOWN')",
    "spec_rows.weight out of range": "NOT weight BETWEEN 1 AND 10",
    "spec_rows.name too long": "length(name) > 200",
    **{f"spec_rows.{name} missing": f"{name} IS NULL" for name in quality.REQUIRED["spec_rows"]},
}


@query(
    "run_violations",
    f"""WITH key_rows AS (SELECT *, contract_id AS contract_result_id FROM ({_KEY_ROWS_SQL})), """
    + with_views(
        f""", named AS (SELECT *, registry_no AS reestr_number, target_manufacturer AS manufacturer_target,
          manufacturer AS manufacturer_found FROM results)
        {_rule_counts(_RESULT_RULES, "named")} UNION ALL {_rule_counts(_SPEC_ROW_RULES, "key_rows")}""",
        "results",
    ).removeprefix("WITH "),
)
def run_violations(spark, sf_dir):
    """What the pipeline itself writes breaks no rule."""
    results, fresh = results_and_fresh(spark, sf_dir)
    results = results.withColumnsRenamed(
        {"registry_no": "reestr_number", "target_manufacturer": "manufacturer_target", "manufacturer": "manufacturer_found"}
    )
    rows = key_rows_of(spark, sf_dir, fresh).withColumnRenamed("contract_id", "contract_result_id")
    checked = quality.violations(results, quality.result_rules())
    return checked.unionByName(quality.violations(rows, quality.spec_row_rules()))


@query(
    "state_guards",
    f"""SELECT CASE status WHEN 'RUNNING' THEN 'may be stopped' ELSE 'has a report' END AS allowed, count(*) AS searches
    FROM ({_DIRTY_REQUESTS}) WHERE status IN ('RUNNING', 'DONE') GROUP BY ALL""",
)
def state_guards(spark, sf_dir):
    """Searches that may be stopped and searches that have a report."""
    searches = dirty_requests(spark, sf_dir)
    allowed = joins.stoppable(searches).select(F.lit("may be stopped").alias("allowed"))
    allowed = allowed.unionAll(joins.reportable(searches).select(F.lit("has a report").alias("allowed")))
    return allowed.groupBy("allowed").agg(F.count("*").alias("searches"))
