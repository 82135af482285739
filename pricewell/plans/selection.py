"""Candidates, selection, scoring and price queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.functions import compare, prices as price_functions, scoring
from pricewell.operators import joins, prices, quantiles, topk
from pricewell.operators.keys import joined_on
from pricewell.operators.matching import key_comparison_rows, makers_alike
from pricewell.plans import ceiling
from pricewell.plans.output import shown
from pricewell.plans.registry import Registry
from pricewell.plans.sql_similarity import similarity_ctes
from pricewell.plans.sql_views import with_views
from pricewell.schemas import LIMIT_RANGE
from pricewell.session import materialized
from pricewell.sources import tables

query = Registry()


def scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.with_match_attributes(ceiling.candidate_contracts(spark, sf_dir))


_CEILING_SQL = """
, ranked AS (
  SELECT search_id, CAST(unit_price AS DOUBLE) AS p, unit_price,
         row_number() OVER (PARTITION BY search_id ORDER BY unit_price) - 1 AS i,
         count(*) OVER (PARTITION BY search_id) AS n FROM {source} WHERE unit_price > 0),
bounds AS (
  SELECT search_id, max(n) AS n, max(CASE WHEN i = n // 4 THEN p END) AS q1,
         max(CASE WHEN i = (3 * n) // 4 THEN p END) AS q3 FROM ranked GROUP BY search_id),
kept AS (
  SELECT r.*, q1, q3 FROM ranked r JOIN bounds b ON r.search_id = b.search_id
  WHERE b.n < 3 OR p BETWEEN q1 - (q3 - q1) * 1.5::DOUBLE AND q3 + (q3 - q1) * 1.5::DOUBLE)
"""

_SELECTED_CEILING = """
SELECT s.search_id, count(*) AS selected_count, count(CASE WHEN s.unit_price > 0 THEN 1 END) AS priced_count,
       max(coalesce(k.kept_count, 0)) AS kept_count, max(k.ceiling) AS ceiling
FROM {source} s LEFT JOIN (
  SELECT search_id, count(*) AS kept_count, CAST(sum(unit_price) AS DOUBLE) / count(*) AS ceiling
  FROM kept GROUP BY search_id) k ON s.search_id = k.search_id
GROUP BY s.search_id
"""


def _ceiling_sql(source: str, *views: str) -> str:
    return with_views(_CEILING_SQL.format(source=source) + _SELECTED_CEILING.format(source=source), *views)


@query(
    "price_ceiling_per_request",
    _ceiling_sql("selected", "selected").replace(
        "SELECT s.search_id, count(*) AS selected_count",
        "SELECT q.id AS search_id, count(s.search_id) AS selected_count",
    ).replace("FROM selected s LEFT JOIN (", "FROM requests q LEFT JOIN selected s ON q.id = s.search_id LEFT JOIN (")
    .replace("GROUP BY s.search_id", "GROUP BY q.id"),
)
def price_ceiling_per_request(spark, sf_dir):
    return shown(ceiling.price_ceiling_per_request(spark, sf_dir))


@query(
    "candidate_contracts",
    with_views(
        """SELECT search_id, contract_id, registry_no, CAST(sign_date AS VARCHAR) AS sign_date, execution_status,
        CAST(unit_price AS DOUBLE) AS unit_price FROM candidates""",
        "candidates",
    ),
)
def candidate_contracts(spark, sf_dir):
    return shown(
        ceiling.candidate_contracts(spark, sf_dir),
        "search_id", "contract_id", "registry_no", "sign_date", "execution_status", "unit_price",
    )


@query(
    "freshest_contracts",
    with_views(
        "SELECT search_id, registry_no, contract_id, CAST(sign_date AS VARCHAR) AS sign_date FROM fresh", "fresh"
    ),
)
def freshest_contracts(spark, sf_dir):
    return shown(ceiling.freshest_contracts(spark, sf_dir), "search_id", "registry_no", "contract_id", "sign_date")


@query(
    "head_limit",
    with_views(
        """SELECT search_id, contract_id FROM candidates QUALIFY row_number() OVER (PARTITION BY search_id
        ORDER BY l_orderkey, l_linenumber, contract_id) <= limit_contracts""",
        "candidates",
    ),
)
def head_limit(spark, sf_dir):
    kept = topk.top_k(
        ceiling.candidate_contracts(spark, sf_dir),
        ["search_id"],
        [F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("contract_id")],
        F.col("limit_contracts"),
        at_most=LIMIT_RANGE[1],
        told_by=["l_orderkey", "l_linenumber"],
    )
    return shown(kept, "search_id", "contract_id")


@query("dedupe_registry", with_views("SELECT search_id, registry_no, contract_id FROM deduped", "deduped"))
def dedupe_registry(spark, sf_dir):
    return shown(ceiling.deduped_contracts(spark, sf_dir), "search_id", "registry_no", "contract_id")


@query(
    "selection_score",
    with_views("SELECT search_id, contract_id, match_type, selection_score FROM scored", "scored"),
)
def selection_score(spark, sf_dir):
    return shown(scored_candidates(spark, sf_dir), "search_id", "contract_id", "match_type", "selection_score")


@query(
    "top_selected",
    with_views("SELECT search_id, contract_id, CAST(selection_score AS DOUBLE) AS selection_score FROM selected", "selected"),
)
def top_selected(spark, sf_dir):
    return shown(ceiling.selected_contracts(spark, sf_dir), "search_id", "contract_id", "selection_score")


@query(
    "score_bands",
    with_views(
        """SELECT ai_score::BIGINT AS ai_score, match_type AS type_of_score,
        CASE WHEN ai_score >= 95 THEN 'Identical' WHEN ai_score >= 75 THEN 'Homogeneous'
             WHEN ai_score >= 40 THEN 'Partial' ELSE 'Mismatch' END AS answer_band,
        count(*) AS contracts FROM scored GROUP BY ALL""",
        "scored",
    ),
)
def score_bands(spark, sf_dir):
    banded = scored_candidates(spark, sf_dir).select(
        "ai_score",
        F.col("match_type").alias("type_of_score"),
        scoring.answer_band(F.col("ai_score")).alias("answer_band"),
    )
    return shown(banded.groupBy(*banded.columns).agg(F.count("*").alias("contracts")))


_ACCEPTED = "match_type IN ('IDENTICAL', 'HOMOGENEOUS') AND coalesce(manufacturer_match, false) AND is_recent"


@query(
    "acceptance",
    with_views(f"SELECT search_id, contract_id FROM scored WHERE {_ACCEPTED}", "scored"),
)
def acceptance(spark, sf_dir):
    return shown(accepted_contracts(spark, sf_dir), "search_id", "contract_id")


def accepted_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = scoring.acceptable(F.col("match_type"), F.col("manufacturer_match"), F.col("is_recent"))
    return scored_candidates(spark, sf_dir).filter(accepted & F.col("unit_price").isNotNull())


@query(
    "cheapest_three_mean",
    with_views(
        f""", cheap AS (SELECT search_id, unit_price FROM scored WHERE {_ACCEPTED} QUALIFY row_number() OVER (
          PARTITION BY search_id ORDER BY unit_price, contract_id) <= 3)
        SELECT id AS search_id, CAST(sum(unit_price) AS DOUBLE) / nullif(count(unit_price), 0) AS ceiling
        FROM requests LEFT JOIN cheap ON id = search_id GROUP BY id""",
        "scored",
    ),
)
def cheapest_three_mean(spark, sf_dir):
    cheap = topk.top_k(
        accepted_contracts(spark, sf_dir),
        ["search_id"],
        [F.asc("unit_price"), F.asc("contract_id")],
        3,
        told_by=["l_orderkey", "l_linenumber"],
    )
    means = cheap.groupBy("search_id").agg(prices.mean_price(F.col("unit_price")).alias("ceiling"))
    searches = tables.requests(spark, sf_dir).select(F.col("id").alias("search_id"))
    return shown(searches.join(means, "search_id", "left"))


@query(
    "selected_mean",
    with_views(
        """, best AS (SELECT search_id, unit_price FROM candidates QUALIFY row_number() OVER (
          PARTITION BY search_id ORDER BY ai_score DESC, contract_id) <= 3)
        SELECT id AS search_id, coalesce(CAST(sum(unit_price) AS DOUBLE) / nullif(count(unit_price), 0), 0)
          AS mean_price FROM requests LEFT JOIN best ON id = search_id GROUP BY id""",
        "candidates",
    ),
)
def selected_mean(spark, sf_dir):
    """Mean over the default user selection, the three best-scored contracts."""
    best = topk.top_k(
        ceiling.candidate_contracts(spark, sf_dir),
        ["search_id"],
        [F.desc("ai_score"), F.asc("contract_id")],
        3,
        told_by=["l_orderkey", "l_linenumber"],
    )
    means = best.groupBy("search_id").agg(prices.mean_price(F.col("unit_price")).alias("mean_price"))
    searches = tables.requests(spark, sf_dir).select(F.col("id").alias("search_id"))
    return shown(searches.join(means, "search_id", "left").fillna(0.0, ["mean_price"]))


_K12 = """, selected12 AS (SELECT * FROM scored_fresh QUALIFY row_number() OVER (
  PARTITION BY search_id ORDER BY selection_score DESC, contract_id) <= 12)"""


@query(
    "iqr_outliers_k12",
    with_views(
        _K12 + _CEILING_SQL.format(source="selected12") + _SELECTED_CEILING.format(source="selected12"), "scored_fresh"
    ),
)
def iqr_outliers_k12(spark, sf_dir):
    return shown(prices.small_group_ceiling(ceiling.selected_contracts(spark, sf_dir, 12), ["search_id"]))


@query(
    "iqr_all_candidates",
    with_views(
        _CEILING_SQL.format(source="candidates")
        + """SELECT search_id, max(n) AS prices, max(q1) AS q1, max(q3) AS q3, count(*) AS kept,
          CAST(sum(unit_price) AS DOUBLE) / count(*) AS mean_price FROM kept GROUP BY search_id""",
        "candidates",
    ),
)
def iqr_all_candidates(spark, sf_dir):
    """Outlier-free mean over every candidate, before any selection."""
    positions = prices.price_positions(ceiling.candidate_contracts(spark, sf_dir), ["search_id"], "unit_price")
    return shown(prices.cleaned_mean(positions, ["search_id"]))


@query(
    "iqr_by_sketch",
    with_views(
        _CEILING_SQL.format(source="candidates")
        + """SELECT search_id, max(n) AS prices, max(q1) AS q1, max(q3) AS q3, count(*) AS kept,
          CAST(sum(unit_price) AS DOUBLE) / count(*) AS mean_price FROM kept GROUP BY search_id""",
        "candidates",
    ),
)
def iqr_by_sketch(spark, sf_dir):
    """The same mean, the quartiles found by sketches and counts instead of sorting the prices."""
    rows = ceiling.candidate_contracts(spark, sf_dir).where("unit_price > 0").select("search_id", "unit_price")
    rows = materialized(rows.withColumn("cents", (F.col("unit_price") * 100).cast("bigint")), "prices")
    ranks = {"low": lambda n: F.floor(n / 4), "high": lambda n: F.floor(n * 3 / 4)}
    found = quantiles.values_at(rows, ["search_id"], "cents", ranks, picked=100)
    quartiles = [(F.col(c) / F.lit(100.0)).alias(q) for c, q in (("low", "q1"), ("high", "q3"))]
    return shown(prices.mean_within(rows, found.select("search_id", F.col("n").alias("prices"), *quartiles), ["search_id"]))


@query(
    "ceiling_after_cleaning",
    with_views(
        _CEILING_SQL.format(source="candidates").replace(
            "kept AS (\n  SELECT r.*, q1, q3 FROM ranked r",
            "kept AS (\n  SELECT r.* FROM scored r",
        ).replace("OR p BETWEEN", "OR CAST(unit_price AS DOUBLE) BETWEEN")
        + """, best AS (SELECT search_id, unit_price FROM kept QUALIFY row_number() OVER (
          PARTITION BY search_id ORDER BY selection_score DESC, contract_id) <= 3)
        SELECT search_id, count(*) AS selected_count, CAST(sum(unit_price) AS DOUBLE) / count(*) AS ceiling
        FROM best GROUP BY search_id""",
        "scored",
    ),
)
def ceiling_after_cleaning(spark, sf_dir):
    """Ceiling of the best three among the candidates left after outlier removal."""
    clean = prices.without_outliers(scored_candidates(spark, sf_dir), ["search_id"])
    best = topk.top_k(
        clean, ["search_id"], [F.desc("selection_score"), F.asc("contract_id")], 3, told_by=["l_orderkey", "l_linenumber"]
    )
    return shown(
        best.groupBy("search_id").agg(
            F.count("*").alias("selected_count"), prices.mean_price(F.col("unit_price")).alias("ceiling")
        )
    )


@query(
    "median_trimmed",
    with_views(
        """, ranked AS (SELECT search_id, unit_price, CAST(unit_price AS DOUBLE) AS p,
          row_number() OVER (PARTITION BY search_id ORDER BY unit_price) - 1 AS i,
          count(*) OVER (PARTITION BY search_id) AS n FROM candidates WHERE unit_price > 0)
        SELECT search_id, max(n) AS prices,
          (max(CASE WHEN i = (n - 1) // 2 THEN p END) + max(CASE WHEN i = n // 2 THEN p END)) / 2.0 AS median_price,
          count(CASE WHEN i >= n * 10 // 100 AND i < n - n * 10 // 100 THEN 1 END) AS used,
          CAST(sum(CASE WHEN i >= n * 10 // 100 AND i < n - n * 10 // 100 THEN unit_price END) AS DOUBLE)
            / count(CASE WHEN i >= n * 10 // 100 AND i < n - n * 10 // 100 THEN 1 END) AS trimmed_mean
        FROM ranked GROUP BY search_id""",
        "candidates",
    ),
)
def median_trimmed(spark, sf_dir):
    positions = prices.price_positions(ceiling.candidate_contracts(spark, sf_dir), ["search_id"], "unit_price")
    middle = prices.median_price(positions, ["search_id"])
    return shown(middle.join(prices.trimmed_mean(positions, ["search_id"]), "search_id"))


_CODES = "CASE WHEN l_linenumber % 3 = 0 THEN [object_name] ELSE [code, object_name] END"


def with_codes(df: DataFrame) -> DataFrame:
    """Contracts with the list of codes their items name; some name no catalogue code."""
    listed = F.when(F.col("l_linenumber") % 3 == 0, F.array("object_name")).otherwise(F.array("code", "object_name"))
    return df.withColumn("codes", listed)


@query(
    "fallback_score",
    with_views(
        f""", hits AS (SELECT search_id, contract_id, list_contains({_CODES}, code) AS code_match,
          coalesce(contains(lower(manufacturer), lower(target_manufacturer)), false) AS maker_match FROM candidates),
        points AS (SELECT *, least(100, 50 + CASE WHEN code_match THEN 30 ELSE 0 END
          + CASE WHEN maker_match THEN 20 ELSE 0 END) AS score FROM hits)
        SELECT search_id, contract_id, score::BIGINT AS score,
          CASE WHEN score >= 80 THEN 'IDENTICAL' ELSE 'HOMOGENEOUS' END AS match_type FROM points""",
        "candidates",
    ),
)
def fallback_score(spark, sf_dir):
    scored = with_codes(ceiling.candidate_contracts(spark, sf_dir)).withColumn(
        "score",
        scoring.fallback_score(
            F.array_contains("codes", F.col("code")),
            compare.maker_contains(F.col("target_manufacturer"), F.col("manufacturer")),
        ),
    )
    return shown(
        scored.withColumn("match_type", scoring.fallback_type(F.col("score"))),
        "search_id", "contract_id", "score", "match_type",
    )


@query(
    "code_membership",
    with_views(
        f"""SELECT search_id, contract_id FROM candidates WHERE list_contains({_CODES}, code)""", "candidates"
    ),
)
def code_membership(spark, sf_dir):
    rows = with_codes(ceiling.candidate_contracts(spark, sf_dir))
    return shown(rows.filter(F.array_contains("codes", F.col("code"))), "search_id", "contract_id")


@query(
    "key_rows",
    with_views(
        ", "
        + similarity_ctes(
            "SELECT DISTINCT lower(target_name) AS a, lower(object_name) AS b FROM scored_fresh"
            " UNION SELECT DISTINCT lower(target_manufacturer), lower(manufacturer) FROM scored_fresh"
            " WHERE manufacturer IS NOT NULL"
        ).strip()
        + f""", facts AS (SELECT f.*, list_contains({_CODES}, code) AS code_hit,
            coalesce(m.best > 0.7, false) AS maker_hit, n.best > 0.8 AS name_hit
          FROM scored_fresh f JOIN sim n ON lower(target_name) = n.a AND lower(object_name) = n.b
          LEFT JOIN sim m ON lower(target_manufacturer) = m.a AND lower(manufacturer) = m.b),
        parts AS (
          SELECT search_id, contract_id, 'KTRU Code' AS name, code AS target_value, ({_CODES})[1] AS actual_value,
                 code_hit AS hit, 2 AS weight FROM facts
          UNION ALL SELECT search_id, contract_id, 'Manufacturer', target_manufacturer, manufacturer, maker_hit, 1
          FROM facts
          UNION ALL SELECT search_id, contract_id, 'Object Name', target_name, object_name, name_hit, 1 FROM facts)
        SELECT search_id, contract_id, name, target_value, actual_value,
          CASE WHEN hit THEN 'MATCH' ELSE 'DIFF' END AS match_status, weight::BIGINT AS weight FROM parts
        WHERE coalesce(target_value, actual_value) IS NOT NULL""",
        "scored_fresh",
    ),
)
def key_rows(spark, sf_dir):
    return shown(key_rows_of(spark, sf_dir))


# What the key rows and the ranks of scored contracts are made from.
KEY_FIELDS = ["code", "object_name", "l_linenumber", "target_name", "limit_contracts", "selection_score"]


def key_rows_of(spark: SparkSession, sf_dir: str, scored: DataFrame | None = None) -> DataFrame:
    """The three key rows of every fresh contract; a maker counts if it is alike to the wanted one.

    ``scored`` are the scored fresh contracts if the caller has them, with ``KEY_FIELDS`` and the makers.
    """
    fresh = ceiling.scored_contracts(spark, sf_dir) if scored is None else scored
    coded = with_codes(fresh).withColumn("code_match", F.array_contains("codes", F.col("code")))
    rows = makers_alike(coded, "target_manufacturer", F.array("manufacturer"), "maker_match")
    return key_comparison_rows(
        rows, ["search_id", "contract_id"], "code", F.get("codes", F.lit(0)), "code_match", "maker_match"
    )


@query(
    "final_status",
    with_views(
        """, runs AS (SELECT id, count(contract_id) AS processed, CASE WHEN max(r.customer_region) = 'ASIA'
            THEN 'Search page unavailable' END AS given
          FROM requests r LEFT JOIN (SELECT * FROM candidates WHERE execution_status = 'TERMINATED') c
            ON r.id = c.search_id GROUP BY id)
        SELECT id AS search_id, processed,
          CASE WHEN given IS NOT NULL OR processed = 0 THEN 'ERROR' ELSE 'DONE' END AS status,
          coalesce(given, CASE WHEN processed = 0 THEN 'No contracts were processed' END) AS error_message
        FROM runs""",
        "candidates",
    ),
)
def final_status(spark, sf_dir):
    """Status of searches that only process terminated contracts, one region being down."""
    processed = (
        ceiling.candidate_contracts(spark, sf_dir)
        .filter(F.col("execution_status") == "TERMINATED")
        .groupBy("search_id")
        .agg(F.count("*").alias("processed"))
    )
    searches = tables.requests(spark, sf_dir).select(
        F.col("id").alias("search_id"),
        F.when(F.col("customer_region") == "ASIA", F.lit("Search page unavailable")).alias("given"),
    )
    joined = searches.join(processed, "search_id", "left").fillna(0, ["processed"])
    return shown(
        joined.select(
            "search_id",
            "processed",
            scoring.final_status(F.col("given"), F.col("processed")).alias("status"),
            scoring.final_error(F.col("given"), F.col("processed")).alias("error_message"),
        )
    )


@query(
    "unit_price_fallback",
    with_views(
        """SELECT contract_id, CASE WHEN l_linenumber % 4 <> 0 THEN CAST(unit_price AS DOUBLE)
            WHEN l_suppkey % 3 <> 0 THEN CAST(total_price AS DOUBLE) / quantity END AS unit_price FROM contracts""",
        "contracts",
    ),
)
def unit_price_fallback(spark, sf_dir):
    """Unit prices where some contracts give no item price (zero) and some no quantity."""
    rows = tables.contracts(spark, sf_dir)
    item_price = F.when(F.col("l_linenumber") % 4 == 0, F.lit(0.0)).otherwise(F.col("unit_price").cast("double"))
    item_quantity = F.when(F.col("l_suppkey") % 3 != 0, F.col("quantity"))
    price = price_functions.unit_price(item_price, F.col("total_price").cast("double"), item_quantity)
    return shown(rows.select("contract_id", price.alias("unit_price")))


@query(
    "mark_selected",
    with_views(
        """SELECT f.search_id, f.contract_id, CAST(s.contract_id IS NOT NULL AS VARCHAR) AS accepted_for_nmc
        FROM scored_fresh f LEFT JOIN selected s ON f.search_id = s.search_id AND f.contract_id = s.contract_id""",
        "selected",
    ),
)
def mark_selected(spark, sf_dir):
    results = result_rows(spark, sf_dir)
    return shown(results, "search_id", "contract_id", "accepted_for_nmc")


def result_rows(spark: SparkSession, sf_dir: str, scored: DataFrame | None = None) -> DataFrame:
    """Scored fresh contracts, given or not, with the three selected ones of each search marked."""
    ranked = topk.top_k(
        ceiling.scored_contracts(spark, sf_dir) if scored is None else scored,
        ["search_id"],
        [F.desc("selection_score"), F.asc("contract_id")],
        F.col("limit_contracts"),
        at_most=LIMIT_RANGE[1],
        rank="selection_rank",
        salted=False,
    )
    return ranked.withColumn("accepted_for_nmc", F.col("selection_rank") <= ceiling.SELECTED_PER_REQUEST)


_ODD_REQUESTS = """SELECT * REPLACE (
    CASE WHEN length(object_name) % 3 = 0 THEN NULL WHEN length(object_name) % 7 = 0 THEN 1001 ELSE limit_contracts END
      AS limit_contracts,
    CASE WHEN length(object_name) % 5 = 0 THEN DATE '1990-01-01' ELSE date_to END AS date_to,
    CASE WHEN length(ktru_code) % 4 = 0 THEN NULL ELSE execution_statuses END AS execution_statuses) FROM requests"""


def odd_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of which some give no limit or status, and some a wrong limit or period."""
    n = F.length("object_name")
    return tables.requests(spark, sf_dir).withColumns(
        {
            "limit_contracts": F.when(n % 3 == 0, F.lit(None).cast("int")).when(n % 7 == 0, 1001).otherwise(F.col("limit_contracts")),
            "date_to": F.when(n % 5 == 0, F.lit("1990-01-01").cast("date")).otherwise(F.col("date_to")),
            "execution_statuses": F.when(F.length("ktru_code") % 4 != 0, F.col("execution_statuses")),
        }
    )


@query(
    "request_rejects",
    with_views(
        f""", odd AS ({_ODD_REQUESTS}), told AS (SELECT id, concat_ws(', ',
          CASE WHEN date_to < date_from THEN 'date_to is before date_from' END,
          CASE WHEN coalesce(limit_contracts, 30) > 1000 THEN 'limit_contracts is not in 1 to 1000' END) AS faults FROM odd)
        SELECT id, faults FROM told WHERE faults <> ''""",
        "requests",
    ),
)
def request_rejects(spark, sf_dir):
    """Requests that may not run, with what is wrong."""
    rejected = joins.rejected_requests(odd_requests(spark, sf_dir))
    return shown(rejected.select("id", F.array_join("faults", ", ").alias("faults")))


@query(
    "request_defaults",
    with_views(
        f""", odd AS ({_ODD_REQUESTS})
        SELECT id, coalesce(limit_contracts, 30)::BIGINT AS limit_contracts,
          array_to_string(coalesce(execution_statuses, ['Исполнение завершено']), ', ') AS execution_statuses
        FROM odd WHERE date_to >= date_from AND coalesce(limit_contracts, 30) <= 1000""",
        "requests",
    ),
)
def request_defaults(spark, sf_dir):
    """Requests that may run, with the default limit and status where none was given."""
    valid = joins.valid_requests(odd_requests(spark, sf_dir))
    statuses = F.array_join("execution_statuses", ", ").alias("execution_statuses")
    return shown(valid.select("id", "limit_contracts", statuses))


@query(
    "prices_with_gaps",
    with_views(
        """, given AS (SELECT CASE WHEN region <> 'ASIA' THEN code END AS code, region,
          CASE WHEN l_linenumber < 5 AND region <> 'AFRICA' THEN unit_price END AS p FROM contracts),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY code, region ORDER BY p) - 1 AS i,
          count(*) OVER (PARTITION BY code, region) AS n FROM given WHERE p > 0),
        middle AS (SELECT code, region, max(n) AS n,
          (max(CASE WHEN i = (n - 1) // 2 THEN p END)::DOUBLE + max(CASE WHEN i = n // 2 THEN p END)::DOUBLE) / 2 AS m,
          CAST(sum(CASE WHEN i >= n // 10 AND i < n - n // 10 THEN p END) AS DOUBLE)
            / count(CASE WHEN i >= n // 10 AND i < n - n // 10 THEN 1 END) AS t FROM ranked GROUP BY ALL)
        SELECT g.code, g.region, coalesce(n, 0) AS prices, m AS median_price, t AS trimmed_mean
        FROM (SELECT DISTINCT code, region FROM given) g
        LEFT JOIN middle k ON g.code IS NOT DISTINCT FROM k.code AND g.region = k.region""",
        "contracts",
    ),
)
def prices_with_gaps(spark, sf_dir):
    """Medians and trimmed means by code and region, where one region has no prices and one no codes."""
    rows = tables.contracts(spark, sf_dir).select(
        F.when(F.col("region") != "ASIA", F.col("code")).alias("code"),
        "region",
        F.when((F.col("l_linenumber") < 5) & (F.col("region") != "AFRICA"), F.col("unit_price")).alias("unit_price"),
    )
    positions = prices.price_positions(rows, ["code", "region"], "unit_price")
    middle, trimmed = prices.median_price(positions, ["code", "region"]), prices.trimmed_mean(positions, ["code", "region"])
    return shown(joined_on(middle, trimmed.drop("used"), ["code", "region"]))


@query(
    "numbered_undated",
    with_views(
        """, undated AS (SELECT code, contract_id, CASE WHEN l_linenumber % 3 <> 0 THEN created_date END AS created_date FROM contracts)
        SELECT contract_id, row_number() OVER (PARTITION BY code ORDER BY created_date DESC NULLS LAST, contract_id) AS seq
        FROM undated""",
        "contracts",
    ),
)
def numbered_undated(spark, sf_dir):
    """Contracts numbered newest first by code, those without a date last."""
    rows = tables.contracts(spark, sf_dir).select(
        "code", "contract_id", F.when(F.col("l_linenumber") % 3 != 0, F.col("created_date")).alias("created_date")
    )
    order = [F.desc("created_date"), F.asc("contract_id")]
    return shown(topk.numbered(rows, ["code"], [(F.col("created_date"), True)], order, "seq"), "contract_id", "seq")
