"""The sample views in plain SQL, shared by the SQL twins of the queries."""

from __future__ import annotations

from pricewell.sources.tables import AS_OF_YEAR, PAGE_HOST, RECENT_YEAR

VIEWS: dict[str, str] = {}

VIEWS["contracts"] = f"""
SELECT concat_ws('-', l_orderkey, l_linenumber) AS registry_no,
       concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, qty, total_cents) AS contract_id,
       l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CAST(o_orderdate AS DATE) AS sign_date, CAST(l_shipdate AS DATE) AS created_date,
       r_name AS region, p_type AS code,
       CASE WHEN l_returnflag = 'R' THEN 'fz223' ELSE 'fz44' END AS law,
       CASE o_orderstatus WHEN 'F' THEN 'EXECUTION_COMPLETED' WHEN 'O' THEN 'EXECUTION_IN_PROGRESS'
            ELSE 'TERMINATED' END AS execution_status,
       p_name AS object_name, nullif(p_brand, 'Brand#13') AS manufacturer,
       c_name AS customer, s_name AS supplier, qty AS quantity,
       CAST(total_cents / 100.0 AS DECIMAL(15,2)) AS total_price,
       CAST(((2 * total_cents + qty) // nullif(2 * qty, 0)) / 100.0 AS DECIMAL(15,2)) AS unit_price,
       p_size AS size_mm, p_retailprice AS retail_price,
       CAST((l_partkey * 7 + l_suppkey * 13) % 101 AS INTEGER) AS ai_score,
       'RUB' AS currency,
       '{PAGE_HOST}/contract/common-info.html?reestrNumber=' || concat_ws('-', l_orderkey, l_linenumber)
         AS contract_url
FROM (SELECT *, CAST(l_quantity AS BIGINT) AS qty,
             CAST(round(l_extendedprice * 100) AS BIGINT) AS total_cents FROM lineitem)
JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

VIEWS["requests"] = """
SELECT concat_ws('/', r_name, p_type) AS id, DATE '2001-06-01' + r_regionkey AS created_date,
       'RUNNING' AS status, 'MANUAL' AS input_source, object_name, p_type AS ktru_code,
       CAST(NULL AS VARCHAR) AS okpd2_code, r_name AS customer_region,
       CASE WHEN r_regionkey = 4 THEN '223-ФЗ' ELSE '44-ФЗ' END AS law,
       DATE '1996-01-01' + r_regionkey * 90 AS date_from, DATE '2000-12-31' AS date_to,
       CASE WHEN r_regionkey % 2 = 0 THEN ['Исполнение завершено', 'Исполняется']
            ELSE ['Исполнение завершено', 'Расторгнут', 'Черновик'] END AS execution_statuses,
       30 AS limit_contracts, manufacturer, size_mm, retail_price
FROM (SELECT p_type, CAST(p_partkey % 5 AS INTEGER) AS rk, min(p_name) AS object_name,
             max(p_brand) AS manufacturer, min(p_size) AS size_mm, max(p_retailprice) AS retail_price
      FROM part GROUP BY ALL) JOIN region ON rk = r_regionkey
"""

VIEWS["candidates"] = """
SELECT c.*, q.id AS search_id, q.limit_contracts, q.object_name AS target_name,
       q.manufacturer AS target_manufacturer, q.size_mm AS target_size_mm, q.retail_price AS target_retail_price
FROM contracts c JOIN requests q ON c.code = q.ktru_code AND c.region = q.customer_region
 AND c.law = CASE q.law WHEN '223-ФЗ' THEN 'fz223' WHEN '94-ФЗ' THEN 'fz94' ELSE 'fz44' END
 AND c.sign_date BETWEEN q.date_from AND q.date_to
 AND list_contains(q.execution_statuses, CASE c.execution_status
   WHEN 'EXECUTION_COMPLETED' THEN 'Исполнение завершено'
   WHEN 'EXECUTION_IN_PROGRESS' THEN 'Исполняется' ELSE 'Расторгнут' END)
"""

VIEWS["deduped"] = """
SELECT * FROM candidates
QUALIFY row_number() OVER (PARTITION BY search_id, registry_no ORDER BY contract_id) = 1
"""

VIEWS["fresh"] = """
SELECT * FROM deduped QUALIFY row_number() OVER (
  PARTITION BY search_id ORDER BY sign_date DESC, registry_no DESC) <= limit_contracts
"""

_SCORED = f"""
SELECT *, 10.0::DOUBLE * CASE match_type WHEN 'IDENTICAL' THEN 3 WHEN 'HOMOGENEOUS' THEN 2 ELSE 1 END
       + ai_score * 0.5::DOUBLE + CASE WHEN manufacturer_match THEN 10 ELSE 0 END
       + CASE WHEN year(sign_date) >= {AS_OF_YEAR} - 1 THEN 10
              WHEN year(sign_date) >= {AS_OF_YEAR} - 3 THEN 5 ELSE 0 END
       + CASE WHEN unit_price IS NOT NULL THEN 5 ELSE 0 END AS selection_score
FROM (SELECT *, CASE WHEN ai_score >= 90 THEN 'IDENTICAL' WHEN ai_score >= 70 THEN 'HOMOGENEOUS'
                     ELSE 'NO_MATCH' END AS match_type,
             lower(target_manufacturer) = lower(manufacturer) AS manufacturer_match,
             year(sign_date) >= {RECENT_YEAR} AS is_recent
      FROM %s)
"""
VIEWS["scored_fresh"] = _SCORED % "fresh"
VIEWS["scored"] = _SCORED % "candidates"

VIEWS["selected"] = """
SELECT * FROM scored_fresh QUALIFY row_number() OVER (
  PARTITION BY search_id ORDER BY selection_score DESC, contract_id) <= 3
"""

_NEEDS = {
    "contracts": [],
    "requests": [],
    "candidates": ["contracts", "requests"],
    "deduped": ["candidates"],
    "fresh": ["deduped"],
    "scored_fresh": ["fresh"],
    "scored": ["candidates"],
    "selected": ["scored_fresh"],
}


def add_view(name: str, text: str, needs: list[str]) -> None:
    VIEWS[name] = text
    _NEEDS[name] = needs


def with_views(body: str, *names: str) -> str:
    """A query over the named views, with everything they build on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS[name]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    head = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in ordered)
    return f"WITH {head}\n{body.strip()}"
