"""Table schemas and value domains: the one place they are declared."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE = T.DecimalType(15, 2)

# Enum domains of the data model.
SEARCH_STATUSES = ["RUNNING", "DONE", "STOPPED", "ERROR"]
INPUT_SOURCES = ["MANUAL", "FILE"]
MATCH_TYPES = ["IDENTICAL", "HOMOGENEOUS", "NO_MATCH"]
MATCH_STATUSES = ["MATCH", "DIFF", "UNKNOWN"]
EVENT_TYPES = ["progress", "result_added", "done", "error"]

# Text length bounds, number ranges and defaults.
LENGTH_BOUNDS = {
    "requests": {"object_name": 500, "ktru_code": 100, "okpd2_code": 100, "customer_region": 200, "law": 50},
    "results": {
        "reestr_number": 100,
        "contract_url": 500,
        "currency": 10,
        "manufacturer_target": 200,
        "manufacturer_found": 200,
    },
    "spec_rows": {"name": 200},
}
AI_SCORE_RANGE = (0, 100)
WEIGHT_RANGE = (1, 10)
LIMIT_RANGE = (1, 1000)
DEFAULT_LIMIT = 30
DEFAULT_STATUS = "Исполнение завершено"
PRINTED_FORM_YEAR = 2025
SAMPLE_CHARS = 5000
STATE_TTL_SECONDS = 3600


def _ddl(text: str) -> str:
    """A schema as DDL, which readers, ``from_json`` and ``createDataFrame`` all take."""
    return " ".join(text.split())


REQUESTS = _ddl(
    """id STRING NOT NULL, created_at TIMESTAMP NOT NULL, status STRING NOT NULL,
    input_source STRING NOT NULL, object_name STRING NOT NULL, ktru_code STRING NOT NULL,
    okpd2_code STRING, customer_region STRING NOT NULL, law STRING NOT NULL,
    date_from DATE NOT NULL, date_to DATE NOT NULL, execution_statuses ARRAY<STRING> NOT NULL,
    limit_contracts INT NOT NULL, found_total BIGINT, processed_count BIGINT NOT NULL,
    nmc_value DECIMAL(15,2), selected_contract_ids ARRAY<STRING> NOT NULL, runtime_ms BIGINT,
    error_message STRING, debug_data STRING"""
)

CONTRACT_RESULTS = _ddl(
    """id STRING NOT NULL, search_id STRING NOT NULL, reestr_number STRING NOT NULL,
    contract_url STRING NOT NULL, sign_date DATE NOT NULL, unit_price DECIMAL(15,2),
    currency STRING NOT NULL, match_type STRING NOT NULL, ai_score INT NOT NULL,
    manufacturer_target STRING, manufacturer_found STRING, manufacturer_match BOOLEAN,
    is_2025_plus BOOLEAN NOT NULL, accepted_for_nmc BOOLEAN NOT NULL,
    raw_data_json STRING NOT NULL, created_at TIMESTAMP NOT NULL"""
)

SPEC_ROWS = _ddl(
    """id STRING NOT NULL, contract_result_id STRING NOT NULL, name STRING NOT NULL,
    target_value STRING, actual_value STRING, match_status STRING NOT NULL, weight INT NOT NULL"""
)

DOCUMENTS_META = _ddl(
    """id STRING NOT NULL, search_id STRING, contract_result_id STRING, created_at TIMESTAMP,
    filename STRING NOT NULL, filepath STRING NOT NULL, file_type STRING, file_size BIGINT,
    mime_type STRING, source_url STRING"""
)

CARD = _ddl("registry_no STRING, date STRING, price DOUBLE, url STRING, customer STRING, status STRING")

LINE_ITEM = _ddl(
    """item_number STRING, name STRING, okpd2_code STRING, ktru_code STRING, unit STRING,
    quantity DOUBLE, unit_price DOUBLE, total_price DOUBLE, manufacturer STRING,
    country_of_origin STRING, additional_info STRING"""
)

ATTACHMENT = _ddl(
    """name STRING, url STRING, file_type STRING, size BIGINT, description STRING,
    is_printed_form BOOLEAN"""
)

TENDER_ANSWER = _ddl(
    """items ARRAY<STRUCT<name: STRING, parameters: ARRAY<STRUCT<name: STRING, value: STRING, unit: STRING>>,
    quantity: STRING, quality_standards: ARRAY<STRING>, delivery_requirements: STRING, notes: STRING>>"""
)

CONTRACT_ANSWER = _ddl(
    """contract_items ARRAY<STRUCT<item_name: STRING, description: STRING,
    technical_specs: ARRAY<STRUCT<parameter: STRING, requirement: STRING, unit: STRING>>,
    quantity: STRING, unit_of_measurement: STRING, quality_requirements: ARRAY<STRING>,
    delivery_schedule: STRING, price: STRING, currency: STRING, contract_conditions: ARRAY<STRING>>>"""
)

_PARAMETER_MATCH = """STRUCT<parameter: STRING, target_value: STRING, actual_value: STRING, match: BOOLEAN,
    notes: STRING>"""
_COMPARISON_ROW = """STRUCT<name: STRING, target_value: STRING, actual_value: STRING, match_status: STRING,
    weight: INT>"""

# The answer may name its rows in either of two ways; both are read.
COMPARISON_ANSWER = _ddl(
    f"""score INT, match_type STRING,
    details STRUCT<parameter_matches: ARRAY<{_PARAMETER_MATCH}>, quantity_match: BOOLEAN,
    quality_standards_match: BOOLEAN, delivery_match: BOOLEAN>,
    comparisons ARRAY<{_COMPARISON_ROW}>, summary STRING"""
)

EVENT = _ddl(
    """type STRING, search_id STRING, timestamp TIMESTAMP, processed_count INT, found_total INT,
    status STRING, contract_id STRING, reestr_number STRING, unit_price DOUBLE, match_type STRING,
    ai_score INT, manufacturer_match BOOLEAN, total_processed INT, total_found INT, nmc_value DOUBLE,
    selected_count INT, error_message STRING, error_code STRING"""
)
