"""Prompt, answer, token and document queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.functions import json_text
from pricewell.operators import answers
from pricewell.operators.dedupe import distinct_texts
from pricewell.plans import ceiling
from pricewell.plans.characteristics import with_spec_maps
from pricewell.plans.output import shown
from pricewell.plans.registry import Registry
from pricewell.plans.sql_views import with_views
from pricewell.schemas import COMPARISON_ANSWER, CONTRACT_ANSWER, TENDER_ANSWER
from pricewell.sources import tables

query = Registry()

# ---------------------------------------------------------------- prompts


@query(
    "extraction_prompts",
    """SELECT doc_id, md5('Extract technical specifications from the following text:' || chr(10) || chr(10) || text)
      AS prompt_md5, length(text) + 59 AS prompt_chars FROM documents""",
)
def extraction_prompts(spark, sf_dir):
    """Extraction prompts over whole document texts."""
    prompt = answers.extraction_prompt(F.col("text"))
    documents = tables.table(spark, sf_dir, "documents").select("doc_id", prompt.alias("prompt"))
    return shown(
        documents.select(
            "doc_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("prompt_chars")
        )
    )


def _target_json() -> Column:
    return answers.indented_object(
        {"object_name": F.col("target_name"), "ktru_code": F.col("code"), "manufacturer": F.col("target_manufacturer")}
    )


def _actual_json() -> Column:
    return answers.indented_object(
        {"object_name": F.col("object_name"), "quantity": F.col("quantity"), "manufacturer": F.col("manufacturer")}
    )


_JSON_TEXT = """'{' || chr(10) || '  "object_name": "' || %s || '",' || chr(10) || %s || chr(10)
  || '  "manufacturer": ' || coalesce('"' || %s || '"', 'null') || chr(10) || '}'"""


@query(
    "prompt_table",
    with_views(
        "SELECT search_id, contract_id, 'Compare the following target specifications with actual specifications:' "
        "|| chr(10) || chr(10) || 'Target Specifications:' || chr(10) || "
        + _JSON_TEXT % ("target_name", """'  "ktru_code": "' || code || '",'""", "target_manufacturer")
        + " || chr(10) || chr(10) || 'Actual Specifications:' || chr(10) || "
        + _JSON_TEXT % ("object_name", """'  "quantity": ' || quantity || ','""", "manufacturer")
        + " || chr(10) || chr(10) || 'Calculate a match score from 0-100 and determine the match type.' AS prompt"
        " FROM candidates",
        "candidates",
    ),
)
def prompt_table(spark, sf_dir):
    rows = ceiling.candidate_contracts(spark, sf_dir)
    prompt = answers.comparison_prompt(_target_json(), _actual_json())
    return rows.select("search_id", "contract_id", prompt.alias("prompt"))


def nested_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A specification with nested values for each part; some have no values, limits or attributes."""
    key = F.col("p_partkey")
    limits = F.when(key % 3 != 0, F.struct((F.col("p_size") - 1).alias("min"), (F.col("p_size") + 1).alias("max")))
    size = F.struct(F.lit("размер").alias("name"), F.array(F.col("p_size").cast("string"), F.lit('20"')).alias("values"), limits.alias("limits"))
    price = F.struct(F.lit("цена\\руб").alias("name"), F.array().cast("array<string>").alias("values"), F.lit(None).cast("struct<min:int,max:int>").alias("limits"))
    specs = F.when(key % 5 == 0, F.array().cast("array<struct<name:string,values:array<string>,limits:struct<min:int,max:int>>>"))
    attributes = F.when(key % 4 == 0, F.create_map().cast("map<string,double>")).otherwise(F.create_map(F.col("p_brand"), F.col("p_retailprice")))
    spec = F.struct(
        F.col("p_name").alias("object_name"),
        specs.otherwise(F.array(size, price)).alias("specs"),
        attributes.alias("attributes"),
        (key % 2 == 0).alias("checked"),
    )
    part = tables.table(spark, sf_dir, "part")
    return tables.spread_pages(part, part, "p_partkey").select("p_partkey", spec.alias("spec"))


@query(
    "nested_prompts",
    """WITH s AS (SELECT p_partkey, json_object('object_name', p_name, 'specs',
        CASE WHEN p_partkey % 5 = 0 THEN json_array() ELSE json_array(
          json_object('name', 'размер', 'values', json_array(p_size::VARCHAR, '20"'), 'limits',
            CASE WHEN p_partkey % 3 <> 0 THEN json_object('min', p_size - 1, 'max', p_size + 1) END),
          json_object('name', 'цена\\руб', 'values', json_array(), 'limits', NULL)) END,
        'attributes', CASE WHEN p_partkey % 4 = 0 THEN json_object() ELSE json_object(p_brand, p_retailprice) END,
        'checked', p_partkey % 2 = 0) AS j FROM part)
    SELECT p_partkey, replace(json_pretty(j), '    ', '  ') AS prompt FROM s""",
)
def nested_prompts(spark, sf_dir):
    """Specifications with nested values as indented JSON."""
    rows = nested_specs(spark, sf_dir)
    return shown(rows.select("p_partkey", json_text.indented(F.col("spec"), rows.schema["spec"].dataType).alias("prompt")))


# ---------------------------------------------------------------- answers


def tender_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tender answer per part; every 17th text is cut off in the middle."""
    part = tables.table(spark, sf_dir, "part")
    parameter = lambda name, value, unit: F.struct(
        F.lit(name).alias("name"), value.cast("string").alias("value"), F.lit(unit).alias("unit")
    )
    item = F.struct(
        F.col("p_name").alias("name"),
        F.array(
            parameter("размер", F.col("p_size"), "мм"), parameter("цена", F.col("p_retailprice"), "руб")
        ).alias("parameters"),
        F.lit("1").alias("quantity"),
    )
    raw = F.to_json(F.struct(F.array(item).alias("items")))
    cut = F.when(F.col("p_partkey") % 17 == 0, F.substring(raw, 1, 30)).otherwise(raw)
    return part.select("p_partkey", "p_size", cut.alias("raw"))


@query(
    "answer_parse",
    """SELECT p_partkey, CAST(p_partkey % 17 <> 0 AS VARCHAR) AS is_valid,
      CASE WHEN p_partkey % 17 <> 0 THEN p_name END AS first_item FROM part""",
)
def answer_parse(spark, sf_dir):
    parsed = answers.parsed_answers(tender_answers(spark, sf_dir), "raw", TENDER_ANSWER)
    first = F.when(F.col("is_valid"), F.get(F.col("answer.items"), F.lit(0))["name"])
    return shown(parsed.select("p_partkey", "is_valid", first.alias("first_item")))


@query(
    "answer_rejects",
    "SELECT p_partkey FROM part WHERE p_partkey % 17 = 0",
)
def answer_rejects(spark, sf_dir):
    parsed = answers.parsed_answers(tender_answers(spark, sf_dir), "raw", TENDER_ANSWER)
    return answers.rejected(parsed).select("p_partkey")


@query(
    "tender_parameters",
    """SELECT p_partkey, 0::BIGINT AS item_no, p_name AS item_name, '1' AS quantity, unnest([
      {'name': 'размер', 'value': p_size::VARCHAR, 'unit': 'мм'},
      {'name': 'цена', 'value': p_retailprice::VARCHAR, 'unit': 'руб'}], recursive := true)
    FROM part WHERE p_partkey % 17 <> 0""",
)
def tender_parameters(spark, sf_dir):
    parsed = answers.parsed_answers(tender_answers(spark, sf_dir), "raw", TENDER_ANSWER)
    return shown(answers.tender_parameters(parsed, ["p_partkey"]))


@query(
    "contract_specs",
    """SELECT p_partkey, 0::BIGINT AS item_no, p_name AS item_name, p_retailprice::VARCHAR AS price,
      CASE WHEN p_partkey % 4 <> 0 THEN 'размер' END AS parameter,
      CASE WHEN p_partkey % 4 <> 0 THEN p_size::VARCHAR END AS requirement,
      CASE WHEN p_partkey % 4 <> 0 THEN 'мм' END AS unit FROM part""",
)
def contract_specs(spark, sf_dir):
    """Contract answers, a quarter of whose items name no specification."""
    spec = F.struct(
        F.lit("размер").alias("parameter"), F.col("p_size").cast("string").alias("requirement"),
        F.lit("мм").alias("unit"),
    )
    none = F.array().cast("array<struct<parameter: string, requirement: string, unit: string>>")
    item = F.struct(
        F.col("p_name").alias("item_name"),
        F.when(F.col("p_partkey") % 4 == 0, none).otherwise(F.array(spec)).alias("technical_specs"),
        F.col("p_retailprice").alias("price"),
    )
    raw = F.to_json(F.struct(F.array(item).alias("contract_items")))
    given = tables.table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    return shown(answers.contract_specs(answers.parsed_answers(given, "raw", CONTRACT_ANSWER), ["p_partkey"]))


def comparison_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison answers per candidate, in either of the two shapes models use."""
    rows = with_spec_maps(ceiling.candidate_contracts(spark, sf_dir))
    match = F.lower("target_name") == F.lower("object_name")
    detailed = F.to_json(
        F.struct(
            F.col("ai_score").alias("score"),
            F.lit("Homogeneous").alias("match_type"),
            F.struct(
                F.array(
                    F.struct(
                        F.lit("наименование").alias("parameter"), F.col("target_name").alias("target_value"),
                        F.col("object_name").alias("actual_value"), match.alias("match"),
                    )
                ).alias("parameter_matches")
            ).alias("details"),
        )
    )
    flat = F.to_json(
        F.struct(
            F.col("ai_score").alias("score"),
            F.lit("HOMOGENEOUS").alias("match_type"),
            F.array(F.struct(F.lit("код").alias("name"), F.col("code").alias("target_value"))).alias("comparisons"),
        )
    )
    raw = F.when(F.col("l_linenumber") % 2 == 0, detailed).otherwise(flat)
    return rows.select("search_id", "contract_id", raw.alias("raw"))


@query(
    "answer_flatten",
    with_views(
        """SELECT search_id, contract_id, 'наименование' AS name, target_name AS target_value, object_name AS actual_value,
          CASE WHEN lower(target_name) = lower(object_name) THEN 'MATCH' ELSE 'DIFF' END AS match_status,
          1::BIGINT AS weight FROM candidates WHERE l_linenumber % 2 = 0
        UNION ALL SELECT search_id, contract_id, 'код', code, NULL, 'UNKNOWN', 1 FROM candidates
          WHERE l_linenumber % 2 = 1""",
        "candidates",
    ),
)
def answer_flatten(spark, sf_dir):
    parsed = answers.parsed_answers(comparison_answers(spark, sf_dir), "raw", COMPARISON_ANSWER)
    return shown(answers.compared_parameters(parsed, ["search_id", "contract_id"]))


@query(
    "answer_defaults",
    """SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, 'NO_MATCH' AS match_type,
      '{"k":"' || json_extract_string(props, '$.k') || '"}' AS clean FROM events""",
)
def answer_defaults(spark, sf_dir):
    """Paths of a JSON document with defaults, and the document without its debug entry."""
    events = tables.table(spark, sf_dir, "events")
    document = F.try_parse_json("props")
    record = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("_debug"), F.lit("x")))
    return shown(
        events.select(
            "event_id",
            answers.path_or(document, "$.k", "bigint", 0).alias("k"),
            answers.path_or(document, "$.match_type", "string", "NO_MATCH").alias("match_type"),
            F.to_json(answers.without_debug(record)).alias("clean"),
        )
    )


# ---------------------------------------------------------------- tokens and events


@query(
    "token_usage",
    """SELECT conv_id, count(*) AS calls, sum(length(text))::BIGINT AS prompt_tokens,
      sum(length(text) // 4)::BIGINT AS completion_tokens, sum(length(text) + length(text) // 4)::BIGINT AS total_tokens FROM conversations GROUP BY conv_id""",
)
def token_usage(spark, sf_dir):
    """Tokens per conversation, from a usage document per turn."""
    size = F.length("text")
    usage = F.to_json(
        F.struct(
            F.struct(
                size.alias("prompt_tokens"),
                F.floor(size / 4).alias("completion_tokens"),
                (size + F.floor(size / 4)).alias("total_tokens"),
            ).alias("usage")
        )
    )
    calls = tables.table(spark, sf_dir, "conversations").select("conv_id", usage.alias("usage"))
    return shown(answers.token_usage(calls, ["conv_id"], "usage"))


@query(
    "event_decode",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'message' WHEN 1 THEN 'message' ELSE event_type END AS event,
      CASE event_id % 5 WHEN 0 THEN '{"message":"' || event_type || '}' || '"}' WHEN 1 THEN '{"k":' || event_id || '}'
        ELSE '{"type":"' || event_type || '"}' END AS data FROM events""",
)
def event_decode(spark, sf_dir):
    """Events as sent: some carry no type, some are no JSON at all."""
    shape = F.col("event_id") % 5
    raw = (
        F.when(shape == 0, F.concat("event_type", F.lit("}")))
        .when(shape == 1, F.concat(F.lit('{"k":'), F.col("event_id").cast("string"), F.lit("}")))
        .otherwise(F.concat(F.lit('{"type":"'), "event_type", F.lit('"}')))
    )
    sent = tables.table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return answers.decoded_events(sent, "raw").drop("raw")


# ---------------------------------------------------------------- documents


@query(
    "dedupe_documents",
    """SELECT min(doc_id) AS doc_id, count(*) AS copies, sha256(text) AS digest FROM documents GROUP BY sha256(text)""",
)
def dedupe_documents(spark, sf_dir):
    return distinct_texts(tables.table(spark, sf_dir, "documents"), "doc_id", "text")
