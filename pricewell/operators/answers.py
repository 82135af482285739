"""Prompts for a model and the parsing of its JSON answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column as ColumnType

# Wording of the user messages.
EXTRACT_TENDER = "Extract technical specifications from the following text:\n\n"
EXTRACT_CONTRACT = "Extract technical specifications from the following contract document text:\n\n"
COMPARE_HEAD = "Compare the following target specifications with actual specifications:\n\n"
COMPARE_TARGET = "Target Specifications:\n"
COMPARE_ACTUAL = "\n\nActual Specifications:\n"
COMPARE_TAIL = "\n\nCalculate a match score from 0-100 and determine the match type."


def json_scalar(value: Column) -> Column:
    """One value as JSON, null included."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def indented_object(fields: dict[str, Column], indent: int = 2) -> Column:
    """A flat JSON object, one indented line per field."""
    pad = " " * indent
    lines = [
        F.concat(F.lit(f'{pad}"{name}": '), json_scalar(value if isinstance(value, ColumnType) else F.lit(value)))
        for name, value in fields.items()
    ]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def extraction_prompt(text: Column, contract: bool = False) -> Column:
    return F.concat(F.lit(EXTRACT_CONTRACT if contract else EXTRACT_TENDER), text)


def messages(system: str, user: Column) -> Column:
    """The system and user messages of one model call; the system text is the caller's."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


def comparison_prompt(target_json: Column, actual_json: Column) -> Column:
    return F.concat(
        F.lit(COMPARE_HEAD), F.lit(COMPARE_TARGET), target_json, F.lit(COMPARE_ACTUAL), actual_json, F.lit(COMPARE_TAIL)
    )


def parsed_answers(answers: DataFrame, raw: str, schema: str, name: str = "answer") -> DataFrame:
    """Adds the parsed answer and ``is_valid``; texts that are no JSON object are invalid."""
    with_corrupt = f"{schema}, _corrupt STRING"
    parsed = answers.withColumn(name, F.from_json(raw, with_corrupt, {"columnNameOfCorruptRecord": "_corrupt"}))
    valid = F.col(f"{name}._corrupt").isNull() & F.col(name).isNotNull()
    return parsed.withColumn("is_valid", valid).withColumn(name, F.col(name).dropFields("_corrupt"))


def rejected(answers: DataFrame) -> DataFrame:
    return answers.filter(~F.col("is_valid"))


def tender_parameters(answers: DataFrame, keys: Sequence[str], name: str = "answer") -> DataFrame:
    """One row per parameter of each tender item."""
    items = answers.filter("is_valid").select(*keys, F.posexplode(f"{name}.items").alias("item_no", "item"))
    flat = items.select(
        *keys, "item_no", F.col("item.name").alias("item_name"), F.col("item.quantity").alias("quantity"),
        F.explode("item.parameters").alias("p"),
    )
    return flat.select(
        *keys, "item_no", "item_name", "quantity", F.col("p.name").alias("name"), F.col("p.value").alias("value"),
        F.col("p.unit").alias("unit"),
    )


def contract_specs(answers: DataFrame, keys: Sequence[str], name: str = "answer") -> DataFrame:
    """One row per technical specification of each contract item; items without any keep one row."""
    items = answers.filter("is_valid").select(*keys, F.posexplode_outer(f"{name}.contract_items").alias("item_no", "item"))
    flat = items.select(
        *keys, "item_no", F.col("item.item_name").alias("item_name"), F.col("item.price").alias("price"),
        F.explode_outer("item.technical_specs").alias("s"),
    )
    return flat.select(
        *keys, "item_no", "item_name", "price", F.col("s.parameter").alias("parameter"),
        F.col("s.requirement").alias("requirement"), F.col("s.unit").alias("unit"),
    )


def compared_parameters(answers: DataFrame, keys: Sequence[str], name: str = "answer") -> DataFrame:
    """Comparison rows of an answer, under either of the names answers use, with their defaults."""
    from_matches = F.transform(
        F.col(f"{name}.details.parameter_matches"),
        lambda m: F.struct(
            m["parameter"].alias("name"),
            m["target_value"].alias("target_value"),
            m["actual_value"].alias("actual_value"),
            F.when(m["match"], F.lit("MATCH")).when(~m["match"], F.lit("DIFF")).alias("match_status"),
            F.lit(None).cast("int").alias("weight"),
        ),
    )
    rows = answers.filter("is_valid").select(*keys, F.inline(F.coalesce(F.col(f"{name}.comparisons"), from_matches)))
    return rows.withColumns(
        {
            "name": F.coalesce("name", F.lit("Unknown")),
            "match_status": F.coalesce("match_status", F.lit("UNKNOWN")),
            "weight": F.coalesce("weight", F.lit(1)),
        }
    )


def without_debug(record: Column) -> Column:
    """A map of answer fields without its debug entry."""
    return F.map_filter(record, lambda k, _: k != "_debug")


def path_or(document: Column, path: str, kind: str, default) -> Column:
    """A value of a JSON document by path, with a default for missing or unfitting ones."""
    return F.coalesce(F.try_variant_get(document, path, kind), F.lit(default))


def token_usage(calls: DataFrame, keys: Sequence[str], usage: str) -> DataFrame:
    """Tokens spent per key, from the usage document of each call."""
    document = F.try_parse_json(F.col(usage))
    named = {
        "prompt_tokens": path_or(document, "$.usage.prompt_tokens", "bigint", 0),
        "completion_tokens": path_or(document, "$.usage.completion_tokens", "bigint", 0),
        "total_tokens": path_or(document, "$.usage.total_tokens", "bigint", 0),
    }
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), *[F.sum(col).alias(n) for n, col in named.items()])


def decoded_events(events: DataFrame, raw: str) -> DataFrame:
    """Event type (``message`` by default) and payload; text that is no JSON is wrapped as a message."""
    document = F.try_parse_json(F.col(raw))
    wrapped = F.to_json(F.struct(F.col(raw).alias("message")))
    return events.withColumns(
        {
            "event": F.when(document.isNull(), F.lit("message")).otherwise(
                F.coalesce(F.try_variant_get(document, "$.type", "string"), F.lit("message"))
            ),
            "data": F.when(document.isNull(), wrapped).otherwise(F.col(raw)),
        }
    )
