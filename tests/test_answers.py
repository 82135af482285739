"""Prompts and model answers."""

import json

from pyspark.sql import functions as F

from pricewell.operators import answers
from pricewell.schemas import COMPARISON_ANSWER, CONTRACT_ANSWER, TENDER_ANSWER

TENDER = {"items": [{"name": "Бумага", "parameters": [{"name": "плотность", "value": 80, "unit": "г/м2"}], "quantity": 5}]}
CONTRACT = {"contract_items": [{"item_name": "Бумага", "technical_specs": [], "price": "10"}]}
COMPARISON = {
    "score": 85,
    "match_type": "Homogeneous",
    "details": {"parameter_matches": [{"parameter": "цвет", "target_value": "a", "actual_value": "b", "match": False}]},
}
OTHER = {"score": 85, "comparisons": [{"target_value": "a"}]}


def given(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "search_id STRING, raw STRING")


def test_good_and_bad_answers(spark):
    df = given(spark, json.dumps(TENDER, ensure_ascii=False), '{"items": [', "no json", None)
    parsed = answers.parsed_answers(df, "raw", TENDER_ANSWER)
    assert [r.is_valid for r in parsed.orderBy("search_id").collect()] == [True, False, False, False]
    assert answers.rejected(parsed).count() == 3
    row = answers.tender_parameters(parsed, ["search_id"]).collect()
    assert [(r.item_name, r.name, r.value, r.unit, r.quantity) for r in row] == [("Бумага", "плотность", "80", "г/м2", "5")]


def test_contract_items_without_specs_stay(spark):
    parsed = answers.parsed_answers(given(spark, json.dumps(CONTRACT)), "raw", CONTRACT_ANSWER)
    row = answers.contract_specs(parsed, ["search_id"]).first()
    assert (row.item_name, row.price, row.parameter) == ("Бумага", "10", None)


def test_both_comparison_shapes_are_read(spark):
    parsed = answers.parsed_answers(given(spark, json.dumps(COMPARISON), json.dumps(OTHER)), "raw", COMPARISON_ANSWER)
    rows = answers.compared_parameters(parsed, ["search_id"]).orderBy("search_id").collect()
    assert [(r.name, r.target_value, r.match_status, r.weight) for r in rows] == [
        ("цвет", "a", "DIFF", 1), ("Unknown", "a", "UNKNOWN", 1)
    ]


def test_prompt_json_equals_the_standard_encoder(spark):
    fields = {"name": 'Бумага "А4"\\', "code": None, "count": 3}
    row = spark.range(1).select(
        answers.indented_object({"name": F.lit(fields["name"]), "code": F.lit(None).cast("string"), "count": F.lit(3)})
    )
    assert row.first()[0] == json.dumps(fields, indent=2, ensure_ascii=False)


def test_decoded_events(spark):
    df = given(spark, '{"type": "done"}', '{"x": 1}', "plain")
    rows = answers.decoded_events(df, "raw").orderBy("search_id").collect()
    assert [r.event for r in rows] == ["done", "message", "message"]
    assert json.loads(rows[2].data) == {"message": "plain"}
