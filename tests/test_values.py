"""Scalar functions against golden rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from pricewell.functions import compare, dates, labels, normalize, prices, scoring, text


def values_of(spark, rows, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]


def test_lenient_dates(spark):
    texts = [(t,) for t in ["01.01.2024", "2024-01-01", "01/01/2024", "2024.01.01", "от 01.01.2024 г.", "invalid", ""]]
    got = values_of(spark, texts, "s STRING", dates.lenient_date(F.col("s")))
    assert [g[0] for g in got] == [datetime.date(2024, 1, 1)] * 5 + [datetime.date.min] * 2


def test_dates_accept_single_digits_but_no_impossible_day(spark):
    got = values_of(spark, [("1.2.2024",), ("31.02.2024",)], "s STRING", dates.page_date(F.col("s")))
    assert got == [(datetime.date(2024, 2, 1),), (None,)]


def test_price_texts(spark):
    texts = ["1 234 567,89 руб.", "1 234 567.89 руб.", "1,234,567.89", "1 234,5", "", "по запросу", "12,5 "]
    got = values_of(
        spark, [(t,) for t in texts], "s STRING", prices.card_price(F.col("s")), prices.page_price(F.col("s"))
    )
    assert got == [
        (1234567.89, 1234567.89),
        (1234567.89, 123456789.0),
        (None, None),
        (None, 1234.5),
        (None, None),
        (None, None),
        (12.5, 12.5),
    ]


@pytest.mark.parametrize("as_struct", [True, False])
def test_normalized_values(spark, as_struct):
    expected = {
        "100мл": (100.0, "ml"), "100 мл": (100.0, "ml"), "5.5 кг": (5.5, "kg"), "10-20 м": (15.0, "m"),
        ">50 г": (50.0, "g"), "2 шт": (2.0, "pcs"), "3 ед": (3.0, "unit"), "10-20см": (15.0, "cm"),
        "5,5л": (5.5, "l"), "80 г/м2": (80.0, None), "160%": (160.0, None), "core i5": (5.0, None),
        "a, b 5": (None, None), "16gb": (16.0, "g"), "": (None, None), "10 кг": (10.0, "kg"),
        "2.5 liters": (2.5, "l"), "just text": (None, None), "100°c": (100.0, "°c"), "5 дюйм": (5.0, "m"),
    }
    df = spark.createDataFrame([(v,) for v in expected] + [(None,)], "v STRING")
    if as_struct:
        n = normalize.normalize_value(F.col("v"))
        rows = df.select("v", n["numeric_value"], n["unit"], n["is_numeric"]).collect()
    else:
        rows = normalize.with_normalized(df, "v", "n").select("v", "n_number", "n_unit", "n_is_numeric").collect()
    for value, number, unit, is_numeric in rows:
        assert (number, unit) == expected.get(value, (None, None)), value
        assert is_numeric == (number is not None)


def test_compared_values(spark):
    pairs = [
        ("100мл", "100 мл", 1.0, "MATCH"), ("5.5 кг", "5.0 кг", 0.919091, "MATCH"), ("10 м", "9.5 м", 0.96, "MATCH"),
        ("2 шт", "2 штуки", 1.0, "MATCH"), ("сталь", "нержавеющая сталь", 1.0, "MATCH"),
        ("1 л", "1000 мл", 0.011, "DIFF"), ("1000 г", "1005 г", 0.502488, "DIFF"), ("5 кг", "5 м", 0.0, "DIFF"),
        ("", "", 1.0, "MATCH"), ("", "x", 0.0, "DIFF"),
    ]
    df = spark.createDataFrame([p[:2] for p in pairs], "t STRING, a STRING")
    rows = {(r.t, r.a): r for r in compare.with_comparison(df, "t", "a").collect()}
    for target, actual, confidence, status in pairs:
        row = rows[target, actual]
        assert row.confidence == pytest.approx(confidence, abs=1e-4), (target, actual)
        assert row.match_status == status
    colours = compare.with_comparison(spark.createDataFrame([("красный", "синий")], "t STRING, a STRING"), "t", "a")
    assert colours.first().match_status == "DIFF"


def test_strict_comparison_converts_units_and_takes_a_tolerance(spark):
    df = spark.createDataFrame([("1 л", "1000 мл"), ("100 г", "105 г"), ("100 г", "150 г")], "t STRING, a STRING")
    rows = {r.t + r.a: r for r in compare.with_comparison(df, "t", "a", tolerance=0.05, mode="strict").collect()}
    assert rows["1 л1000 мл"].confidence == 1.0
    assert rows["100 г105 г"].match_status == "MATCH" and rows["100 г105 г"].confidence > 0.95
    assert rows["100 г150 г"].match_status == "DIFF" and rows["100 г150 г"].confidence < 0.7


def test_makers(spark):
    exact = [("Company A", "Company A"), ("Company A", "Company B"), ("COMPANY A", "company a "), (None, "x"), ("x", "")]
    got = values_of(spark, exact, "t STRING, f STRING", compare.maker_exact(F.col("t"), F.col("f")))
    assert [g[0] for g in got] == [True, False, True, None, None]
    fuzzy = [("ООО 'Ромашка'", "ООО Ромашка"), ("АО 'Технопром'", "Технопром"), ("ИП Иванов", "ООО Иванов"), ("Siemens AG", "Siemens"), (None, "x")]
    got = values_of(spark, fuzzy, "t STRING, f STRING", compare.maker_similarity(F.col("t"), F.col("f")) >= 0.7)
    assert [g[0] for g in got] == [True, True, True, True, False]
    forms = [("ООО Рога и Копыта",), ("Apple Inc.",), ("LLC Test Company",), ("GmbH German Corp",), (None,)]
    got = values_of(spark, forms, "s STRING", text.strip_legal_form(F.col("s")))
    assert [g[0] for g in got] == ["рога и копыта", "apple", "test", "german", ""]


def test_texts_and_labels(spark):
    got = values_of(
        spark, [("100 USD",), ("200 €",), ("300 РУБ",), ("400 ₽",), ("500",)], "s STRING", text.currency_of(F.col("s"))
    )
    assert [g[0] for g in got] == ["USD", "EUR", "RUB", "RUB", "RUB"]
    got = values_of(spark, [("15.12.2023",), ("x",)], "s STRING", dates.year_of_text(F.col("s")))
    assert [g[0] for g in got] == [2023, None]
    got = values_of(spark, [(True,), (False,), (None,)], "b BOOLEAN", labels.yes_no_unspecified(F.col("b")))
    assert [g[0] for g in got] == ["Да", "Нет", "Не указано"]
    got = values_of(spark, [(5, 10), (1, 0)], "a INT, b INT", text.percent(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [50.0, 0.0]
    got = values_of(spark, [("  Hello WORLD  ",), (None,)], "s STRING", text.normalize_text(F.col("s")))
    assert [g[0] for g in got] == ["hello world", ""]


def test_selection_score(spark):
    rows = [
        ("IDENTICAL", 100, True, 2025, 10.0), ("HOMOGENEOUS", 80, None, 2023, 10.0),
        ("NO_MATCH", 0, False, 2020, None), ("other", 50, None, 2026, None),
    ]
    score = scoring.selection_score(*[F.col(c) for c in ("m", "s", "b", "y", "p")], as_of_year=2026)
    got = values_of(spark, rows, "m STRING, s INT, b BOOLEAN, y INT, p DOUBLE", score)
    assert [g[0] for g in got] == [105.0, 70.0, 10.0, 45.0]


def test_final_status(spark):
    rows = [("boom", 3), (None, 0), (None, 2), ("", 2)]
    got = values_of(
        spark, rows, "e STRING, n INT", scoring.final_status(F.col("e"), F.col("n")),
        scoring.final_error(F.col("e"), F.col("n")),
    )
    assert got == [("ERROR", "boom"), ("ERROR", "No contracts were processed"), ("DONE", None), ("DONE", None)]


def test_unit_price_takes_zero_for_missing(spark):
    rows = [(5.0, 100.0, 4.0), (0.0, 100.0, 4.0), (None, 100.0, 0.0), (None, None, 4.0)]
    got = values_of(
        spark, rows, "p DOUBLE, t DOUBLE, q DOUBLE", prices.unit_price(F.col("p"), F.col("t"), F.col("q"))
    )
    assert [g[0] for g in got] == [5.0, 25.0, None, None]
