"""Similarity and specification matching."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricewell.functions import similarity as sim
from pricewell.functions.compare import maker_contains_any, maker_similarity
from pricewell.operators import matching, name_join

words = st.text(alphabet="abcё ", max_size=14)


def lcs_by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, start=1):
            row[j], before = (before + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def partial_by_hand(a, b):
    if not a or not b:
        return float(a == b)
    short, long = sorted((a, b), key=len)
    sides = [(short, long)] + ([(long, short)] if len(a) == len(b) else [])
    return max(
        sim.ratio(s, t[max(i, 0) : min(i + len(s), len(t))]) for s, t in sides for i in range(1 - len(s), len(t))
    )


@given(words, words)
def test_ratios(a, b):
    assert sim.lcs_length(a, b) == lcs_by_table(a, b)
    assert sim.ratio(a, b) == sim.ratio(b, a)
    assert sim.partial_ratio(a, b) == pytest.approx(partial_by_hand(a, b))
    for score in (sim.ratio, sim.partial_ratio, sim.token_sort_ratio, sim.token_set_ratio, sim.best_ratio):
        assert 0.0 <= score(a, b) <= 1.0
    assert sim.best_ratio(a, a) == 1.0


def test_known_ratios():
    assert sim.ratio("красный", "синий") == 0.5
    assert sim.best_ratio("сталь", "нержавеющая сталь") == 1.0
    assert sim.token_sort_ratio("b a", "a b") == 1.0
    assert sim.token_set_ratio("a b c", "c a") == 1.0
    assert sim.best_ratio("", "") == 1.0 and sim.best_ratio("", "x") == 0.0


def test_similarity_column_keeps_nulls(spark):
    df = spark.createDataFrame([("ab", "abc"), (None, "x"), ("x", None)], "a STRING, b STRING")
    got = [r[0] for r in df.select(sim.text_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, None, None]


# Own characteristics; the confidences are worked out by hand: 0.7 of the comparison plus 0.3 of the model.
TARGET = {
    "Ширина": "200 мм", "Нагрузка": "8 кг", "Покрытие": "порошковая эмаль", "Ящики": "4 шт", "Гарантия": "2 года",
}
ACTUAL = {
    "Ширина": "200 мм", "Нагрузка": "10 кг", "Покрытие": "эмаль", "Ящики": "4 штуки", "Цвет": "белый",
}
MODEL = {"Ширина": 1.0, "Нагрузка": 0.5, "Покрытие": 0.6, "Ящики": 0.9, "Гарантия": 0.2}
BLENDED = {
    "Ширина": 0.7 + 0.3,  # equal numbers in equal units
    "Нагрузка": 0.7 * (1 - (0.2 - 0.01)) + 0.15,  # 2 of 10 apart, 0.01 of it tolerated
    "Покрытие": 0.7 + 0.18,  # the shorter text is part of the longer one
    "Ящики": 0.7 + 0.27,
    "Гарантия": 0.06,  # nothing delivered
    "Цвет": 0.0,
}


@pytest.fixture(scope="module")
def contract(spark):
    row = [("s", "c", TARGET, ACTUAL, MODEL, "Мебель Плюс", "ООО Мебель Плюс")]
    ddl = (
        "search_id STRING, contract_id STRING, target_specs MAP<STRING,STRING>, actual_specs MAP<STRING,STRING>,"
        " model MAP<STRING,DOUBLE>, target_maker STRING, found_maker STRING"
    )
    return spark.createDataFrame(row, ddl)


def model():
    return F.try_element_at("model", F.col("name"))


def test_specification_rows(contract):
    rows = matching.spec_comparison_rows(matching.spec_pairs(contract), model()).collect()
    assert {r.name for r in rows} == set(BLENDED)
    for row in rows:
        assert row.confidence == pytest.approx(BLENDED[row.name], abs=1e-6), row.name
        assert row.match_status == ("MATCH" if BLENDED[row.name] >= 0.7 else "DIFF")


def test_specification_summary(spark, contract):
    makers = contract.withColumn("model_score", F.col("model"))
    summary = matching.spec_summary(
        matching.spec_comparison_rows(matching.spec_pairs(makers), model()), ["search_id", "contract_id"]
    ).first()
    assert (summary.total_specs, summary.match_count, summary.diff_count, summary.unknown_count) == (6, 4, 2, 0)
    assert summary.avg_confidence == pytest.approx(sum(BLENDED.values()) / 6, abs=1e-6)
    alike = contract.select(maker_similarity(F.col("target_maker"), F.col("found_maker")) >= 0.7).first()[0]
    assert alike is True


def test_match_specifications_without_model(contract):
    row = matching.match_specifications(
        contract.drop("model"), ["search_id", "contract_id"], "target_maker", "found_maker", F.lit(None).cast("double")
    ).first()
    assert row.total_specs == 6 and row.manufacturer_match is True
    # without a model only equal values reach a match
    assert row.match_count == 3


def test_contract_without_characteristics(spark, contract):
    none = F.create_map().cast("map<string,string>")
    bare = contract.withColumns({"contract_id": F.lit("bare"), "target_specs": none, "actual_specs": none})
    unknown = contract.withColumns({"contract_id": F.lit("null"), "target_specs": F.lit(None).cast("map<string,string>")}).withColumn("actual_specs", F.col("target_specs"))
    rows = matching.match_specifications(
        contract.union(bare).union(unknown), ["search_id", "contract_id"], "target_maker", "found_maker", model()
    ).collect()
    assert {r.contract_id: (r.total_specs, r.match_count, r.avg_confidence, r.match_percentage) for r in rows if r.contract_id != "c"} == {
        "bare": (0, 0, 0.0, 0.0), "null": (0, 0, 0.0, 0.0)
    }
    assert len(rows) == 3


def test_makers_alike(spark):
    rows = [(1, "Завод Север", ["Юг", "завод север"]), (2, "Завод Север", ["Юг"]), (3, None, ["Юг"]), (4, "Юг", []), (5, "Юг", [None, ""]), (6, "", ["Юг"])]
    df = spark.createDataFrame(rows, "id INT, wanted STRING, makers ARRAY<STRING>")
    got = matching.makers_alike(df, "wanted", F.col("makers"), "hit").collect()
    assert {r.id: r.hit for r in got} == {1: True, 2: False, 3: None, 4: None, 5: None, 6: None}
    assert got[0].asDict().keys() == {"id", "wanted", "makers", "hit"}
    contained = df.select("id", maker_contains_any(F.lower("wanted"), F.col("makers")).alias("hit")).collect()
    assert {r.id: r.hit for r in contained} == {1: True, 2: False, 3: None, 4: None, 5: None, 6: None}


def test_long_and_map_forms_agree(contract):
    keys = ["search_id", "contract_id"]
    side = lambda column: contract.select(*keys, F.explode(column).alias("name", "value"))
    long = matching.spec_pairs_long(side("target_specs"), side("actual_specs"), keys)
    wide = matching.spec_pairs(contract).select(*long.columns)
    assert sorted(map(tuple, long.collect())) == sorted(map(tuple, wide.collect()))


def test_key_rows(spark):
    row = [("s", "c", "17.12", "Бумага А4", None, ["17.12"], "бумага а4", "Завод", True, None)]
    ddl = (
        "search_id STRING, contract_id STRING, code STRING, target_name STRING, target_manufacturer STRING,"
        " codes ARRAY<STRING>, object_name STRING, manufacturer STRING, code_match BOOLEAN, maker_match BOOLEAN"
    )
    df = spark.createDataFrame(row, ddl)
    first = F.get("codes", F.lit(0))
    flagged = matching.key_comparison_rows(df.withColumn("maker_match", F.lit(True)), ["contract_id"], "code", first, "code_match", "maker_match")
    assert flagged.where("name = 'Manufacturer'").first().match_status == "MATCH"
    got = matching.key_comparison_rows(df, ["contract_id"], "code", first, "code_match", "maker_match").collect()
    assert {(r.name, r.match_status, r.weight) for r in got} == {
        ("KTRU Code", "MATCH", 2), ("Manufacturer", "DIFF", 1), ("Object Name", "MATCH", 1)
    }


def test_classification_by_mandatory_fields(spark):
    rows = [
        ("same", "size", "MATCH", 1), ("same", "maker", "MATCH", 1), ("same", "colour", "DIFF", 1),
        ("alike", "size", "MATCH", 2), ("alike", "maker", "UNKNOWN", 1), ("alike", "colour", "MATCH", 1),
        ("conflict", "size", "DIFF", 1), ("conflict", "maker", "MATCH", 1), ("conflict", "colour", "MATCH", 1),
        ("lacking", "size", "MATCH", 1), ("lacking", "colour", "MATCH", 1),
        ("neither", "colour", "DIFF", 1), ("twice", "size", "MATCH", 1), ("twice", "size", "UNKNOWN", 1), ("twice", "maker", "MATCH", 1),
    ]
    df = spark.createDataFrame(rows, "contract_id STRING, name STRING, match_status STRING, weight INT")
    got = matching.classify_by_fields(df, ["contract_id"], ["size", "maker"], 0.6).collect()
    assert {r.contract_id: (r.match_type, r.decision) for r in got} == {
        "same": ("IDENTICAL", "ACCEPT"), "alike": ("HOMOGENEOUS", "REVIEW"), "conflict": ("NO_MATCH", "REJECT"),
        "lacking": ("HOMOGENEOUS", "REVIEW"), "neither": ("NO_MATCH", "REJECT"), "twice": ("HOMOGENEOUS", "REVIEW"),
    }


WORDS = ["pump", "pumps", "heat", "heater", "ab", "a", "b", "of", "x1", "насос", "pum", "p ump", "steel", "stee1", "  ", "ba", "abc", "d"]


@pytest.mark.parametrize("seed,threshold", [(1, 0.8), (2, 0.8), (3, 0.7), (4, 0.95)])
def test_similar_names_lose_no_pair(spark, seed, threshold):
    rng = random.Random(seed)

    def name():
        text = rng.choice([" ", "  ", "-"]).join(rng.choice(WORDS) for _ in range(rng.choice([1, 1, 2, 3, 5])))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["", "z", " ", "p"]) + text[at + rng.choice([0, 1]) :]
        return text

    sides = [[(rng.choice(["c1", "c2"]), name()) for _ in range(220)] + [("c1", ""), ("c1", None), (None, "pump")] for _ in range(2)]
    a, b = (spark.createDataFrame(rows, "code string, name string") for rows in sides)
    got = name_join.similar_names(a, b.withColumnRenamed("name", "found"), ["code"], "name", "found", threshold).collect()
    left, right = ({(c, n.lower()) for c, n in rows if c and n is not None} for rows in sides)
    want = {(c, x, y): s for c, x in left for k, y in right if c == k and (s := sim.best_ratio(x, y)) > threshold}
    assert {(r.code, r.name, r.found): r.similarity for r in got} == want and len(got) == len(want)


def test_few_pairs_are_compared(spark):
    rng = random.Random(5)
    names = [("c", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24))) for _ in range(400)]
    a = spark.createDataFrame(names, "code string, __name string")
    found = name_join.candidates(a, a, ["code"], 0.8).count()
    assert 400 <= found < 0.6 * 400 * 400
    with pytest.raises(ValueError):
        name_join.similar_names(a, a, ["code"], "__name", "__name", 0.6)


def test_rows_of_makers_are_read_once_and_not_shuffled(spark):
    rows = spark.createDataFrame([(i, "Завод Север", ["завод север" if i % 2 else "Юг"]) for i in range(50)], "id INT, wanted STRING, makers ARRAY<STRING>")
    got = matching.makers_alike(rows, "wanted", F.col("makers"), "hit")
    # read from where they were stored, by no key that all share
    assert any("makers-" in f for f in got.inputFiles())
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString()
    assert {r.id: r.hit for r in got.collect()} == {i: bool(i % 2) for i in range(50)}


def test_classes_take_one_shuffle(spark):
    rows = [("a", "x", "MATCH", 1), ("a", "y", "MATCH", 1), ("a", "z", "DIFF", 2), ("b", "x", "MATCH", 1), ("b", "x", "DIFF", 1), ("c", "x", "MATCH", 1), ("d", "y", None, 1)]
    df = spark.createDataFrame(rows, "id STRING, name STRING, match_status STRING, weight INT")
    got = matching.classify_by_fields(df, ["id"], ["x", "y"], 0.4)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    found = {r.id: (r.match_share, r.match_type, r.decision) for r in got.collect()}
    assert found == {"a": (0.5, "IDENTICAL", "ACCEPT"), "b": (0.5, "NO_MATCH", "REJECT"), "c": (1.0, "HOMOGENEOUS", "REVIEW"), "d": (0.0, "NO_MATCH", "REJECT")}
