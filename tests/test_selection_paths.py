"""The candidate join on both of its paths, and the constraints."""

import datetime

import pytest
from pyspark.sql import functions as F

from pricewell.operators import joins, quality, sizing
from pricewell.plans.catalog import queries
from pricewell.schemas import REQUESTS
from pricewell.sources import tables

SF = "/root/testdata/sf0.001"


def test_broadcast_needs_a_counted_small_side(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(sizing.broadcast_if_small(spark.range(5), rows=5))
    assert not hinted(sizing.broadcast_if_small(spark.range(6), rows=5))


def test_candidates_are_the_same_on_both_paths(spark, monkeypatch):
    contracts, requests = tables.contracts(spark, SF), tables.requests(spark, SF)
    columns = ["search_id", "contract_id"]
    small = joins.candidates(contracts, requests).select(*columns)
    monkeypatch.setattr(joins, "broadcast_if_small", lambda df: df.hint("merge"))
    large = joins.candidates(contracts, requests).select(*columns)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_invalid_requests_find_nothing(spark):
    requests = tables.requests(spark, SF)
    assert joins.valid_requests(requests.withColumn("limit_contracts", F.lit(0))).count() == 0
    assert joins.valid_requests(requests.withColumn("date_to", F.lit("1990-01-01").cast("date"))).count() == 0


def test_defaults_and_rejects(spark):
    requests = tables.requests(spark, SF).limit(4).withColumn("n", F.monotonically_increasing_id())
    odd = requests.withColumns(
        {
            "limit_contracts": F.lit(None).cast("int"),
            "law": F.when(F.col("n") != 0, F.col("law")),
            "date_from": F.when(F.col("n") != 1, F.col("date_from")),
        }
    )
    assert [r.limit_contracts for r in joins.valid_requests(odd).collect()] == [30, 30]
    faults = {f for r in joins.rejected_requests(odd).collect() for f in r.faults}
    assert faults == {"law is missing", "date_from is missing"}


def test_requests_reach_the_scans(spark, capsys):
    wanted = tables.requests(spark, SF).where("id = 'EUROPE/PROMO'")
    rows = joins.candidates(tables.contracts(spark, SF, wanted), wanted)
    plain = joins.candidates(tables.contracts(spark, SF), wanted)
    columns = ["search_id", "contract_id"]
    assert sorted(map(tuple, rows.select(*columns).collect())) == sorted(map(tuple, plain.select(*columns).collect()))
    assert rows.count() > 0
    rows.explain()
    plan = capsys.readouterr().out
    assert "p_type IN (PROMO)" in plan or "EqualTo(p_type,PROMO)" in plan or "p_type#" in plan and "PROMO" in plan
    assert "GreaterThanOrEqual(o_orderdate" in plan and "EUROPE" in plan


def test_head_limit_reads_few_columns(spark, capsys):
    queries()["head_limit"](spark, SF).explain()
    scans = [line for line in capsys.readouterr().out.splitlines() if "FileScan" in line]
    assert scans and not any(c in line for line in scans for c in ("c_name", "s_name", "p_brand", "p_retailprice", "l_shipdate"))


def test_unknown_status_labels_fall_back_to_completed(spark):
    requests = tables.requests(spark, SF).withColumn("execution_statuses", F.array(F.lit("Черновик")))
    found = joins.candidates(tables.contracts(spark, SF), requests).select("execution_status").distinct()
    assert [r[0] for r in found.collect()] == ["EXECUTION_COMPLETED"]


@pytest.fixture(scope="module")
def request_row():
    day = datetime.date(2024, 1, 1)
    return (
        "r1", datetime.datetime(2024, 1, 1), "RUNNING", "MANUAL", "Test Object", "123456", "987654", "СЗФО", "44-ФЗ",
        day, datetime.date(2024, 12, 31), ["Исполнение завершено", "Исполнение прекращено"], 30, None, 0, None, [],
        None, None, None,
    )


def test_request_rules(spark, request_row):
    good = spark.createDataFrame([request_row], REQUESTS)
    assert quality.violations(good, quality.request_rules()).filter("violations > 0").count() == 0
    bad = good.withColumn("date_to", F.date_sub("date_from", 1)).withColumn("object_name", F.lit(None).cast("string"))
    broken = quality.violations(bad, quality.request_rules()).filter("violations > 0").collect()
    assert {r.rule for r in broken} == {"requests.period reversed", "requests.object_name missing"}


def test_orphans_and_cascade(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id INT")
    children = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id INT, name STRING")
    assert [r.name for r in joins.orphans(children, parents, "id").collect()] == ["c"]
    left = joins.cascade_delete(children, parents.filter("id = 1"), "id")
    assert [r.name for r in left.collect()] == ["a"]


@pytest.mark.parametrize("name", ["run_violations", "report_exported"])
def test_one_pass_over_the_contracts(spark, monkeypatch, name):
    from pricewell.plans import ceiling

    passes, plain = [], ceiling.candidate_contracts
    monkeypatch.setattr(ceiling, "candidate_contracts", lambda *a: passes.append(a) or plain(*a))
    queries()[name](spark, SF)
    assert len(passes) == 1


def test_values_of_orders_are_told_apart_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_CONTRACTS", 100)
    lines = tables.table(spark, SF, "lineitem").count()
    assert queries()["distinct_code_lists"](spark, SF).rdd.getNumPartitions() >= lines // 100
