"""Top-k, numbering and paging against brute force, hot groups included."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from pricewell.operators import topk
from pricewell.sources import sinks


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    # one group holds a third of all rows
    return [(("hot" if i % 3 == 0 else f"g{i % 17}"), rng.randrange(30), i, 4) for i in range(1500)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "g STRING, score INT, id INT, k INT").repartition(5)


def best(rows, k):
    ordered = sorted(rows, key=lambda r: (r[0], -r[1], r[2]))
    return {r[:3] for _, group in groupby(ordered, key=lambda r: r[0]) for r in list(group)[:k]}


def order():
    return [F.desc("score"), F.asc("id")]


@pytest.mark.parametrize("salted", [True, False])
@pytest.mark.parametrize("k", [1, 3, 40])
def test_top_k(df, rows, k, salted):
    got = {tuple(r)[:3] for r in topk.top_k(df, ["g"], order(), k, salted=salted).collect()}
    assert got == best(rows, k)


def test_top_k_by_column_and_beyond_the_pruned_limit(df, rows):
    by_column = topk.top_k(df, ["g"], order(), F.col("k"))
    assert {tuple(r)[:3] for r in by_column.collect()} == best(rows, 4)
    salted = topk.top_k(df, ["g"], order(), 1200)
    assert {tuple(r)[:3] for r in salted.collect()} == best(rows, 1200)
    salted_column = topk.top_k(df, ["g"], order(), F.col("k"), at_most=5000)
    assert {tuple(r)[:3] for r in salted_column.collect()} == best(rows, 4)


def test_the_limit_is_applied_before_the_shuffle(df, capsys):
    topk.top_k(df, ["g"], order(), 3, salted=False).explain()
    assert capsys.readouterr().out.count("WindowGroupLimit") == 2
    topk.top_k(df, ["g"], order(), 3).explain()
    assert capsys.readouterr().out.count("WindowGroupLimit") == 4


def test_numbered_equals_a_plain_row_number(df, rows):
    steps = [(F.col("score"), True), (F.floor(F.col("id") / 100), False)]
    got = topk.numbered(df, ["g"], steps, order(), "n")
    numbers = {r.id: r.n for r in got.collect()}
    ordered = sorted(rows, key=lambda r: (r[0], -r[1], r[2]))
    for _, group in groupby(ordered, key=lambda r: r[0]):
        for position, row in enumerate(group, start=1):
            assert numbers[row[2]] == position


def test_pages_cover_every_row_once(df, rows):
    seen = []
    for skip in range(0, 600, 100):
        seen += [r.id for r in topk.page(df, ["g"], order(), skip, 100).collect()]
    assert sorted(seen) == [r[2] for r in rows]


def test_page_bounds(spark):
    cases = [(0, 1), (25, 2), (25, 9), (25, 0), (10, 1)]
    df = spark.createDataFrame(cases, "total BIGINT, asked BIGINT")
    bounds = topk.page_bounds(F.col("total"), F.col("asked"), 10)
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in bounds.items()]).collect()]
    assert got == [(0, 1, 0, 0), (3, 2, 11, 20), (3, 3, 21, 25), (3, 1, 1, 10), (1, 1, 1, 10)]


def test_freshest_first(spark):
    contracts = [("1", "15.02.2024"), ("2", "01.01.2024"), ("3", "10.03.2024"), ("4", "05.02.2024")]
    from pricewell.functions.dates import lenient_date

    df = spark.createDataFrame(contracts, "registry_no STRING, date STRING").withColumn("s", F.lit("s"))
    order = [F.desc(lenient_date(F.col("date"))), F.desc("registry_no")]
    ranked = topk.top_k(df, ["s"], order, 2, rank="n").orderBy("n")
    assert [r.registry_no for r in ranked.collect()] == ["3", "1"]


def test_partitioned_sink_keeps_all_rows(spark, df, rows, tmp_path):
    sinks.write_partitioned(df, str(tmp_path / "t"), "g", file_rows=100)
    assert len(list((tmp_path / "t" / "g=hot").glob("*.parquet"))) >= 5
    assert spark.read.parquet(str(tmp_path / "t")).count() == len(rows)


def test_nested_columns_pass_through(df, rows):
    nested = df.withColumn("m", F.create_map(F.lit("id"), F.col("id"))).withColumn("a", F.array("id"))
    got = topk.top_k(nested, ["g"], order(), 3).collect()
    assert {tuple(r)[:3] for r in got} == best(rows, 3) and all(r.m["id"] == r.a[0] == r.id for r in got)


def test_no_row_is_lost_to_a_bound(spark):
    df = spark.range(3_000).select(F.lit("a").alias("g"), F.col("id"), F.lit(2_500).alias("k"))
    assert topk.top_k(df, ["g"], [F.asc("id")], F.col("k")).count() == 2_500
    assert topk.top_k(df, ["g"], [F.asc("id")], F.col("k"), at_most=2_600).count() == 2_500


def test_null_keys_and_steps_are_kept(spark):
    rows = [("a", 3, 1), ("a", None, 2), (None, 5, 3), (None, None, 4), (None, 5, 5), ("a", None, 6)]
    df = spark.createDataFrame(rows, "g STRING, day INT, id INT")
    got = topk.numbered(df, ["g"], [(F.col("day"), True)], [F.desc("day"), F.asc("id")], "n").collect()
    assert {r.id: r.n for r in got} == {1: 1, 2: 2, 6: 3, 3: 1, 5: 2, 4: 3}
    totals = topk.with_group_total(df, df, ["g"]).collect()
    assert {r.id: r.total for r in totals} == {i: 3 for i in range(1, 7)}
