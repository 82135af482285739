"""Values at ranks by sketches, and pages of ordered tables, against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from pricewell.operators import quantiles
from pricewell.sources import paged

RANKS = {"q1": lambda n: F.floor(n / 4), "middle": lambda n: F.floor(n / 2), "last": lambda n: n - 1, "beyond": lambda n: n}


@pytest.mark.parametrize("picked,reach", [(100_000, 0.02), (50, 0.02), (5, 0.0), (1, 0.3)])
def test_values_at_ranks(spark, picked, reach):
    rng = random.Random(picked)
    groups = {
        "many": [rng.randrange(10**12) for _ in range(2_000)],
        "same": [7] * 3_000,
        "hot": [5] * 2_000 + [rng.randrange(1_000) - 500 for _ in range(500)],
        "few": [3, 1, 2],
        "one": [-9],
        None: [rng.randrange(50) for _ in range(400)],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("few", None), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g STRING, value BIGINT").repartition(5)
    got = quantiles.values_at(df, ["g"], "value", RANKS, picked=picked, reach=reach).collect()
    want = {g: (len(v), sorted(v)[len(v) // 4], sorted(v)[len(v) // 2], max(v), None) for g, v in groups.items()}
    assert {r.g: (r.n, r.q1, r.middle, r.last, r.beyond) for r in got} == want and len(got) == len(want)


def test_no_values(spark):
    df = spark.createDataFrame([("a", None)], "g STRING, value BIGINT")
    assert quantiles.values_at(df, ["g"], "value", RANKS).collect() == []


def key(row):
    """Descending dates, null last, then ascending numbers, null first."""
    day, no = row
    return (day is None, tuple(-ord(c) for c in day or ""), no is not None, no or 0)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = {(rng.choice([None, "2024-01-01", "2024-01-02", "2024-02-01", "2023-12-31"]), rng.choice([None, *range(400)])) for _ in range(1_500)}
    path = str(tmp_path_factory.mktemp("paged") / "table")
    df = spark.createDataFrame([(*r, "x") for r in rows], "day STRING, no INT, position STRING")
    paged.write(df.drop("position").withColumn("text", F.lit("x")).repartition(6), path, ORDER, file_rows=37)
    return path, sorted(rows, key=key)


ORDER = [("day", True), ("no", False)]


def shown(df):
    return [(r.position, r.day, r.no) for r in df.orderBy("position").collect()]


def test_pages_equal_offsets(spark, table):
    path, rows = table
    assert paged.total(spark, path) == len(rows)
    for skip, limit in [(0, 10), (36, 2), (37, 37), (500, 100), (len(rows) - 3, 50), (len(rows), 5), (0, len(rows))]:
        got = paged.page(spark, path, skip, limit)
        assert shown(got) == [(skip + i, *r) for i, r in enumerate(rows[skip : skip + limit])]
    assert len(paged.page(spark, path, 500, 20).inputFiles()) <= 2


def test_pages_behind_a_row(spark, table):
    path, rows = table
    for at in (0, 36, 37, 400, len(rows) - 2, len(rows) - 1, *(i for i, r in enumerate(rows) if None in r and i % 25 == 0)):
        got = paged.page_behind(spark, path, ORDER, {"day": rows[at][0], "no": rows[at][1]}, 6)
        assert shown(got) == [(at + 1 + i, *r) for i, r in enumerate(rows[at + 1 : at + 7])]
    # a row that is gone, and one before all others
    gone = {"day": "2024-01-01", "no": 1_000}
    after = [r for r in rows if key(r) > key((gone["day"], gone["no"]))]
    assert [x[1:] for x in shown(paged.page_behind(spark, path, ORDER, gone, 4))] == after[:4]
    assert [x[1:] for x in shown(paged.page_behind(spark, path, ORDER, {"day": "2999-01-01", "no": 0}, 2))] == rows[:2]


def test_pages_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    paged.write(spark.createDataFrame([], "day STRING, no INT"), path, ORDER)
    assert paged.total(spark, path) == 0 and paged.page(spark, path, 0, 5).collect() == []
    assert paged.page_behind(spark, path, ORDER, {"day": "x", "no": 1}, 5).collect() == []
