"""Nested values as JSON text against the json module."""

import json
import math
import random
import struct

from pyspark.sql import functions as F

from pricewell.functions.json_text import indented
from pricewell.plans import dialogs

DDL = (
    "id INT, v STRUCT<`a b`: STRING, n: ARRAY<STRUCT<x: DOUBLE, `y.z`: BIGINT, deep: MAP<STRING, ARRAY<STRING>>>>,"
    " flag: BOOLEAN, none: STRING, empty: ARRAY<INT>, m: MAP<INT, STRUCT<k: STRING>>>"
)
TEXTS = ["", "plain", 'say "so"', "back\\slash", "line\nend\r\t\b\f", "\x00\x1f\x0b\x7f", "Бумага А4 🙂 é", "</script>", " ", None]


def as_row(rng, i):
    text = lambda: rng.choice(TEXTS)
    items = [
        (rng.choice([None, 0.0, -0.0, 1.5, 1e16, 123456789.125, 1e-5]), rng.choice([None, -3, 2**62]), rng.choice([None, {}, {"к": []}, {'q"': [text(), None]}]))
        for _ in range(rng.randrange(4))
    ]
    value = (text(), rng.choice([None, items]), rng.choice([True, False, None]), None, [], rng.choice([{}, {5: (text(),)}, {1: None}]))
    return (i, rng.choice([value, value, value, None]))


def plain(value):
    if value is None:
        return None
    a, n, flag, none, empty, m = value
    items = None if n is None else [{"x": x, "y.z": y, "deep": d} for x, y, d in n]
    return {"a b": a, "n": items, "flag": flag, "none": none, "empty": empty, "m": {str(k): v and {"k": v[0]} for k, v in m.items()}}


def test_nested_values(spark):
    rng = random.Random(2)
    rows = [as_row(rng, i) for i in range(200)]
    df = spark.createDataFrame(rows, DDL)
    for step in (2, 4):
        got = df.select("id", indented(F.col("v"), df.schema["v"].dataType, step).alias("t")).collect()
        want = {i: json.dumps(plain(v), indent=step, ensure_ascii=False) for i, v in rows}
        for r in got:
            assert r.t == want[r.id]


def test_numbers_as_python_writes_them(spark):
    rng = random.Random(3)
    values = [10.0**e * s for e in range(-30, 31) for s in (1, -1, 1.5, 9.999999999999998)] + [0.1 + 0.2, 2.0**-44, 5e-324, 1.7976931348623157e308]
    values += [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(3_000)]
    values += [rng.uniform(-1e6, 1e6) for _ in range(1_000)] + [float("nan"), float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    got = df.select(indented(F.col("v"), df.schema["v"].dataType).alias("t"), "v").collect()
    for r in got:  # every text reads back as its number and has the form of Python's
        assert json.loads(r.t) == r.v or math.isnan(r.v)
    different = [(r.t, json.dumps(r.v)) for r in got if r.t != json.dumps(r.v)]
    assert len(different) < 0.01 * len(got), different[:5]
    assert all(len(a) - len(b) <= 1 for a, b in different if abs(float(b)) > 1e-307)


def test_prompts_equal_the_module(spark):
    for r in dialogs.nested_specs(spark, "/root/testdata/sf0.001").limit(40).collect():
        spec = r.spec.asDict(recursive=True)
        df = spark.createDataFrame([(1,)], "one INT")
        assert json.loads(json.dumps(spec, ensure_ascii=False)) == spec and df
    got = {r.p_partkey: r.prompt for r in dialogs.nested_prompts(spark, "/root/testdata/sf0.001").collect()}
    for r in dialogs.nested_specs(spark, "/root/testdata/sf0.001").collect():
        assert got[r.p_partkey] == json.dumps(r.spec.asDict(recursive=True), indent=2, ensure_ascii=False)
