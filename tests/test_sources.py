"""Tables updated in place, and good rows apart from rejects."""

import pytest
from pyspark.sql import functions as F

from pricewell.operators import synonyms
from pricewell.sources import quarantine, snapshots

DDL = "search STRING, no STRING, score INT"
KEYS = ["search", "no"]


def rows_of(spark, *rows):
    return spark.createDataFrame(rows, DDL)


def now(spark, path, **where):
    return sorted((tuple(r) for r in snapshots.snapshot(spark, path, KEYS, DDL, **where).collect()), key=str)


def test_batches_repeated_broken_and_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    put = lambda version, *rows, **more: snapshots.upsert(rows_of(spark, *rows), path, version, KEYS, [F.asc("score")], **more)
    assert now(spark, path) == []
    assert put(1, ("s", "1", 5), ("s", "1", 4), ("s", "2", 6), ("t", "1", 7))
    assert not put(1, ("s", "1", 0), ("x", "x", 0))
    assert now(spark, path) == [("s", "1", 4, 1), ("s", "2", 6, 1), ("t", "1", 7, 1)]

    def broken():
        raise KeyError("lost")

    with pytest.raises(KeyError):
        put(2, ("s", "1", 99), ("lost", "1", 99), before_commit=broken)
    assert now(spark, path) == [("s", "1", 4, 1), ("s", "2", 6, 1), ("t", "1", 7, 1)]
    # the next try writes other searches: nothing of the broken one is left
    assert put(2, ("s", "2", 60), ("u", "1", 8))
    assert now(spark, path) == [("s", "1", 4, 1), ("s", "2", 60, 2), ("t", "1", 7, 1), ("u", "1", 8, 2)]
    # a later version can be committed before an earlier one
    assert put(5, ("t", "1", 50)) and put(4, ("t", "1", 40), ("v", "1", 4))
    assert now(spark, path)[2:] == [("t", "1", 50, 5), ("u", "1", 8, 2), ("v", "1", 4, 4)]
    assert now(spark, path, first_key="t") == [("t", "1", 50, 5)]


def test_compaction_and_null_keys(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    for version in (1, 2, 3):
        snapshots.upsert(rows_of(spark, ("s", str(version), version), ("s", None, version)), path, version, KEYS, [F.asc("score")])
    before = [r[:3] for r in now(spark, path)]
    assert before == [("s", "1", 1), ("s", "2", 2), ("s", "3", 3), ("s", None, 3)]
    assert snapshots.compacted(spark, path, KEYS, DDL) == 4 and snapshots.committed(spark, path) == [4]
    assert [r[:3] for r in now(spark, path)] == before
    assert snapshots.compacted(spark, path, KEYS, DDL) is None
    assert not snapshots.upsert(rows_of(spark, ("s", "1", 9)), path, 2, KEYS, [F.asc("score")])
    assert snapshots.upsert(rows_of(spark, ("s", "1", 9)), path, 6, KEYS, [F.asc("score")])
    assert ("s", "1", 9, 6) in now(spark, path)
    with pytest.raises(ValueError):
        snapshots.upsert(rows_of(spark), path, 0, KEYS, [F.asc("score")])


def rules():
    return {"no number": F.col("no").isNull(), "negative": F.col("score") < 0}


def test_rejects_with_all_their_reasons(spark, tmp_path):
    df = rows_of(spark, ("s", "1", 5), ("s", None, 4), ("t", None, -1), ("u", "2", None))
    counts = quarantine.write_judged(df, rules(), str(tmp_path / "out"))
    assert counts == {"rows": 4, "rejects": 2, "rule: no number": 2, "rule: negative": 1}
    good, rejects = quarantine.read_judged(spark, str(tmp_path / "out"), DDL)
    assert sorted(map(tuple, good.collect())) == [("s", "1", 5), ("u", "2", None)]
    assert sorted((r.search, r.reasons) for r in rejects.collect()) == [("s", ["no number"]), ("t", ["no number", "negative"])]
    empty = quarantine.write_judged(df.limit(0), rules(), str(tmp_path / "none"))
    assert set(empty.values()) == {0}
    assert [x.count() for x in quarantine.read_judged(spark, str(tmp_path / "none"), DDL)] == [0, 0]


def test_the_input_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(100).selectExpr("'s' AS search", "CAST(id AS STRING) AS no", "CAST(id - 50 AS INT) AS score")
    assert quarantine.write_judged(df.mapInArrow(watch, DDL), rules(), str(tmp_path / "out"))["rejects"] == 50
    assert seen.value == 100


def test_rejects_of_a_stream(spark, tmp_path):
    for i in range(3):
        rows_of(spark, ("s", str(i), i - 1), ("t", None, i)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    told = []
    path = quarantine.stream_judged(stream, rules(), "judged", lambda epoch, counts: told.append((epoch, counts["rows"], counts["rejects"])))
    good, rejects = quarantine.read_judged(spark, path, DDL)
    assert good.count() == 2 and rejects.count() == 4
    assert [t[0] for t in told] == [0, 1, 2] and sum(t[1] for t in told) == 6 and sum(t[2] for t in told) == 4


def test_synonyms_close_over_chains(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(100)]
    pairs = [*chain[::-1], (" B ", "a"), ("c", "b"), ("x", "x"), ("y", None), ("", "z"), ("C", "D")]
    known = synonyms.groups(spark.createDataFrame(pairs, "one STRING, other STRING"), "one", "other")
    got = {r.name: r.canonical for r in known.collect()}
    assert got == {**{f"n{i:03d}": "n000" for i in range(101)}, "a": "a", "b": "a", "c": "a", "d": "a", "x": "x"}
    names = spark.createDataFrame([("D ",), ("other",), (None,)], "spec STRING")
    assert [tuple(r) for r in synonyms.with_canonical(names, "spec", known).orderBy("spec").collect()] == [(None, None), ("D ", "a"), ("other", "other")]
    none = synonyms.groups(spark.createDataFrame([], "one STRING, other STRING"), "one", "other")
    assert none.collect() == []
