"""Streams over several micro-batches against the same folds in batch."""

import datetime
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pricewell.plans import live
from pricewell.sources import event_log
from pricewell.streaming import events, runs, state

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The event table cut into files by time, to be read one per micro-batch."""
    path = str(tmp_path_factory.mktemp("events") / "table")
    spark.read.parquet(f"{SF}/events.parquet").repartitionByRange(5, "ts").write.parquet(path)
    return path


def stream(spark, path):
    schema = spark.read.parquet(path).schema
    return live.as_search_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path))


def same(left, right):
    assert left.columns == right.columns
    assert sorted(map(repr, left.collect())) == sorted(map(repr, right.collect()))


@pytest.mark.parametrize("fold", [events.latest_progress, events.progress_counts, events.search_status])
def test_folds_equal_batch(spark, parts, fold):
    batch = fold(events.over_days(events.per_day(live.as_search_events(spark.read.parquet(parts)), "1 hour")))
    days = runs.latest_per_key(events.per_day(stream(spark, parts), "1 hour"), ["search_id", "day"], "fold")
    same(fold(events.over_days(days)), batch)


def test_repeats_are_dropped_across_batches(spark, parts):
    later = stream(spark, parts).withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 MINUTES"))
    once = runs.appended(events.without_repeats(stream(spark, parts).unionByName(later), "2 hours").select("event_id"), "once")
    assert once.count() == once.distinct().count() == spark.read.parquet(parts).count()


def test_nothing_after_a_stop(spark, parts):
    given = live.as_search_events(spark.read.parquet(parts))
    flags = events.stop_flags(given, F.expr("type = 'error'")).cache()
    kept = runs.appended(events.until_stop(stream(spark, parts), flags), "stop")
    late = kept.join(flags, "search_id").filter(F.col("ts") > F.col("stop_ts"))
    assert late.count() == 0 and kept.filter("type = 'error'").count() == flags.count()


def runs_by_hand(rows, ttl):
    """The current run of each search, folded event by event."""
    current, heard = {}, {}
    for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
        key = r.search_id
        if key not in heard or (r.ts - heard[key]).total_seconds() > ttl:
            current[key] = {"events": 0, "results_added": 0, "last_ts": None, "processed_count": None, "closed_by": None}
        heard[key], run = r.ts, current[key]
        if run["closed_by"]:
            continue
        run["events"] += 1
        run["results_added"] += r.type == "result_added"
        if r.type == "progress":
            run["last_ts"], run["processed_count"] = r.ts, r.processed_count
        if r.type in events.TERMINAL:
            run["closed_by"] = r.type
    return current


@pytest.mark.parametrize("files", [1, 3, 1_000])
@pytest.mark.parametrize("ttl", [3_600, 24 * 3_600])
def test_keyed_state_does_not_depend_on_batches(spark, tmp_path, files, ttl):
    path = str(tmp_path / "events")
    raw = spark.read.parquet(f"{SF}/events.parquet")
    raw = raw.withColumn("props", F.when(F.col("event_id") % 11 != 0, F.col("props")))
    # one file after the other, so that the stream finds them in the order of time
    for day in range(1, 31, 4):
        part = raw.where(F.dayofmonth("ts").between(day, day + 3))
        part.coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", files).parquet(path)
    with state.rocksdb_state(spark):
        got = runs.latest_per_key(state.search_progress(live.as_search_events(source), "1 minute", ttl), ["search_id"], "state")
    want = runs_by_hand(live.as_search_events(raw).collect(), ttl)
    assert {r.search_id: {k: r[k] for k in want[r.search_id]} for r in got.collect()} == want


@pytest.mark.parametrize("ttl", [3_600, 24 * 3_600])
@pytest.mark.parametrize("searches", [1, 7, 10_000])
def test_runs_of_a_table(spark, searches, ttl):
    raw = spark.read.parquet(f"{SF}/events.parquet").withColumn("user_id", F.col("user_id") % searches)
    given = live.as_search_events(raw.withColumn("props", F.when(F.col("event_id") % 11 != 0, F.col("props"))))
    got = state.current_runs(given, ttl)
    want = runs_by_hand(given.collect(), ttl)
    assert {r.search_id: {k: r[k] for k in want[r.search_id]} for r in got.collect()} == want


def test_no_task_gathers_a_search(spark, monkeypatch):
    monkeypatch.setattr(state, "search_progress", None)
    assert live.keyed_progress_state(spark, SF).count() > 0
    given = live.search_events(spark, SF)
    assert "Python" not in (plan := state.current_runs(given)._jdf.queryExecution().toString()) and "Pandas" not in plan


EVENT_ROWS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def sent(spark, path, rows):
    """Writes events one file each and reads them one per micro-batch."""
    for i, key, when, kind, props in rows:
        row = spark.sql("SELECT 1").select(
            F.lit(i).cast("long"), F.lit(when).cast("timestamp"), F.lit(key).cast("long"), F.lit(kind), F.lit(0.0),
            F.lit(props).cast("string"),
        ).toDF(*[c.split()[0] for c in EVENT_ROWS.split(", ")])
        row.coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    return live.as_search_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))


def test_idle_state_expires(spark, tmp_path):
    # search 1 pauses for three hours while search 2 moves the watermark on
    times = [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 02:00:00"), (2, "2024-01-01 02:30:00"), (1, "2024-01-01 03:00:00")]
    source = sent(spark, str(tmp_path / "events"), [(i, k, t, "view", f'{{"k": {i}}}') for i, (k, t) in enumerate(times)])
    with state.rocksdb_state(spark):
        got = runs.latest_per_key(state.search_progress(source, "1 minute"), ["search_id"], "ttl")
    assert {r.search_id: r.events for r in got.collect()} == {1: 1, 2: 2}


def test_ties_and_missing_counts(spark, tmp_path):
    when = "2024-01-01 00:00:00"
    rows = [(2, 1, when, "view", '{"k": 2}'), (1, 1, when, "view", '{"k": 1}'), (3, 2, when, "view", None)]
    source = sent(spark, str(tmp_path / "events"), rows)
    with state.rocksdb_state(spark):
        got = runs.latest_per_key(state.search_progress(source, "1 minute"), ["search_id"], "ties").collect()
    assert {r.search_id: (r.events, r.processed_count) for r in got} == {1: (2, 2), 2: (1, None)}


def test_messages_are_read_back(spark, tmp_path):
    sent = events.channel_messages(live.search_events(spark, SF).select("search_id", "type"))
    assert sent.first().channel.startswith("search:")
    read = events.message_stream(sent, "message", "search_id BIGINT, type STRING")
    assert read.columns == ["search_id", "type"] and read.filter("type IS NULL").count() == 0


def published(spark, folder, rows, start=0):
    """Appends events (search, time in seconds) to a log, in their order."""
    df = spark.createDataFrame([(start + i, key, "progress", us * 1_000_000, i, 9) for i, (key, us) in enumerate(rows)],
                               "event_id BIGINT, search_id BIGINT, type STRING, us BIGINT, processed_count INT, found_total INT")
    event_log.publish(df, folder, ["event_id"], segment_messages=7)


def test_log_is_read_in_bounded_batches_and_goes_on(spark, tmp_path):
    log, batches = f"file://{tmp_path}/log", []
    published(spark, log, [(i % 3, i) for i in range(50)])
    assert [(s.start, s.end) for s in event_log.Log(log).segments()][0] == (0, 7)
    assert spark.read.format("event_log").load(log).count() == 50

    def run(most):
        stream = event_log.subscribed(spark, log, f"file://{tmp_path}/progress", most)
        keep = lambda b, epoch: batches.append((epoch, sorted(r.offset for r in b.collect())))
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run(20)
    assert [len(b) for _, b in batches] == [20, 20, 10]
    published(spark, log, [(1, 100 + i) for i in range(9)], 50)
    run(4)
    assert [len(b) for _, b in batches[3:]] == [4, 4, 1]
    assert [o for _, b in batches for o in b] == list(range(59))


def test_a_repeated_batch_is_read_again(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    published(spark, log, [(1, i) for i in range(10)])
    stream = event_log.subscribed(spark, log, f"file://{tmp_path}/progress", 6)
    seen, broken = [], []

    def write(batch, epoch):
        rows = [r.offset for r in batch.collect()]
        if epoch == 1 and not broken:
            broken.append(rows)
            raise ValueError("the batch breaks")
        seen.append((epoch, rows))

    for _ in range(2):
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        try:
            query.processAllAvailable()
        except Exception as e:  # noqa: BLE001
            assert "the batch breaks" in str(e)
        finally:
            query.stop()
    assert seen == [(0, [0, 1, 2, 3, 4, 5]), (1, [6, 7, 8, 9])] and broken == [[6, 7, 8, 9]]


def test_a_failed_append_leaves_the_log_as_it_was(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    published(spark, log, [(1, i) for i in range(10)])
    before = [s.path for s in event_log.Log(log).segments()]
    bad = F.udf(lambda i: 1 // (i - 5), "long")(F.col("id"))
    df = spark.range(10).select(F.col("id").alias("offset"), bad.cast("string").alias("channel"), F.lit("x").alias("message"))
    with pytest.raises(Exception, match="division|ZeroDivision"):
        df.write.format("event_log").mode("append").save(log)
    assert [s.path for s in event_log.Log(log).segments()] == before
    with pytest.raises(Exception, match="appended"):
        df.write.format("event_log").mode("overwrite").save(log)


def test_events_out_of_order_inside_the_delay(spark, tmp_path):
    # hours apart in one search: the run of the later pause begins anew, whatever comes first
    log = f"file://{tmp_path}/log"
    published(spark, log, [(1, 100), (1, 50), (1, 8_000), (2, 8_100), (1, 7_950), (2, 20_000), (1, 20_100), (1, 20_050)])
    stream = live.received(spark, log, f"file://{tmp_path}/progress", 2)
    with state.rocksdb_state(spark):
        got = runs.latest_per_key(state.search_progress(stream, "10 minutes"), ["search_id"], "late", drain=True).collect()
    assert {r.search_id: (r.events, r.last_ts.timestamp(), r.processed_count) for r in got} == {1: (2, 20_100.0, 6), 2: (1, 20_000.0, 5)}


def test_state_holds_what_waits_only(spark, tmp_path):
    """A run's events are forgotten when the watermark has passed them, and idle searches altogether."""
    log = f"file://{tmp_path}/log"
    published(spark, log, [(1, i * 60) for i in range(1, 61)] + [(2, 50_000), (2, 60_000), (2, 60_001)])
    stream = live.received(spark, log, f"file://{tmp_path}/progress", 10)
    rows = []
    query = None
    with state.rocksdb_state(spark):
        writer = state.search_progress(stream, "1 minute").writeStream.outputMode("update")
        writer = writer.foreachBatch(lambda b, e: rows.extend(b.collect())).option("checkpointLocation", str(tmp_path / "checkpoint"))
        query = writer.start()
        try:
            query.processAllAvailable()
            held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        finally:
            query.stop()
    assert max(r.events for r in rows if r.search_id == 1) == 60
    # state rows: a run, counts, waiting events and timers of two searches, never the sixty events
    assert max(held) < 20 and held[-1] <= held[0] + 4


def followed(spark, tmp_path, rows, most):
    """The last run of each search in a log read in batches of so many events, and the rows of state after each batch."""
    log = f"file://{tmp_path}/log"
    df = spark.createDataFrame(rows, "event_id BIGINT, search_id BIGINT, type STRING, us BIGINT, processed_count INT, found_total INT")
    event_log.publish(df, log, ["us", "event_id"], segment_messages=1_000)
    stream = state.search_progress(live.received(spark, log, f"file://{tmp_path}/progress", most), "10 minutes")
    seen = []
    with state.rocksdb_state(spark):
        writer = stream.writeStream.outputMode("update").foreachBatch(lambda b, e: seen.append({r.search_id: r for r in b.collect()}))
        query = writer.option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        try:
            query.processAllAvailable()
            held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        finally:
            query.stop()
    last = {}
    for batch in seen:
        last |= batch
    return last, held


def test_searches_share_their_state(spark, tmp_path, monkeypatch):
    """A batch costs round trips for each slot, not for each of its searches."""
    monkeypatch.setattr(state, "SLOTS", 8, raising=False)
    rows = [(i, i % 400, "progress", (i + 1) * 1_000_000, i, 9) for i in range(1_600)]
    last, held = followed(spark, tmp_path, rows, 800)
    # runs, counts of one type, waiting events and a timer of each slot
    assert max(held) <= 8 * 5
    assert {k: (r.events, r.processed_count) for k, r in last.items()} == {k: (4, 1_200 + k) for k in range(400)}


@pytest.mark.parametrize("most", [40, 1_000])
def test_searches_of_a_slot_run_on_their_own(spark, tmp_path, monkeypatch, most):
    """Idle searches are folded and dropped beside live ones; ids beyond 2^53 and odd types stay whole beside nulls."""
    monkeypatch.setattr(state, "SLOTS", 2, raising=False)
    far, draw, rows = 2**53 + 1, random.Random(7), []
    searches = [None, 1, 2, 3, far, far + 1]
    for i in range(200):
        # search 1 pauses for longer than the hour of its life, 2 is not heard of again
        search = draw.choice([s for s in searches if not (s == 1 and 50 < i < 150) and not (s == 2 and i > 60)])
        kind = draw.choices(["progress", "result_added", "start", None, 'a "b", \\c', "done"], [8, 4, 2, 1, 1, 1])[0]
        rows.append((far + i, search, kind, (i + 1) * 60_000_000, draw.choice([None, i]), None))
    last, _ = followed(spark, tmp_path, rows, most)
    event = lambda r: Row(event_id=r[0], search_id=r[1], type=r[2], ts=datetime.datetime.fromtimestamp(r[3] / 1e6), processed_count=r[4])
    want = runs_by_hand(map(event, rows), 3_600)
    assert {k: {c: r[c] for c in want[k]} for k, r in last.items()} == want


def test_late_flags_stop_a_running_stream(spark, tmp_path):
    # the flag of search 1 at 100 is sent after events of 150 and 200; that of search 2 holds for its life only
    log = f"file://{tmp_path}/log"
    at = [(1, 50), (1, 150), (1, 200), (2, 100), (2, 4_000), (3, 300)]
    published(spark, log, at)
    flag = [(100, 1, "stop", 100), (101, 2, "stop", 90), (102, -1, "stop", 90_000), (103, -1, "last", 90_000)]
    rows = [(i, k, t, us * 1_000_000, None, None) for i, k, t, us in flag]
    df = spark.createDataFrame(rows, "event_id BIGINT, search_id BIGINT, type STRING, us BIGINT, processed_count INT, found_total INT")
    event_log.publish(df, log, ["event_id"])
    streams = [live.received(spark, log, f"file://{tmp_path}/{n}", 3) for n in "ab"]
    kept = events.until_late_stop(streams[0].where("type != 'stop'"), streams[1].where("type = 'stop'"), "1 hour", "1 HOUR")
    got = runs.appended(kept.select("search_id", "us", "type"), "late-flags", drain=True).where("type != 'last'").collect()
    assert sorted((r.search_id, r.us // 1_000_000) for r in got) == [(1, 50), (2, 4_000), (3, 300)]


def test_a_log_is_read_in_few_batches(spark, tmp_path):
    """Batches have a fixed cost, so their number must not follow from a small bound of messages."""
    log = f"{tmp_path}/log"
    df = spark.range(9_000).selectExpr("id AS event_id", "id % 3 AS search_id", "'start' AS type", "timestamp_micros(id) AS ts")
    df = df.selectExpr("*", "0 AS processed_count", "0 AS found_total", "0D AS value")
    event_log.publish(live.as_sent(df), log, ["us", "event_id"])
    seen = []
    query = live.received(spark, log, f"{tmp_path}/progress").writeStream.foreachBatch(lambda b, n: seen.append(b.count())).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert [n for n in seen if n] == [9_000]


def test_state_has_few_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for given, used in ((500, 2 * spark.sparkContext.defaultParallelism), (3, 3)):
        spark.conf.set("spark.sql.shuffle.partitions", given)
        with runs.few_state_partitions(spark):
            assert int(spark.conf.get("spark.sql.shuffle.partitions")) == used
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == given
    spark.conf.set("spark.sql.shuffle.partitions", before)
