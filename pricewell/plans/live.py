"""Streaming queries over the event table, and the sinks."""

from __future__ import annotations

from contextlib import suppress
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.operators import joins, reports
from pricewell.plans.listings import request_snapshot, results_and_fresh
from pricewell.plans.output import shown
from pricewell.plans.registry import Registry
from pricewell.plans.selection import key_rows_of, result_rows
from pricewell.plans.sql_views import with_views
from pricewell.schemas import CONTRACT_RESULTS
from pricewell.session import materialized, scratch_dir
from pricewell.sources import event_log, sinks, snapshots, tables
from pricewell.streaming import events, runs, state

query = Registry()

# The sample's event types in terms of a search.
EVENT_TYPES = {"signup": "start", "view": "progress", "click": "result_added", "purchase": "done", "error": "error"}
FOUND_TOTAL = 100
AS_OF = "2024-01-30 23:30:00"


def as_search_events(raw: DataFrame) -> DataFrame:
    """Sample events, batch or stream, as events of the search named by their user."""
    kind = F.col("event_type")
    for given, name in EVENT_TYPES.items():
        kind = F.when(F.col("event_type") == given, F.lit(name)).otherwise(kind)
    return raw.select(
        "event_id",
        F.col("user_id").alias("search_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        kind.alias("type"),
        F.get_json_object("props", "$.k").cast("int").alias("processed_count"),
        F.lit(FOUND_TOTAL).alias("found_total"),
        F.concat(F.lit("Processing contract "), F.get_json_object("props", "$.k")).alias("status"),
        "value",
    )


def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_search_events(tables.table(spark, sf_dir, "events"))


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_search_events(events.event_stream(spark, f"{sf_dir}/events.parquet"))


_EVENTS = """WITH e AS (SELECT event_id, user_id AS search_id, ts, value,
  CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'progress' WHEN 'click' THEN 'result_added'
    WHEN 'purchase' THEN 'done' ELSE 'error' END AS type,
  json_extract_string(props, '$.k')::BIGINT AS k FROM events)"""
_TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
_LATEST = f"""SELECT search_id, {_TS.format('ts')} AS ts, k AS processed_count, {FOUND_TOTAL}::BIGINT AS found_total,
  'Processing contract ' || k AS status, k / {FOUND_TOTAL}.0 * 100.0 AS percentage FROM e WHERE type = 'progress'
  QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY e.ts DESC, event_id DESC) = 1"""


def folded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folds of all searches from the event stream."""
    days = runs.latest_per_key(events.per_day(streamed_events(spark, sf_dir), "1 hour"), ["search_id", "day"], "days")
    return events.over_days(days)


@query("progress_latest", f"{_EVENTS} {_LATEST}")
def progress_latest(spark, sf_dir):
    return shown(events.latest_progress(folded_events(spark, sf_dir)))


@query(
    "progress_counts",
    f"""{_EVENTS} SELECT search_id, count(*) AS events, count(CASE WHEN type = 'result_added' THEN 1 END)
      AS results_added, {FOUND_TOTAL}::BIGINT AS found_total, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS runtime_ms
    FROM e GROUP BY search_id""",
)
def progress_counts(spark, sf_dir):
    return shown(events.progress_counts(folded_events(spark, sf_dir)))


_STATUS = """SELECT search_id, CASE min_by(type, (ts, event_id)) FILTER (type IN ('done', 'error')) WHEN 'done' THEN 'DONE'
      WHEN 'error' THEN 'ERROR' ELSE 'RUNNING' END AS status, min(ts) FILTER (type IN ('done', 'error')) AS closed,
    max(ts) AS last_ts, count(*) FILTER (type IN ('done', 'error')) AS terminal_events FROM e GROUP BY search_id"""


@query(
    "terminal_status",
    f"""{_EVENTS} SELECT search_id, status, {_TS.format('closed')} AS closed_at, CAST(last_ts > closed AS VARCHAR)
      AS continued, terminal_events FROM ({_STATUS})""",
)
def terminal_status(spark, sf_dir):
    return shown(events.search_status(folded_events(spark, sf_dir)))


_STOP = "type = 'error' AND value > 50"


@query(
    "stopped_excluded",
    f"""{_EVENTS}, stops AS (SELECT search_id, min(ts) AS stop_ts FROM e WHERE {_STOP} GROUP BY search_id)
    SELECT event_id, e.search_id, type FROM e LEFT JOIN stops s ON e.search_id = s.search_id
    WHERE stop_ts IS NULL OR ts <= stop_ts""",
)
def stopped_excluded(spark, sf_dir):
    """The event stream against the table of stop flags: nothing after a search's stop."""
    flags = events.stop_flags(search_events(spark, sf_dir), F.expr(_STOP))
    stream = events.until_stop(streamed_events(spark, sf_dir), flags).select("event_id", "search_id", "type")
    return runs.appended(stream, "stopped-excluded")


@query(
    "running_not_stopped",
    f"""{_EVENTS} SELECT DISTINCT search_id FROM e WHERE search_id NOT IN
      (SELECT search_id FROM e WHERE type = 'error' AND value > 150)""",
)
def running_not_stopped(spark, sf_dir):
    """Searches without a stop flag."""
    given = search_events(spark, sf_dir)
    flags = events.stop_flags(given, F.expr("type = 'error' AND value > 150"))
    return joins.without_stopped(given.select("search_id").distinct(), flags.select("search_id"), "search_id")


@query(
    "ttl_live_keys",
    f"""{_EVENTS}, latest AS ({_LATEST.replace(_TS.format('ts') + ' AS ts', 'e.ts AS ts')})
    SELECT search_id, {_TS.format('ts')} AS ts, processed_count, found_total, status, percentage FROM latest
    WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR""",
)
def ttl_live_keys(spark, sf_dir):
    """Latest progress that is still alive one hour later."""
    latest = events.latest_progress(folded_events(spark, sf_dir))
    return shown(events.live_progress(latest, F.lit(AS_OF).cast("timestamp")))


@query("stream_dedupe", "SELECT event_id, user_id AS search_id FROM events")
def stream_dedupe(spark, sf_dir):
    """The event stream and its repeats half an hour later, each event kept once; ids are kept for two hours."""
    sent = streamed_events(spark, sf_dir)
    repeats = streamed_events(spark, sf_dir).withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 MINUTES"))
    once = events.without_repeats(sent.unionByName(repeats), "2 hours").select("event_id", "search_id")
    return runs.appended(once, "stream-dedupe")


@query(
    "event_messages",
    f"""{_EVENTS} SELECT 'search:' || search_id || ':events' AS channel, event_id, type FROM e""",
)
def event_messages(spark, sf_dir):
    """Events published as JSON messages per channel and read back."""
    stream = events.channel_messages(streamed_events(spark, sf_dir).select("event_id", "search_id", "type"))
    sent = runs.appended(stream, "event-messages")
    parsed = F.from_json("message", "event_id BIGINT, type STRING").alias("m")
    return sent.select("channel", parsed).select("channel", "m.*")


# A search idle for longer than this begins a new run.
RUN_TTL_SECONDS = 24 * 3600
_RUNS = f"""gaps AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY search_id ORDER BY ts, event_id))
      > {RUN_TTL_SECONDS * 1_000_000}, false)::INT AS starts FROM e),
    numbered AS (SELECT *, sum(starts) OVER (PARTITION BY search_id ORDER BY ts, event_id) AS run FROM gaps),
    current AS (SELECT * FROM numbered QUALIFY run = max(run) OVER (PARTITION BY search_id)),
    closing AS (SELECT search_id, min(ts) AS closed_ts, min_by(event_id, (ts, event_id)) AS closed_event,
      min_by(type, (ts, event_id)) AS closed_by FROM current WHERE type IN ('done', 'error') GROUP BY search_id),
    counted AS (SELECT c.*, closed_ts, closed_by FROM current c LEFT JOIN closing k ON c.search_id = k.search_id
      WHERE closed_ts IS NULL OR (c.ts, c.event_id) <= (closed_ts, closed_event))"""


@query(
    "keyed_progress_state",
    f"""{_EVENTS}, {_RUNS}
    SELECT search_id, count(*) AS events, count(CASE WHEN type = 'result_added' THEN 1 END) AS results_added,
      {_TS.format("max(ts) FILTER (type = 'progress')")} AS last_ts,
      max_by(k, (ts, event_id)) FILTER (type = 'progress') AS processed_count,
      CASE WHEN count(*) FILTER (type = 'progress') > 0 THEN {FOUND_TOTAL}::BIGINT END AS found_total,
      {_TS.format('any_value(closed_ts)')} AS closed_ts, any_value(closed_by) AS closed_by
    FROM counted GROUP BY search_id""",
)
def keyed_progress_state(spark, sf_dir):
    """The current run of each search: closed by its first end, begun anew after a day of silence."""
    stream = streamed_events(spark, sf_dir).select("search_id", "event_id", "type", "ts", "processed_count", "found_total")
    return shown(state.current_runs(runs.appended(stream, "keyed-progress"), RUN_TTL_SECONDS))


# ---------------------------------------------------------------- the event log


# Messages that a stream takes from the log at once: enough that the fixed cost of a batch is small beside its work.
BATCH_MESSAGES = event_log.MAX_MESSAGES
# How an event is sent; its time in microseconds.
SENT = "event_id BIGINT, search_id BIGINT, type STRING, us BIGINT, processed_count INT, found_total INT, value DOUBLE"


def as_sent(given: DataFrame) -> DataFrame:
    return given.withColumn("us", F.unix_micros("ts")).select(*[part.split()[0] for part in SENT.split(", ")])


def received(spark: SparkSession, folder: str, progress: str, most: int = BATCH_MESSAGES) -> DataFrame:
    """The events of a log as a stream."""
    messages = event_log.subscribed(spark, folder, progress, most)
    got = messages.select("offset", "channel", F.from_json("message", SENT).alias("e")).select("offset", "channel", "e.*")
    return got.withColumn("ts", F.timestamp_micros("us"))


@query(
    "event_log_read",
    f"""{_EVENTS} SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS "offset", 'search:' || search_id || ':events' AS channel,
      event_id, type, {_TS.format('ts')} AS ts FROM e""",
)
def event_log_read(spark, sf_dir):
    """Events published in two parts and read in bounded batches, by a stream that stops between the parts and goes on."""
    out = scratch_dir(spark, "event-log")
    given = search_events(spark, sf_dir)
    middle = given.agg(F.timestamp_micros(F.avg(F.unix_micros("ts")).cast("bigint"))).first()[0]
    got = None
    for part in (F.col("ts") <= F.lit(middle), F.col("ts") > F.lit(middle)):
        event_log.publish(as_sent(given.where(part)), f"{out}/log", ["us", "event_id"])
        stream = received(spark, f"{out}/log", f"{out}/progress").select("offset", "channel", "event_id", "type", "ts")
        got = runs.appended(stream, "event-log", f"{out}/read", drain=True)
    return shown(got)


@query(
    "live_search_runs",
    f"""{_EVENTS}, {_RUNS}
    SELECT search_id, count(*) AS events, count(CASE WHEN type = 'result_added' THEN 1 END) AS results_added,
      {_TS.format("max(ts) FILTER (type = 'progress')")} AS last_ts,
      max_by(k, (ts, event_id)) FILTER (type = 'progress') AS processed_count,
      CASE WHEN count(*) FILTER (type = 'progress') > 0 THEN {FOUND_TOTAL}::BIGINT END AS found_total,
      {_TS.format('any_value(closed_ts)')} AS closed_ts, any_value(closed_by) AS closed_by
    FROM counted GROUP BY search_id""",
)
def live_search_runs(spark, sf_dir):
    """The current run of each search, followed by keyed state with timers over bounded batches of the event log."""
    out = scratch_dir(spark, "live-runs")
    event_log.publish(as_sent(search_events(spark, sf_dir)), f"{out}/log", ["us", "event_id"])
    stream = state.search_progress(received(spark, f"{out}/log", f"{out}/progress"), "1 hour", RUN_TTL_SECONDS)
    with state.rocksdb_state(spark):
        return shown(runs.latest_per_key(stream, ["search_id"], "live-runs", f"{out}/state", drain=True))


# How much later than an event of its time a stop flag is sent, and how long it holds.
FLAG_DELAY = "45 MINUTES"
FLAG_LIFE = "2 DAYS"


@query(
    "stopped_while_running",
    f"""{_EVENTS}, stops AS (SELECT search_id AS stopped, ts AS stop_ts FROM e WHERE {_STOP})
    SELECT event_id, search_id, type FROM e WHERE NOT EXISTS (SELECT 1 FROM stops
      WHERE stopped = search_id AND stop_ts < ts AND stop_ts >= ts - INTERVAL {FLAG_LIFE})""",
)
def stopped_while_running(spark, sf_dir):
    """Events and stop flags as two streams of one log, on which a flag comes after events that it stops."""
    out = scratch_dir(spark, "stops")
    given = search_events(spark, sf_dir).withColumn("sent", F.col("ts"))
    flags = given.where(_STOP).withColumn("type", F.lit("stop")).withColumn("sent", F.col("ts") + F.expr(f"INTERVAL {FLAG_DELAY}"))
    # a last event and flag of no search move the watermarks on, so that nothing is left waiting
    last = given.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    ends = [last.select(F.lit(None).cast("bigint").alias("event_id"), F.lit(-1).cast("bigint").alias("search_id"), "ts", F.lit(t).alias("type")) for t in ("last", "stop")]
    ends = [e.withColumn("sent", F.col("ts")) for e in ends]
    everything = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [given, flags, *ends])
    sent = everything.select("*", F.unix_micros("ts").alias("us"), F.unix_micros("sent").alias("sent_us"))
    columns = [part.split()[0] for part in SENT.split(", ")]
    event_log.publish(sent.select(*columns, "sent_us"), f"{out}/log", ["sent_us", "event_id"])
    stream = lambda name: received(spark, f"{out}/log", f"{out}/{name}")
    kept = events.until_late_stop(stream("events").where("type != 'stop'"), stream("flags").where("type = 'stop'"), "1 hour", FLAG_LIFE)
    kept = runs.appended(kept.select("event_id", "search_id", "type"), "stops", f"{out}/kept", drain=True)
    return kept.where("type != 'last'")  # not in the stream, where the filter would go before the watermark


@query(
    "stop_flags_live",
    f"""{_EVENTS} SELECT search_id, {_TS.format('min(ts)')} AS stop_ts FROM e WHERE type = 'error' AND value > 20
    GROUP BY search_id HAVING min(ts) > TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 4 DAY""",
)
def stop_flags_live(spark, sf_dir):
    """Stop flags that are still alive after four days."""
    flags = events.stop_flags(search_events(spark, sf_dir), F.expr("type = 'error' AND value > 20"))
    return shown(events.live_flags(flags, F.lit("2024-01-10 00:00:00").cast("timestamp"), 4 * 24 * 3600))


# ---------------------------------------------------------------- sinks


# The result columns as text, and the raw record of a contract line.
_RAW = """'{"contract_info":{"reestr_number":"' || registry_no || '","customer":"' || customer || '","supplier":"' || supplier
  || '"},"comparison_result":{"score":' || ai_score || ',"match_type":"' || match_type || '"}}'"""


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the processed contracts, with their raw data."""
    raw = F.to_json(
        F.struct(
            F.struct(F.col("registry_no").alias("reestr_number"), "customer", "supplier").alias("contract_info"),
            F.struct(F.col("ai_score").alias("score"), "match_type").alias("comparison_result"),
        ),
        {"ignoreNullFields": "false"},
    )
    return result_rows(spark, sf_dir).withColumn("raw_data_json", raw)


@query(
    "results_written",
    with_views(
        f"""SELECT regexp_replace(md5(f.search_id || '/' || f.contract_id), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$',
            '\\1-\\2-\\3-\\4-\\5') AS id, f.search_id, registry_no AS reestr_number, contract_url,
          CAST(sign_date AS VARCHAR) AS sign_date, CAST(unit_price AS DOUBLE) AS unit_price, currency, match_type,
          ai_score::BIGINT AS ai_score, target_manufacturer AS manufacturer_target, manufacturer AS manufacturer_found,
          CAST(manufacturer_match AS VARCHAR) AS manufacturer_match, CAST(is_recent AS VARCHAR) AS is_2025_plus,
          CAST(s.contract_id IS NOT NULL AS VARCHAR) AS accepted_for_nmc, {_RAW} AS raw_data_json,
          strftime(created_date, '%Y-%m-%d') || ' 00:00:00.000000' AS created_at, 3::BIGINT AS rows
        FROM scored_fresh f LEFT JOIN (SELECT search_id, contract_id FROM selected) s
          ON f.search_id = s.search_id AND f.contract_id = s.contract_id""",
        "selected",
    ),
)
def results_written(spark, sf_dir):
    """Result records and their rows written as partitioned tables and read back."""
    out = scratch_dir(spark, "results")
    sinks.write_results(stored_results(spark, sf_dir), key_rows_of(spark, sf_dir), out)
    rows = spark.read.parquet(f"{out}/spec_comparison_rows").groupBy(F.col("contract_result_id").alias("id")).agg(
        F.count("*").alias("rows")
    )
    return shown(spark.read.parquet(f"{out}/contract_results").join(rows, "id"))


STORED = CONTRACT_RESULTS.replace(" NOT NULL", "")
RESULT_KEYS = ["search_id", "reestr_number"]


class Broken(Exception):
    """A task that ends in the middle of a batch."""


def _break() -> None:
    raise Broken


@query(
    "results_upserted",
    with_views(
        """SELECT search_id, registry_no AS reestr_number, contract_url, CAST(unit_price AS DOUBLE) AS unit_price, match_type,
          CASE WHEN length(registry_no) % 2 = 0 THEN 100 - ai_score ELSE ai_score END::BIGINT AS ai_score,
          CASE WHEN length(registry_no) % 2 = 0 THEN 3 ELSE 1 END::BIGINT AS version FROM scored_fresh""",
        "scored_fresh",
    ),
)
def results_upserted(spark, sf_dir):
    """Results stored, stored again by a repeated task, broken off in the middle, and partly replaced: one row each."""
    out = scratch_dir(spark, "upserted")
    records = materialized(sinks.result_records(stored_results(spark, sf_dir)), "records")
    order = [F.asc("id")]
    again = records.where(F.length("reestr_number") % 2 == 0).withColumn("ai_score", 100 - F.col("ai_score"))
    for _ in range(2):
        snapshots.upsert(records.unionByName(records), out, 1, RESULT_KEYS, order)
    with suppress(Broken):
        snapshots.upsert(records.withColumn("ai_score", F.lit(-1)), out, 2, RESULT_KEYS, order, before_commit=_break)
    snapshots.upsert(again, out, 3, RESULT_KEYS, order)
    rows = snapshots.snapshot(spark, out, RESULT_KEYS, STORED)
    return shown(rows, *RESULT_KEYS, "contract_url", "unit_price", "match_type", "ai_score", "version")


@query(
    "report_exported",
    f"""SELECT 'detail' AS sheet, count(*) AS rows, 0::BIGINT AS csv_differences, 0::BIGINT AS json_differences
      FROM ({with_views('SELECT * FROM candidates', 'candidates')})
    UNION ALL SELECT 'summary', 22 * count(*), 0, 0 FROM ({with_views('SELECT * FROM requests', 'requests')})
    UNION ALL SELECT 'comparison', 3 * count(*), 0, 0 FROM ({with_views('SELECT * FROM selected', 'selected')})""",
)
def report_exported(spark, sf_dir):
    """The three sheets written as csv and json and read back: the rows that differ from what was written."""
    results, fresh = results_and_fresh(spark, sf_dir)
    sheets = {
        "summary": reports.summary_rows(request_snapshot(spark, sf_dir, results), reports.result_counts(results)),
        "detail": reports.detail_rows(results),
        "comparison": reports.comparison_rows(
            result_rows(spark, sf_dir, fresh), key_rows_of(spark, sf_dir, fresh), ["search_id", "contract_id"]
        ),
    }
    out = scratch_dir(spark, "report")
    # computed once, into a table; the exports read from there
    sinks.write_report(sheets, f"{out}/parquet", "parquet")
    compared = []
    for name in sheets:
        sheet = spark.read.parquet(f"{out}/parquet/{name}")
        for kind in ("csv", "json"):
            sinks.write_report({name: sheet}, f"{out}/{kind}", kind)
        read = lambda: spark.read.schema(sheet.schema)  # noqa: B023, E731
        as_csv = read().option("header", True).option("escape", '"').option("multiLine", True).csv(f"{out}/csv/{name}")
        as_json = read().json(f"{out}/json/{name}")
        compared.append(_differences(sheet, {"csv": as_csv, "json": as_json}, name))
    return reduce(DataFrame.unionByName, compared)


def _differences(sheet: DataFrame, copies: dict[str, DataFrame], name: str) -> DataFrame:
    """Rows of a sheet, and how many are missing or added in each copy; null and empty texts are told apart in none."""

    def hashed(df: DataFrame, sign: int, kind: str | None) -> DataFrame:
        text = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in sheet.columns])
        weights = [F.lit(sign if kind in (None, k) else 0).alias(k) for k in copies]
        return df.select(F.unhex(F.sha2(text, 256)).alias("row"), F.lit(int(kind is None)).alias("given"), *weights)

    parts = [hashed(sheet, 1, None), *[hashed(copy, -1, kind) for kind, copy in copies.items()]]
    by_row = reduce(DataFrame.unionByName, parts).groupBy("row").agg(
        F.sum("given").alias("given"), *[F.abs(F.sum(k)).alias(k) for k in copies]
    )
    counts = by_row.agg(F.sum("given").alias("rows"), *[F.sum(k).alias(f"{k}_differences") for k in copies])
    return counts.select(F.lit(name).alias("sheet"), "rows", *[f"{k}_differences" for k in copies])
