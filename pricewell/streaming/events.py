"""The event stream of searches and its folds.

Every fold is a built-in aggregate, so a task sends at most one row per search through
the shuffle, however many events one search has. On a stream a fold is taken by day
(``per_day``): the state of a day is dropped when the watermark has passed it, so it does not
grow with the age of the stream. The days of a search are put together by ``over_days``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.functions.text import percent
from pricewell.schemas import STATE_TTL_SECONDS

# What ends a search, and the status it ends with.
TERMINAL = {"done": "DONE", "error": "ERROR", "stopped": "STOPPED"}
RUNNING = "RUNNING"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table of events as a stream, be it a folder of files or one file.

    A stream reads a single file only through a pattern, so the path is given as one.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def message_stream(raw: DataFrame, text: str, schema: str) -> DataFrame:
    """Events out of JSON messages (a Kafka value, a line of a file)."""
    return raw.select(F.from_json(text, schema).alias("e")).select("e.*")


def per_day(events: DataFrame, delay: str) -> DataFrame:
    """The fold of each search and day; ``delay`` is how late events may come."""
    kind = F.col("type")
    terminal = kind.isin(*TERMINAL)
    progress = F.struct("ts", "event_id", "processed_count", "found_total", "status")
    return (
        events.withWatermark("ts", delay)
        .groupBy("search_id", F.window("ts", "1 day").alias("day"))
        .agg(
            F.max(F.when(kind == "progress", progress)).alias("latest"),
            F.count("*").alias("events"),
            F.count_if(kind == "result_added").alias("results_added"),
            F.max("found_total").alias("found_total"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.min(F.when(terminal, F.struct("ts", "event_id", "type"))).alias("closing"),
            F.count_if(terminal).alias("terminal_events"),
        )
        .withColumn("day", F.col("day.start"))
    )


def over_days(days: DataFrame) -> DataFrame:
    """The fold of each search over its days."""
    return days.groupBy("search_id").agg(
        F.max("latest").alias("latest"),
        F.sum("events").alias("events"),
        F.sum("results_added").alias("results_added"),
        F.max("found_total").alias("found_total"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.min("closing").alias("closing"),
        F.sum("terminal_events").alias("terminal_events"),
    )


def latest_progress(folds: DataFrame) -> DataFrame:
    """The last progress of each search: processed, total, status text and percentage."""
    latest = folds.filter(F.col("latest").isNotNull()).select("search_id", "latest.*").drop("event_id")
    return latest.withColumn("percentage", percent(F.col("processed_count"), F.col("found_total")))


def progress_counts(folds: DataFrame) -> DataFrame:
    """Counts per search: events, results added, largest stated total, run time so far."""
    millis = F.unix_millis("last_ts") - F.unix_millis("first_ts")
    return folds.select("search_id", "events", "results_added", "found_total", millis.alias("runtime_ms"))


def search_status(folds: DataFrame) -> DataFrame:
    """Status of each search: its first terminal event closes it, without one it runs."""
    status = F.lit(RUNNING)
    for kind, name in TERMINAL.items():
        status = F.when(F.col("closing.type") == kind, F.lit(name)).otherwise(status)
    return folds.select(
        "search_id",
        status.alias("status"),
        F.col("closing.ts").alias("closed_at"),
        # anything sent after the closing event is no valid transition
        (F.col("last_ts") > F.col("closing.ts")).alias("continued"),
        "terminal_events",
    )


def stop_flags(events: DataFrame, stop: Column) -> DataFrame:
    """The first stop of each search."""
    return events.filter(stop).groupBy("search_id").agg(F.min("ts").alias("stop_ts"))


def live_flags(flags: DataFrame, as_of: Column, seconds: int = STATE_TTL_SECONDS) -> DataFrame:
    """Stop flags not older than their time to live."""
    return flags.filter(F.unix_micros("stop_ts") > F.unix_micros(as_of) - F.lit(seconds * 1_000_000))


def until_stop(events: DataFrame, flags: DataFrame) -> DataFrame:
    """Events of each search up to its stop; works on a stream against a static flag table."""
    joined = events.join(flags, "search_id", "left")
    return joined.filter(F.col("stop_ts").isNull() | (F.col("ts") <= F.col("stop_ts"))).drop("stop_ts")


def until_late_stop(events: DataFrame, flags: DataFrame, delay: str, lives: str) -> DataFrame:
    """Events of a stream without those that a stop flag of another stream comes before, by no more than its life.

    Both streams have ``ts`` and may come late by ``delay``. An event waits until no flag can come any more that would stop
    it, so a flag that is sent after the event, but is older, still stops it.
    """
    left = events.withWatermark("ts", delay)
    right = flags.withWatermark("ts", delay).select(F.col("search_id").alias("stopped"), F.col("ts").alias("stop_ts"))
    before = (F.col("stop_ts") < F.col("ts")) & (F.col("stop_ts") >= F.col("ts") - F.expr(f"INTERVAL {lives}"))
    joined = left.join(right, (F.col("search_id") == F.col("stopped")) & before, "leftOuter")
    return joined.where(F.col("stopped").isNull()).drop("stopped", "stop_ts")


def live_progress(progress: DataFrame, as_of: Column, seconds: int = STATE_TTL_SECONDS) -> DataFrame:
    """Progress not older than its time to live."""
    return progress.filter(F.unix_micros("ts") > F.unix_micros(as_of) - F.lit(seconds * 1_000_000))


def without_repeats(events: DataFrame, delay: str) -> DataFrame:
    """Each event once, although a re-run search sends its events again.

    ``delay`` is how late a repeat may come; the state keeps ids for that long.
    """
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def channel_messages(events: DataFrame) -> DataFrame:
    """Events as JSON messages on the channel of their search."""
    return events.select(
        F.concat(F.lit("search:"), F.col("search_id").cast("string"), F.lit(":events")).alias("channel"),
        F.to_json(F.struct(*events.columns)).alias("message"),
    )
