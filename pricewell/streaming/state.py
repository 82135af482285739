"""Keyed state with a time to live, for searches followed while they run."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import chain
from operator import attrgetter, itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pricewell.operators.sizing import broadcast_if_small
from pricewell.schemas import STATE_TTL_SECONDS
from pricewell.streaming.events import TERMINAL

OUTPUT = (
    "search_id BIGINT, events BIGINT, results_added BIGINT, last_us BIGINT, processed_count INT, found_total INT,"
    " closed_us BIGINT, closed_by STRING"
)
OUTPUT_COLUMNS = [part.split()[0] for part in OUTPUT.split(", ")]
#: Slots of searches that share a state; fixed for the life of a checkpoint.
SLOTS = 1_024
#: Waiting events of one row of state.
CHUNK_EVENTS = 10_000
# The state of a slot. Events and runs are lists in JSON, in the order of the columns below; times are microseconds, that of
# the timer milliseconds. A run comes with its search, its counts of a type stand at the same place.
RUNS = "timer_ms BIGINT, runs STRING"
COUNTS = "counts STRING"
WAITING = "events STRING"
EVENT_COLUMNS = ["search_id", "us", "event_id", "type", "processed_count", "found_total"]


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which state of several variables needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@dataclass(slots=True)
class Run:
    """The current run of a search, folded event by event in the order of time and id."""

    events: int = 0
    last_us: int | None = None
    last_event: int | None = None
    processed_count: int | None = None
    found_total: int | None = None
    closed_us: int | None = None
    closed_by: str | None = None
    heard_us: int | None = None
    counts: dict[str, int] = field(default_factory=dict)

    def copy(self) -> Run:
        return Run(*_fields(self), dict(self.counts))

    def take(self, event: list, ttl_us: int) -> Run:
        """The run after an event: a new one where the silence before was longer than the time to live."""
        _, us, event_id, kind, processed, total = event
        now = self
        if self.heard_us is not None and us - self.heard_us > ttl_us:
            now = Run()
        now.heard_us = us
        if now.closed_us is not None:  # what comes after the first end does not count
            return now
        now.events += 1
        now.counts[kind] = now.counts.get(kind, 0) + 1
        if kind == "progress":
            now.last_us, now.last_event, now.processed_count, now.found_total = us, event_id, processed, total
        if kind in TERMINAL:
            now.closed_us, now.closed_by = us, kind
        return now


_fields = attrgetter("events", "last_us", "last_event", "processed_count", "found_total", "closed_us", "closed_by", "heard_us")


def _by_search(events: list[list], into: dict[int, list[list]]) -> None:
    for event in events:
        into.setdefault(event[0], []).append(event)


class SearchRuns(StatefulProcessor):
    """Follows the current run of each search.

    A run ends when nothing is heard of the search for longer than the time to live: the next event
    begins a new one. The first terminal event closes a run, and what comes after it in the run is ignored. The rule is
    one of event time alone, so it does not matter how events fall into micro-batches or in which order they
    come, as long as none is later than the watermark.

    Every call for a key and every access to its state costs a round trip to the JVM, a fraction of a millisecond. Searches
    therefore share the state of a slot, which is read and written at once: a batch costs a dozen round trips for each of
    its slots, and some microseconds for each of its events and each search of these slots.

    Events that the watermark has not passed yet wait in a list. What it has passed is folded in order into the runs
    (a value) and their counts by type (a map, in the order of the runs) and forgotten, so a slot holds the events of the
    delay and of one micro-batch, which the source's limit bounds. A timer at the first last waiting event of its
    searches folds what an idle search has left, one at the first end of a time to live drops the searches that have
    reached theirs.
    """

    def __init__(self, ttl_seconds: int = STATE_TTL_SECONDS) -> None:
        self.ttl_us = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", RUNS)
        self.counts = handle.getMapState("counts", "type STRING", COUNTS)
        self.waiting = handle.getListState("waiting", WAITING)

    def _load(self) -> tuple[int | None, dict[int, Run], dict[int, list[list]], list[str]]:
        """The time of the slot's timer, the runs and the waiting events of its searches, the types that have counts."""
        timer, stored = self.runs.get() or (None, "[]")
        runs = {search: Run(*values) for search, *values in json.loads(stored)}
        kinds = []
        for (kind,), (counts,) in self.counts.iterator():
            kinds.append(kind)
            for run, n in zip(runs.values(), json.loads(counts), strict=True):
                if n:
                    run.counts[kind] = n
        waiting: dict[int, list[list]] = {}
        for (events,) in self.waiting.get():
            _by_search(json.loads(events), waiting)
        return timer, runs, waiting, kinds

    def _save(self, timer: int | None, runs: dict[int, Run], waiting: dict[int, list[list]], kinds: list[str]) -> None:
        if timer is None:
            self.runs.clear()
        else:
            self.runs.update((timer, json.dumps([(search, *_fields(run)) for search, run in runs.items()])))
        found = dict.fromkeys(kind for run in runs.values() for kind in run.counts)
        for kind in found:
            self.counts.updateValue((kind,), (json.dumps([run.counts.get(kind, 0) for run in runs.values()]),))
        for kind in kinds:
            if kind not in found:
                self.counts.removeKey((kind,))
        events = list(chain.from_iterable(waiting.values()))
        if events:
            chunks = (events[at : at + CHUNK_EVENTS] for at in range(0, len(events), CHUNK_EVENTS))
            self.waiting.put([(json.dumps(chunk),) for chunk in chunks])
        else:
            self.waiting.clear()

    def _settle(self, new: dict[int, list[list]], watermark_ms: int) -> dict[int, Run]:
        """Folds what the watermark has passed into the state; the runs of the new events as they are with what still waits."""
        timer, runs, waiting, kinds = self._load()
        for search, events in new.items():
            waiting.setdefault(search, []).extend(events)
        passed_us = watermark_ms * 1_000
        due, rests, now = [], {}, {}
        for search, events in waiting.items():
            events.sort()
            passed = bisect_right(events, passed_us, key=itemgetter(1))
            if passed:
                run = runs.get(search) or Run()
                for event in events[:passed]:
                    run = run.take(event, self.ttl_us)
                runs[search] = run
            if rest := events[passed:]:
                rests[search] = rest
                due.append(rest[-1][1])
            if search in new:
                run = runs[search].copy() if search in runs else Run()
                for event in rest:
                    run = run.take(event, self.ttl_us)
                now[search] = run
        for search in [s for s in runs if s not in rests]:
            if (end := runs[search].heard_us + self.ttl_us) < passed_us:
                del runs[search]
            else:
                due.append(end)
        next_timer = max(min(due) // 1_000, watermark_ms) + 1 if due else None
        if timer != next_timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if next_timer is not None:
                self.handle.registerTimer(next_timer)
        self._save(next_timer, runs, rests, kinds)
        return now

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list[list]] = {}
        for part in rows:
            _by_search(json.loads(f"[{','.join(part['event'])}]"), new)
        runs = self._settle(new, timerValues.getCurrentWatermarkInMs())
        changed = [
            (search, r.events, r.counts.get("result_added", 0), r.last_us, r.processed_count, r.found_total, r.closed_us, r.closed_by)
            for search, r in runs.items()
        ]
        yield pd.DataFrame(changed, columns=OUTPUT_COLUMNS, dtype=object)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._settle({}, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None: ...


def _as_json() -> Column:
    """An event as a list in JSON: Python reads the events of a slot at once, and integers stay whole beside nulls."""
    kind = F.to_json(F.array("type"))
    values = {c: F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in EVENT_COLUMNS}
    values["type"] = kind.substr(F.lit(2), F.length(kind) - 2)
    return F.concat(F.lit("["), F.concat_ws(",", *values.values()), F.lit("]"))


def search_progress(events: DataFrame, delay: str, ttl_seconds: int = STATE_TTL_SECONDS) -> DataFrame:
    """A changed row per search and micro-batch, with the search's current run (``SearchRuns``).

    ``delay`` is how late events may come: what is later is left out. Start the stream in ``rocksdb_state``, from a
    source with a limit. ``current_runs`` gives the same of a table.
    """
    rows = events.where(F.col("ts").isNotNull()).withWatermark("ts", delay)
    slot = F.pmod(F.xxhash64("search_id"), F.lit(SLOTS)).cast("int").alias("slot")
    rows = rows.withColumn("us", F.unix_micros("ts")).select(slot, "ts", _as_json().alias("event"))
    changed = rows.groupBy("slot").transformWithStateInPandas(SearchRuns(ttl_seconds), OUTPUT, "update", "EventTime")
    times = {f"{c}_us": F.timestamp_micros(f"{c}_us").alias(f"{c}_ts") for c in ("last", "closed")}
    return changed.select(*[times.get(c, F.col(c)) for c in changed.columns])


def current_runs(events: DataFrame, ttl_seconds: int = STATE_TTL_SECONDS) -> DataFrame:
    """The current run of each search in a table of events, by the rule of ``search_progress``.

    Events of a search are never gathered: no silence longer than the time to live fits inside a time bucket of
    its length, so runs are found among the buckets, of which a task holds a row each, and events are
    only added up. Events without a time are left out.
    """
    timed = events.where(F.col("ts").isNotNull())
    micros, ttl = F.unix_micros("ts"), F.lit(ttl_seconds * 1_000_000)
    event = F.struct("ts", "event_id", "type")
    buckets = timed.groupBy("search_id", (micros - F.pmod(micros, ttl)).alias("bucket")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.min(F.when(F.col("type").isin(*TERMINAL), event)).alias("closing")
    )
    before = F.lag("last").over(Window.partitionBy("search_id").orderBy("bucket"))
    starts = buckets.withColumn("begins", before.isNull() | (F.unix_micros("first") - F.unix_micros(before) > ttl))
    # the run that begins last; what closes it is the first end that does not come before
    found = starts.groupBy("search_id").agg(
        F.max(F.when(F.col("begins"), F.col("first"))).alias("start"), F.collect_list("closing").alias("closings")
    )
    closing = F.array_min(F.filter("closings", lambda c: c["ts"] >= F.col("start")))
    current = broadcast_if_small(found.select(F.col("search_id").alias("of"), "start", closing.alias("closing")))
    inside = (F.col("ts") >= F.col("start")) & (F.col("closing").isNull() | (event <= F.col("closing")))
    progress = F.struct("ts", "event_id", "processed_count", "found_total")
    folded = (
        timed.join(current, F.col("search_id").eqNullSafe(F.col("of")) & inside)
        .groupBy("search_id")
        .agg(
            F.count("*").alias("events"),
            F.count_if(F.col("type") == "result_added").alias("results_added"),
            F.max(F.when(F.col("type") == "progress", progress)).alias("latest"),
            F.max("closing").alias("closing"),
        )
    )
    counts = [F.col(f"latest.{c}").cast("int").alias(c) for c in ("processed_count", "found_total")]
    closed = [F.col("closing.ts").alias("closed_ts"), F.col("closing.type").alias("closed_by")]
    return folded.select("search_id", "events", "results_added", F.col("latest.ts").alias("last_ts"), *counts, *closed)
