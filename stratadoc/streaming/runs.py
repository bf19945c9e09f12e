"""Telemetry as Structured Streaming queries; the batch forms are in operators.telemetry.

Open lifecycles and quotas keep state with timers, for which Spark needs the RocksDB state store
(spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import telemetry as T


def validated(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a code) of a stream of events."""
    return T.validate_events(stream)


def deduplicated(stream: DataFrame, time_col: str, delay: str = "30 days") -> DataFrame:
    """One event for each run and payload; the watermark bounds how long payloads are remembered."""
    keyed = stream.withColumn("payload_sha256", F.sha2(F.to_json(F.struct(*sorted(c for c in stream.columns if c != time_col))), 256))
    return keyed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["run_id", "payload_sha256"])


def write_events(stream: DataFrame, path: str, checkpoint: str, time_col: str):
    """Accepted, deduplicated events as Parquet by batch and day; all there is now is read.

    Each micro-batch owns a folder and overwrites it, so a batch that is played again after a failure is there once.
    """
    accepted, _ = validated(stream)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("day", F.to_date(time_col)).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={number}")

    return deduplicated(accepted, time_col).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_states(stream: DataFrame) -> DataFrame:
    """Running first and last offsets, latest status, counts and bytes of each run, for update mode."""
    return T.run_state(stream)


def milliseconds(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp")).alias("at_ms")


class Lifecycle:
    """One tool use, event by event in the order of their times: what is known of it, and what is to be told.

    started, ended: times in milliseconds or None; told: whether partial has been. An end within the timeout of the start
    closes the use, otherwise the start's timeout ends it. What has ended is remembered for another timeout, so that
    repeated events tell nothing; later events are a new use.
    """

    def __init__(self, timeout: int, started: int | None = None, ended: int | None = None, told: bool = False):
        self.timeout, self.started, self.ended, self.told = timeout, started, ended, told

    def until(self) -> int:
        """When the use times out, or is forgotten if it has ended."""
        return (self.started if self.ended is None else self.ended) + self.timeout

    def pass_time(self, now: int) -> Iterator[str]:
        """Up to, and without, this time."""
        if self.ended is None and self.started is not None and now > self.until():
            self.ended = self.until()
            yield "timeout"
        if self.ended is not None and now > self.until():
            self.started, self.ended, self.told = None, None, False

    def event(self, at: int, starts: bool, ends: bool) -> Iterator[str]:
        yield from self.pass_time(at)
        if starts and (self.ended is None or at <= self.ended):
            if not self.told:
                self.told = True
                yield "partial"
            self.started = at if self.started is None else min(at, self.started)
        if ends and self.ended is None:
            self.ended = at
            yield "closed"


class FollowLifecycle(StatefulProcessor):
    """Keeps a Lifecycle for each key; an event-time timer ends and forgets it."""

    COLUMNS = ("run_id", "tool_use_id", "state")

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lifecycle", "started long, ended long, told boolean")

    def load(self) -> Lifecycle:
        return Lifecycle(self.timeout, *self.state.get()) if self.state.exists() else Lifecycle(self.timeout)

    def keep(self, use: Lifecycle) -> None:
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        if use.started is None and use.ended is None:
            self.state.clear()
        else:
            self.state.update((use.started, use.ended, use.told))
            self.handle.registerTimer(use.until() + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((int(at), bool(ends), bool(starts)) for frame in rows for at, starts, ends in frame[["at_ms", "starts", "ends"]].itertuples(index=False, name=None))
        use, told = self.load(), []
        for at, ends, starts in events:
            told += use.event(at, starts, ends)
        self.keep(use)
        yield pd.DataFrame([(*key, x) for x in told], columns=self.COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        use = self.load()
        told = [*use.pass_time(expiredTimerInfo.getExpiryTimeInMs())]
        self.keep(use)
        yield pd.DataFrame([(*key, x) for x in told], columns=self.COLUMNS)


def open_lifecycles(stream: DataFrame, time_col: str, timeout_ms: int, delay_ms: int = 0) -> DataFrame:
    """(run_id, tool_use_id, state): partial when a use starts, closed when its end comes, timeout when none comes in time.

    All times are the events' own, so the rows don't depend on how events are cut into batches; a use times out once
    the watermark, `delay_ms` behind the latest event, is past it. Events that come later than that are lost, and the
    delay may not exceed the timeout, else a start could come after its use was closed. Events without a tool use or a
    time tell nothing. The state of a use is dropped a timeout after it ended.
    """
    if delay_ms > timeout_ms:
        raise ValueError("the delay may not exceed the timeout")
    starts, ends = F.col("kind").isin(*T.USE_KINDS, "tool_pre"), F.col("kind").isin(*T.TERMINAL_KINDS)
    timed = stream.withWatermark(time_col, f"{delay_ms} milliseconds").where((starts | ends) & F.col("tool_use_id").isNotNull() & F.col("run_id").isNotNull() & F.col(time_col).isNotNull())
    # the watermark belongs to the time column, which must reach the operator
    grouped = timed.select("run_id", "tool_use_id", time_col, milliseconds(time_col), starts.alias("starts"), ends.alias("ends")).groupBy("run_id", "tool_use_id")
    return grouped.transformWithStateInPandas(FollowLifecycle(timeout_ms), "run_id string, tool_use_id string, state string", "Append", "EventTime")


class Quota(StatefulProcessor):
    """A run's kept events by class, oldest first: a map from (class, number) to the event, with where each class begins and ends."""

    COLUMNS = ("run_id", "source_sequence", "source_event_id", "decision")

    def __init__(self, most: int, most_bytes: int, idle: int):
        self.most, self.most_bytes, self.idle = most, most_bytes, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "class string, number long", "source_sequence long, source_event_id string, size long")
        self.ends = handle.getValueState("ends", "first array<long>, next array<long>, size long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = sorted(((*r,) for frame in rows for r in frame[["source_sequence", "source_event_id", "kind", "priority", "size", "at_ms"]].itertuples(index=False, name=None)), key=lambda r: r[:3])
        first, after, held, last = ([*x] if isinstance(x, (list, tuple)) or hasattr(x, "tolist") else x for x in self.ends.get()) if self.ends.exists() else ([0] * len(T.PRIORITIES), [0] * len(T.PRIORITIES), 0, None)
        out = []
        for sequence, event, _, priority, size, at in arrived:
            if last is not None and at > last + self.idle:
                self.events.clear()
                first, after, held, last = [0] * len(T.PRIORITIES), [0] * len(T.PRIORITIES), 0, None
            last = int(at) if last is None else max(last, int(at))
            own, size = T.PRIORITIES.index(priority), int(size)
            full = lambda s=size: sum(after) - sum(first) >= self.most or held + s > self.most_bytes
            while full() and (lower := next((c for c in range(len(T.PRIORITIES) - 1, max(own, 0), -1) if after[c] > first[c]), None)):
                place = T.PRIORITIES[lower], int(first[lower])
                gone = self.events.getValue(place)
                self.events.removeKey(place)
                first[lower], held = first[lower] + 1, held - int(gone[2])
                out.append((*key, int(gone[0]), gone[1], "evicted"))
            if full():
                out.append((*key, int(sequence), event, "refused"))
            else:
                self.events.updateValue((priority, int(after[own])), (int(sequence), event, size))
                after[own], held = after[own] + 1, held + size
                out.append((*key, int(sequence), event, "kept"))
        self.ends.update(([*map(int, first)], [*map(int, after)], held, last))
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle + 1)
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.events.clear()
        self.ends.clear()
        yield pd.DataFrame([], columns=self.COLUMNS)


def evict_by_priority(stream: DataFrame, time_col: str, most: int, most_bytes: int, idle_ms: int = 86_400_000, delay_ms: int = 0) -> DataFrame:
    """(run_id, source_sequence, source_event_id, decision): kept or refused when an event comes, evicted when a higher class takes its place.

    The batch form of the same name in operators.telemetry gives what stays in the end: kept and not evicted. Events
    come in order; those of one micro-batch are taken by sequence, event id and kind. A run that is silent for `idle_ms` of
    event time is forgotten. Priorities are P0, P1 and P2; events without run, time, priority or size are passed over.
    """
    known = F.col("priority").isin(*T.PRIORITIES) & F.col("run_id").isNotNull() & F.col("size").isNotNull() & F.col(time_col).isNotNull() & F.col("source_sequence").isNotNull()
    timed = stream.withWatermark(time_col, f"{delay_ms} milliseconds").where(known)
    grouped = timed.select("run_id", time_col, milliseconds(time_col), "source_sequence", F.coalesce("source_event_id", F.lit("")).alias("source_event_id"), F.coalesce("kind", F.lit("")).alias("kind"), "priority", F.col("size").cast("long").alias("size")).groupBy("run_id")
    return grouped.transformWithStateInPandas(Quota(most, most_bytes, idle_ms), "run_id string, source_sequence long, source_event_id string, decision string", "Append", "EventTime")
