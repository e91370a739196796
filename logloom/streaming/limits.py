"""Consecutive dedupe and rate limit over a stream, in the order of event time, with one state for each rate key.

Files and hosts arrive in any order, and both rules turn on what came before. So a row is held
until the watermark has passed it, that is, until no earlier one can come, and then goes
through the rules in the order of ``(event_time, seq)``: a stream gives what batch gives, as long as rows are
late by less than the watermark's delay. Held are the rows of that delay alone. Where an operator
before has held rows back behind the watermark, they are waited for that much longer.

All shell history events of a host share a rate key, so the last command and the last accepted time
are two fields of one state. The time is dropped once its window has passed; the last
command, one value a host, stays.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from logloom.operators.filters import RATE_KEY, filter_stateless, is_forced
from logloom.schemas import EVENT_FIELDS, FilterSettings
from logloom.streaming.held_rows import EVENT_ROWS, HELD, EventRow, in_runs, left, packed, passing, places, unpacked
from logloom.streaming.sliced_limits import sliced_limits

COLUMNS = (*EVENT_FIELDS, "agent_id", "seq", "event_time")
#: What a row has beside its key and time.
REST = (*[c for c in EVENT_FIELDS if c not in RATE_KEY], "agent_id", "seq")


class LimitEvents(StatefulProcessor):
    def __init__(self, window_sec: int, dedupe: bool, hold_ms: int = 0):
        self.window_us, self.dedupe, self.hold_ms = window_sec * 1_000_000, dedupe, hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Each call goes to the JVM and back, so all that is not a list is one value.
        self.last = handle.getValueState("last", "accepted_us bigint, command string, due_ms bigint")
        self.held = handle.getListState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = None
        for run in in_runs(rows):
            new = [(r["us"], r["seq"], r["command"], r["row"]) for r in run if not r["forced"]]
            if new:
                self.held.appendValue(packed(new))
                least = min(r[0] for r in new)
                first = least if first is None else min(first, least)
            if len(new) < len(run):
                yield from (EventRow(key[0], r["us"], r["row"]) for r in run if r["forced"])
        if first is not None:
            self._wait(_ms(first) + self.hold_ms)

    def _wait(self, due: int) -> None:
        accepted, command, had = self.last.get() or (None, None, None)
        if had is None or due < had:
            if had is not None:
                self.handle.deleteTimer(had)
            self.handle.registerTimer(due)
            self.last.update((accepted, command, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = timerValues.getCurrentWatermarkInMs()
        held = list(self.held.get())
        us, _ = places(held)
        ripe = _ms(us) + self.hold_ms <= upto
        accepted, command, _ = self.last.get() or (None, None, None)
        shell = self.dedupe and dict(zip(RATE_KEY, json.loads(key[0]), strict=True))["source"] == "bash_history"
        kept, (accepted, command) = passing(held, ripe, (accepted, command), shell, self.window_us)
        yield from unpacked(key[0], held, kept)
        over = None if accepted is None else _ms(accepted + self.window_us) + self.hold_ms
        if over is not None and over <= upto:
            accepted = over = None
        rest = us[~ripe]
        if len(rest):
            self.held.put(list(left(held, ~ripe)))
        elif held:
            self.held.clear()
        # The timer that fired goes by itself; it was the earliest.
        due = min([*([_ms(int(rest.min())) + self.hold_ms] if len(rest) else []), *([over] if over is not None else [])], default=None)
        if due is not None:
            self.handle.registerTimer(due)
        if accepted is None and command is None and due is None:
            self.last.clear()
        else:
            self.last.update((accepted, command, due))

    def close(self) -> None:
        pass


def _ms(us: int | np.ndarray) -> int | np.ndarray:
    """The millisecond that must have passed, so that the watermark is behind all of the time."""
    return us // 1000 + 1


def millis(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def stream_limits(events: DataFrame, s: FilterSettings, delay: str | None = "10 seconds", mark: str = "event_time", hold: str = "0 seconds", slice_sec: int | None = None) -> DataFrame:
    """Rules R7 and R8 on a stream of events that passed the stateless rules; forced ones pass at once and touch no state.

    They go through the same operator, as a branch of their own would do all that comes before a second time.
    ``delay`` is None where column ``mark`` has a watermark already; it may be behind ``event_time``
    by ``hold``. With ``slice_sec`` a key has a state for each slice of so many seconds
    (:mod:`logloom.streaming.sliced_limits`), which spreads a key with most of the rows, but
    gives them out when their slice is over.
    """
    if s.rate_limit_window_sec <= 0 and not s.dedupe_bash_history:
        return events.select(*COLUMNS)
    if slice_sec and not delay:
        raise ValueError("slices read their events twice, so no stateful operator may come before")
    rows = events.withWatermark(mark, delay) if delay and not slice_sec else events
    # Fields of the key may be missing; they are one value then, as in batch. All else of a row is one text, which Python only carries.
    named = rows.select(
        F.to_json(F.array(*[F.coalesce(c, F.lit("")) for c in RATE_KEY])).alias("key"), F.unix_micros("event_time").alias("us"), F.coalesce("seq", F.lit(0)).alias("seq"), F.coalesce("command", F.lit("")).alias("command"),
        is_forced(s).alias("forced"), F.to_json(F.struct(*[F.coalesce(c, F.lit("")).alias(c) if c in EVENT_FIELDS else F.col(c) for c in REST])).alias("row"), mark,
    )
    if slice_sec:
        return _events(sliced_limits(named, s, mark, delay, millis(hold), slice_sec))
    processor = LimitEvents(s.rate_limit_window_sec, s.dedupe_bash_history, millis(hold))
    return _events(named.groupBy("key").transformWithState(processor, outputStructType=EVENT_ROWS, outputMode="append", timeMode="eventTime"))


def _events(rows: DataFrame) -> DataFrame:
    """Events of the rows of an operator."""
    key, rest = F.from_json("key", "array<string>").alias("k"), F.from_json("row", ", ".join(f"{c} {'bigint' if c == 'seq' else 'string'}" for c in REST)).alias("r")
    places = {c: F.col("k")[i] for i, c in enumerate(RATE_KEY)} | {c: F.col("r")[c] for c in REST}
    return rows.select("us", key, rest).select(*[places[c].alias(c) for c in COLUMNS[:-1]], F.timestamp_micros("us").alias("event_time"))


def stream_filter(events: DataFrame, s: FilterSettings, delay: str | None = "10 seconds", mark: str = "event_time", hold: str = "0 seconds", slice_sec: int | None = None) -> DataFrame:
    """The whole chain on a stream."""
    return stream_limits(filter_stateless(events, s), s, delay, mark, hold, slice_sec)
