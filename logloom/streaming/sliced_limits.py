"""Consecutive dedupe and rate limit over a stream with a state for each rate key and slice of time.

Both rules turn on what came before, but a slice depends on earlier ones only by their last accepted time and
last command. So three operators follow each other in the same batch:

1. :class:`TellWays` has a state for each key and slice. When the watermark has passed the slice, it
   tells for every way to enter it the time that it leaves behind: a few numbers in one row.
2. :class:`FollowWays` has a small state for each key: the last accepted time and command. It follows
   the slices in order and tells each what it is entered with.
3. :class:`AcceptEvents` holds the events of a key and slice until they are told.

In a query the keys of a bucket (a hash of the key) share these states, as each call goes to the JVM and back: most keys
have few rows in a slice. :class:`TellBucket`, :class:`FollowBucket` and :class:`AcceptBucket` do the same for all keys of a bucket.
Rows come to them, and leave them, packed (:func:`_packing`, :func:`_unpacking`): a row of Spark is up to 20,000 events of a bucket and
slice, as Python gets and gives each row of a stateful operator by itself. A run of events is late when all of it is.

A key with most of the rows is spread over as many tasks as it has slices under way: those of
the watermark's delay, or of the backlog that a batch catches up on. The rows of one slice are one state, so
slices should be shorter than the delay.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from logloom.operators.filters import RATE_KEY, _accepted, _ways_through
from logloom.schemas import FilterSettings
from logloom.streaming.held_rows import EVENT_ROWS, HELD, EventRow, commands, in_runs, packed, passing, places, repeats, spread, squeezed, unpacked

WAYS = "key string, slice bigint, first string, last string, upto array<bigint>, out array<bigint>, upto_less array<bigint>, out_less array<bigint>, passed timestamp"
ENTERED = "key string, slice bigint, entered_us bigint, entered_command string, passed timestamp"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _time(us: int) -> datetime:
    return EPOCH + timedelta(microseconds=us)


class Sliced(StatefulProcessor):
    """What the three operators share."""

    def __init__(self, window_sec: int, dedupe: bool, hold_ms: int, slice_sec: int):
        self.window_us, self.dedupe, self.hold_ms, self.width = window_sec * 1_000_000, dedupe, hold_ms, slice_sec * 1_000_000

    def over_ms(self, number: int) -> int:
        """When no more rows of a slice can come."""
        return (number + 1) * self.width // 1000 + self.hold_ms

    def is_shell(self, key) -> bool:
        return self.dedupe and json.loads(key[0])[RATE_KEY.index("source")] == "bash_history"

    def close(self) -> None:
        pass


class TellWays(Sliced):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", HELD)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if not self.rows.exists():
            self.handle.registerTimer(self.over_ms(int(key[1])))
        for run in in_runs(rows):
            self.rows.appendValue(packed([(r["us"], r["seq"], r["command"]) for r in run]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = list(self.rows.get())
        self.rows.clear()
        times, seq = places(held)
        if not len(times):
            return
        number, shell = int(key[1]), self.is_shell(key)
        order = np.lexsort((seq, times))
        said, times = commands(held)[order], times[order]
        if shell:
            times = times[~repeats(said, None)]
        (upto, out), (upto_less, out_less) = self._ways(times, number), self._ways(times[1:] if shell else times[:0], number)
        # A row must not be behind the watermark, nor on it.
        passed = _time(1000 * (self.over_ms(number) + 1))
        yield Row(key=key[0], slice=number, first=said[0], last=said[-1], upto=upto, out=out, upto_less=upto_less, out_less=out_less, passed=passed)

    def _ways(self, times: np.ndarray, number: int) -> tuple[list, list]:
        if not len(times) or not self.window_us:
            return [], []
        upto, out = _ways_through(times, number * self.width, self.window_us)
        return upto.tolist(), out.tolist()


class FollowWays(Sliced):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "accepted_us bigint, command string, due_ms bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        accepted, command, had = self.last.get() or (None, None, None)
        told = []
        for r in sorted(rows, key=lambda r: r["slice"]):  # a row for each slice that is over
            told.append(Row(key=key[0], slice=r["slice"], entered_us=accepted, entered_command=command, passed=r["passed"]))
            less = self.is_shell(key) and bool(r["first"]) and r["first"] == command
            upto, out = (r["upto_less"], r["out_less"]) if less else (r["upto"], r["out"])
            i = 0 if accepted is None else int(np.searchsorted(upto, accepted + self.window_us, side="left"))
            accepted = out[i] if i < len(upto) else accepted
            command = r["last"] if self.is_shell(key) else None
        # The accepted time bears on rows within the window, which come when their slice is over.
        due = None if accepted is None else self.over_ms((accepted + self.window_us) // self.width) + 1
        if had is not None and had != due:
            self.handle.deleteTimer(had)
        if due is not None and had != due:
            self.handle.registerTimer(due)
        self.last.update((accepted, command, due))
        return iter(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, command, due = self.last.get() or (None, None, None)
        if due is not None and due <= expiredTimerInfo.getExpiryTimeInMs():
            if command is None:
                self.last.clear()
            else:
                self.last.update((None, command, None))
        return iter(())


class AcceptEvents(Sliced):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new, entered = [], None
        for run in in_runs(rows):
            held = [(r["us"], r["seq"], r["command"], r["row"]) for r in run if not r["is_told"] and not r["forced"]]
            if held:
                new.append(packed(held))
            if len(held) < len(run):
                for r in run:
                    if r["is_told"]:
                        entered = (r["entered_us"], r["entered_command"])
                    elif r["forced"]:
                        yield EventRow(key[0], r["us"], r["row"])
        if entered is None:
            if new:
                self.held.appendList(new)
            return
        held = [*self.held.get(), *new]
        self.held.clear()
        kept, _ = passing(held, np.ones(len(places(held)[0]), dtype=bool), entered, self.is_shell(key), self.window_us)
        yield from unpacked(key[0], held, kept)


#: Keys are dealt over so many buckets.
BUCKETS = 16
BUCKET_WAYS = "bucket long, slice bigint, ways binary, passed timestamp"
BUCKET_ENTERED = "bucket long, slice bigint, entered binary, passed timestamp"


def packed_keys(rows: list[tuple]) -> tuple[bytes, bytes, bytes]:
    """An element of ``(key, us, seq, command, row)`` of several keys; the last may be missing."""
    keys, us, seq, said, *texts = zip(*rows, strict=True)
    codes: dict[str, int] = {}
    numbers = np.array([codes.setdefault(k, len(codes)) for k in keys], dtype=np.int32)
    return np.array([us, seq], dtype=np.int64).tobytes(), squeezed((list(codes), numbers, said if any(said) else None)), squeezed(texts[0]) if texts else b""


def by_key(elements: list[tuple]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray | None]]:
    """``key, at, times, commands`` of the keys of elements, in the order of time and ``seq``; ``at`` are places among all rows."""
    us, seq = places(elements)
    codes, numbers, said = {}, [], []
    for e in elements:
        names, own, commands_ = spread(e[1])
        numbers.append(np.array([codes.setdefault(k, len(codes)) for k in names], dtype=np.int64)[own])
        said.append(commands_ or [""] * len(own))
    if not numbers:
        return
    number, some = np.concatenate(numbers), np.empty(len(us), dtype=object)
    some[:] = [c for each in said for c in each]
    order = np.lexsort((seq, us, number))
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(number[order])) + 1, [len(order)]])
    names = list(codes)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[lo:hi]
        yield names[int(number[at[0]])], at, us[at], some[at]


class TellBucket(TellWays):
    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if not self.rows.exists():
            self.handle.registerTimer(self.over_ms(int(key[1])))
        for run in in_runs(rows):
            self.rows.appendValue(packed_keys([(r["key"], r["us"], r["seq"], r["command"]) for r in run]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, number = list(self.rows.get()), int(key[1])
        self.rows.clear()
        ways = []
        for name, _, times, said in by_key(held):
            shell = self.is_shell((name,))
            if shell:
                times = times[~repeats(said, None)]
            ways.append((name, said[0], said[-1], self._ways(times, number), self._ways(times[1:] if shell else times[:0], number)))
        if ways:
            # A row must not be behind the watermark, nor on it.
            yield Row(bucket=key[0], slice=number, ways=squeezed(ways), passed=_time(1000 * (self.over_ms(number) + 1)))


class FollowBucket(Sliced):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "keys binary, due_ms bigint")

    def _keep(self, last: dict, had: int | None) -> None:
        accepted = max((a for a, _ in last.values() if a is not None), default=None)
        # The accepted time bears on rows within the window, which come when their slice is over.
        due = None if accepted is None else self.over_ms((accepted + self.window_us) // self.width) + 1
        if had is not None and had != due:
            self.handle.deleteTimer(had)
        if due is not None and had != due:
            self.handle.registerTimer(due)
        if last:
            self.last.update((squeezed(last), due))
        else:
            self.last.clear()

    def _without(self, last: dict, passed: int) -> dict:
        """Without times whose window ends at ``passed`` or before; commands stay."""
        now = {k: (a if a is not None and a + self.window_us > passed else None, c) for k, (a, c) in last.items()}
        return {k: v for k, v in now.items() if v != (None, None)}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.last.get()
        last, had = (spread(bytes(held[0])), held[1]) if held is not None else ({}, None)
        for r in sorted(rows, key=lambda r: r["slice"]):  # a row for each slice that is over
            entered = {}
            for name, first, final, whole, less in spread(bytes(r["ways"])):
                accepted, command = last.get(name, (None, None))
                if (accepted, command) != (None, None):
                    entered[name] = (accepted, command)
                shell = self.is_shell((name,))
                upto, out = less if shell and first and first == command else whole
                i = 0 if accepted is None else int(np.searchsorted(upto, accepted + self.window_us, side="left"))
                last[name] = (out[i] if i < len(upto) else accepted, final if shell else None)
            # Slices to come are later ones.
            last = self._without(last, (r["slice"] + 1) * self.width)
            yield Row(bucket=key[0], slice=r["slice"], entered=squeezed(entered), passed=r["passed"])
        self._keep(last, had)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.last.get()
        if held is not None and held[1] is not None and held[1] <= expiredTimerInfo.getExpiryTimeInMs():
            # The due time is that of the last of all accepted times.
            self._keep({k: (None, c) for k, (_, c) in spread(bytes(held[0])).items() if c is not None}, None)
        return iter(())


class AcceptBucket(Sliced):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new, entered = [], None
        for run in in_runs(rows):
            held = []
            for r in run:
                if r["entered"] is not None:
                    entered = spread(bytes(r["entered"]))
                elif r["forced"]:
                    yield EventRow(r["key"], r["us"], r["row"])
                else:
                    held.append((r["key"], r["us"], r["seq"], r["command"], r["row"]))
            if held:
                new.append(packed_keys(held))
        for keys, us, texts in self._kept(new, entered):
            yield from map(EventRow, keys, us, texts)

    def _kept(self, new: list[tuple], entered: dict | None) -> Iterator[tuple[list, list, list]]:
        """Keys, times and texts of what is accepted, by element; without ``entered`` the new elements are held."""
        if entered is None:
            for lo in range(0, len(new), APPENDED):
                self.held.appendList(new[lo : lo + APPENDED])
            return
        elements = [*self.held.get(), *new]
        self.held.clear()
        kept = np.zeros(len(places(elements)[0]), dtype=bool)
        for name, at, times, said in by_key(elements):
            accepted, command = entered.get(name, (None, None))
            if self.is_shell((name,)):
                fresh = ~repeats(said, command)
                at, times = at[fresh], times[fresh]
            if self.window_us:
                at = at[_accepted(times, accepted, self.window_us)[0]]
            kept[at] = True
        start = 0
        for e in elements:
            us = places([e])[0]
            mask, start = kept[start : start + len(us)], start + len(us)
            if mask.any():
                yield _texts(e, mask)


def _texts(element: tuple, mask: np.ndarray) -> tuple[list, list, list]:
    at = np.flatnonzero(mask).tolist()
    us, (names, own, _), texts = places([element])[0], spread(element[1]), spread(element[2])
    return [names[own[i]] for i in at], us[at].tolist(), [texts[i] for i in at]


#: Events that are packed at a time, and elements that go to a state at a time.
PACKED_ROWS = 20_000
APPENDED = 32
PACKED = "bucket long, slice bigint, forced boolean, places binary, keys binary, rows binary, passed timestamp"


def _elements(t: pa.Table) -> pa.RecordBatch:
    """The rows of a table as one element for each bucket, slice and whether they are forced."""
    if t["us"].null_count:
        raise ValueError("events without event_time have no slice")
    group = [t[c].to_numpy() for c in ("forced", "slice", "bucket")]
    order = np.lexsort(group)  # stable
    t = t.take(pa.array(order))
    forced, slices, buckets = (g[order] for g in group)
    change = (np.diff(buckets) != 0) | (np.diff(slices) != 0) | (np.diff(forced.astype(np.int8)) != 0)
    cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [t.num_rows]])
    us, seq, passed = t["us"].to_numpy(), t["seq"].to_numpy(), t["passed"].cast(pa.int64()).to_numpy()
    keys, said = (t[c].combine_chunks().dictionary_encode() for c in ("key", "command"))
    names, codes = keys.dictionary.to_pylist(), keys.indices.to_numpy()
    commands_ = np.array([*said.dictionary.to_pylist(), None], dtype=object)[:-1][said.indices.to_numpy()]  # equal ones are one object
    texts = t["row"].to_pylist() if "row" in t.column_names else None
    out = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        own, numbers = np.unique(codes[lo:hi], return_inverse=True)
        commands_of = commands_[lo:hi].tolist()
        about = squeezed(([names[i] for i in own], numbers.astype(np.int32), commands_of if any(commands_of) else None))
        out.append((np.array([us[lo:hi], seq[lo:hi]], dtype=np.int64).tobytes(), about, squeezed(texts[lo:hi]) if texts else b""))
    at = pa.array(cuts[:-1])
    three = [pa.array(c, pa.binary()) for c in zip(*out, strict=True)]
    latest = pa.array(np.maximum.reduceat(passed, cuts[:-1])).cast(pa.timestamp("us", "UTC"))
    return pa.RecordBatch.from_arrays([*(t[c].combine_chunks().take(at) for c in ("bucket", "slice", "forced")), *three, latest], [f.split()[0] for f in PACKED.split(", ")])


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs runs of exactly so many rows, so that the two readings of the events have the same elements, however Arrow's batches are cut."""
    held, n = [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, PACKED_ROWS - n)
            held.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == PACKED_ROWS:
                yield _elements(pa.Table.from_batches(held))
                held, n = [], 0
    if n:
        yield _elements(pa.Table.from_batches(held))


def _unpacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for element in b.column("rows"):
            keys, us, texts = spread(element.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(us, pa.int64()), pa.array(texts, pa.string())], ["key", "us", "row"])


class TellPacked(TellBucket):
    """Of elements in place of rows."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if not self.rows.exists():
            self.handle.registerTimer(self.over_ms(int(key[1])))
        while some := [(bytes(r["places"]), bytes(r["keys"]), b"") for r in islice(rows, APPENDED)]:
            self.rows.appendList(some)
        return iter(())


class AcceptPacked(AcceptBucket):
    """Of elements in place of rows; gives accepted ones packed, too."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new, entered = [], None
        for r in rows:
            if r["entered"] is not None:
                entered = spread(bytes(r["entered"]))
                continue
            element = (bytes(r["places"]), bytes(r["keys"]), bytes(r["rows"]))
            if r["forced"]:
                yield Row(rows=squeezed(_texts(element, np.ones(len(places([element])[0]), dtype=bool))))
            else:
                new.append(element)
        out: tuple[list, list, list] = [], [], []
        for kept in self._kept(new, entered):
            for column, more in zip(out, kept, strict=True):
                column += more
            if len(out[0]) >= PACKED_ROWS:
                yield Row(rows=squeezed(out))
                out = [], [], []
        if out[0]:
            yield Row(rows=squeezed(out))


def sliced_limits(rows: DataFrame, s: FilterSettings, mark: str, delay: str, hold_ms: int, slice_sec: int) -> DataFrame:
    """Rules R7 and R8 on a stream of ``key, us, seq, command, forced, row`` and ``mark``, which gets a watermark of ``delay``; gives ``key, us, row``."""
    settings = (s.rate_limit_window_sec, s.dedupe_bash_history, hold_ms, slice_sec)
    dealt = rows.withColumn("slice", F.floor(F.col("us") / (slice_sec * 1_000_000)).cast("long")).withColumnRenamed(mark, "passed")
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("long"))
    by_slice = ("bucket", "slice")

    def elements(rows: DataFrame) -> DataFrame:
        # The latest time of an element has the watermark, so the watermark is that of the rows.
        return rows.mapInArrow(_packing, PACKED).withWatermark("passed", delay)

    def through(rows: DataFrame, by: tuple[str, ...], processor: StatefulProcessor, schema: str, column: str = "") -> DataFrame:
        return rows.groupBy(*by).transformWithState(processor, outputStructType=schema, outputMode="append", timeMode="eventTime", eventTimeColumnName=column)

    ways = through(elements(dealt.drop("row")).where("not forced").drop("forced", "rows"), by_slice, TellPacked(*settings), BUCKET_WAYS, "passed")
    entered = through(ways, ("bucket",), FollowBucket(*settings), BUCKET_ENTERED, "passed")
    both = elements(dealt).withColumn("entered", F.lit(None).cast("binary")).unionByName(entered, allowMissingColumns=True)
    return through(both, by_slice, AcceptPacked(*settings), "rows binary").mapInArrow(_unpacking, EVENT_ROWS)
