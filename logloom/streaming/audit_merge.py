"""Audit merge over a stream: the eager merge with one state for the serials of a host's slice of time.

The groups that are open in a slice are one packed value with one timer, as each call goes to the JVM
and back: calls are for a slice, not for a serial. A slice is cut in parts by serial, so a busy host spreads over tasks.

Groups are kept for ``hold`` after their first record and dropped by an
event-time timer, so state stays bounded; records behind the watermark are late and
start no new group.

A group that is not completed comes out when the watermark is past its time by ``hold``. A
stream must not give rows behind its watermark, so the watermark goes on in a column of its own,
``passed``, which is the group's time and ``hold``; what follows must wait for ``hold`` longer.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from logloom.operators.audit import FIRST, audit_event, merge_rows
from logloom.streaming.held_rows import squeezed, spread
from logloom.streaming.limits import millis

RAWS = {"AVC": "raw_avc", "SYSCALL": "raw_syscall", "PROCTITLE": "raw_proctitle"}
#: Fields of which a group has the first.
FIRST_FIELDS = (*FIRST, "agent_id")
#: What a record tells beside its key; one text, so that a row has few columns.
RECORD = ("type", "line", "seq", "ingest_us", "group_us", *FIRST_FIELDS)
GROUP = ", ".join(f"{n} string" for n in (*FIRST_FIELDS, *RAWS.values())) + ", seq bigint, ingest_us bigint, group_us bigint"
MERGED = "hostname string, audit_ts string, serial bigint, merged string, passed timestamp"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: A slice of time in seconds, and its parts by serial.
SLICE_SEC, PARTS = 600, 4
MergedRow = Row("hostname", "audit_ts", "serial", "merged", "passed")


def slice_of(time: Column, audit_ts: Column, serial: Column) -> Column:
    """The slice of a group, told by its key alone; groups whose time cannot be read are dealt by their key."""
    known = F.floor(F.unix_micros(time) / (SLICE_SEC * 1_000_000)) * PARTS + F.pmod(serial, F.lit(PARTS))
    return F.coalesce(known, -1 - F.pmod(F.xxhash64(audit_ts, serial), F.lit(64))).cast("long")


class MergeRecords(StatefulProcessor):
    """The open groups of each host and slice, by audit time and serial."""

    def __init__(self, hold_ms: int):
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "groups binary, due_ms bigint")

    def _open(self) -> tuple[dict, int | None]:
        held = self.state.get()
        return (spread(bytes(held[0])), held[1]) if held is not None else ({}, None)

    def _keep(self, groups: dict, had: int | None) -> None:
        """Stores the open groups; ``had`` is the time of a timer that still waits."""
        due = min((g["group_us"] for g in groups.values()), default=None)
        due = None if due is None else due // 1000 + self.hold_ms
        if had is not None and had != due:
            self.handle.deleteTimer(had)
        if due is not None and had != due:
            self.handle.registerTimer(due)
        if groups:
            self.state.update((squeezed(groups), due))
        else:
            self.state.clear()

    def _row(self, host: str, key: tuple, group: dict) -> Row:
        return MergedRow(host, *key, json.dumps(group, ensure_ascii=False), EPOCH + timedelta(milliseconds=group["group_us"] // 1000 + self.hold_ms + 1))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        groups, had = self._open()
        came = defaultdict(list)
        for r in rows:
            came[r["audit_ts"], r["serial"]].append((r["seq"], r["record"]))
        for name, records in came.items():
            group = groups.pop(name, None)
            for _, text in sorted(records, key=lambda r: r[0]):  # a serial has a few records
                r = json.loads(text)
                if group is None:
                    group = {n: r[n] for n in ("seq", "ingest_us", "group_us")}
                for n in FIRST_FIELDS:
                    if n in r:
                        group.setdefault(n, r[n])
                group[RAWS[r["type"]]] = r["line"]
                if "raw_syscall" in group and ("raw_avc" in group or "raw_proctitle" in group):
                    yield self._row(key[0], name, group)
                    group = None
            if group is not None:
                groups[name] = group
        if groups or had is not None:
            self._keep(groups, had)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        groups, due = self._open()
        upto = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        over = [name for name, g in groups.items() if g["group_us"] // 1000 + self.hold_ms <= upto]
        for name in over:
            yield self._row(key[0], name, groups.pop(name))
        # The timer that fired goes by itself.
        if over:
            self._keep(groups, None)

    def close(self) -> None:
        pass


def stream_merge_audit(lines: DataFrame, hold: str = "2 seconds", delay: str = "10 seconds") -> DataFrame:
    """Events of mergeable records of a stream of lines, with ``passed``, which carries the watermark.

    Needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider.
    """
    time = F.try_to_timestamp("audit_ts")
    rows = merge_rows(lines).withColumn("group_time", F.coalesce(time, "ingest_time")).withWatermark("group_time", delay)
    rows = rows.withColumns({"ingest_us": F.unix_micros("ingest_time"), "group_us": F.unix_micros("group_time"), "slice": slice_of(time, F.col("audit_ts"), F.col("serial")), "seq": F.coalesce("seq", F.lit(0))})
    rows = rows.select("hostname", "slice", "audit_ts", "serial", "seq", F.to_json(F.struct(*RECORD)).alias("record"), "group_time")
    merged = rows.groupBy("hostname", "slice").transformWithState(MergeRecords(millis(hold)), outputStructType=MERGED, outputMode="append", timeMode="eventTime", eventTimeColumnName="passed")
    groups = merged.withColumn("g", F.from_json("merged", GROUP)).select("hostname", "audit_ts", "serial", "g.*", "passed")
    groups = groups.withColumns({"ingest_time": F.timestamp_micros("ingest_us"), "group_time": F.timestamp_micros(F.floor(F.col("group_us") / 1000) * 1000)})
    return audit_event(groups, "group_time", ("passed",))
