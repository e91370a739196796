"""The serials of a host and slice are one state: calls to the JVM are for a slice, and groups are as by one state each."""

import json

from pyspark.sql import Row

from logloom.streaming.audit_merge import MergeRecords


class Handle:
    """Counts calls that would go to the JVM."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.append(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.remove(ms)


class Times:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def row(serial, kind, seq, second):
    us = second * 1_000_000
    return Row(audit_ts=f"t{second}", serial=serial, seq=seq, record=json.dumps({"type": kind, "line": f"{kind} {serial}", "seq": seq, "ingest_us": us, "group_us": us, "comm": f"c{seq}"}))


def test_open_groups_of_a_slice_are_one_state():
    handle, operator = Handle(), MergeRecords(2000)
    operator.init(handle)
    rows = [row(i, kind, 3 * i + j, i // 100) for i in range(1000) for j, kind in enumerate(("AVC", "SYSCALL", "PROCTITLE"))]
    out = list(operator.handleInputRows(("h", 0), iter(reversed(rows)), None))
    assert sorted(r["serial"] for r in out) == list(range(1000))  # complete with the second record; the third opens a group
    assert all({"raw_avc", "raw_syscall"} <= set(json.loads(r["merged"])) and json.loads(r["merged"])["comm"] == f"c{3 * r['serial']}" for r in out)
    assert handle.timers == [2000] and handle.calls < 10
    handle.timers.clear()
    over = list(operator.handleExpiredTimer(("h", 0), Times(4500), Times(2000)))
    assert sorted(r["serial"] for r in over) == list(range(300)) and handle.timers == [5000]
    # A record of an open group goes to it; the others wait on.
    late = list(operator.handleInputRows(("h", 0), iter([row(999, "SYSCALL", 4000, 9)]), None))
    assert [r["serial"] for r in late] == [999] and {"raw_syscall", "raw_proctitle"} <= set(json.loads(late[0]["merged"]))
    handle.timers.clear()
    rest = list(operator.handleExpiredTimer(("h", 0), Times(60_000), Times(5000)))
    assert len(rest) == 699 and handle.value is None and not handle.timers and handle.calls < 20
