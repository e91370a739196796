"""A stateful operator holds runs of rows, not rows: few calls to the JVM, and little memory, however many rows a key has."""

import json
import random

import pytest
from pyspark.sql import Row

from logloom.streaming.limits import LimitEvents
from logloom.streaming.sliced_limits import AcceptEvents, TellWays


class Held:
    """A list or value state."""

    def __init__(self):
        self.values, self.value = [], None

    def appendValue(self, v):
        self.values.append(v)

    def appendList(self, vs):
        self.values += vs

    def get(self):
        return iter(self.values) if self.value is None and self.values else self.value if self.value is not None else None

    def update(self, v):
        self.value = v

    def put(self, vs):
        self.values = list(vs)

    def exists(self):
        return bool(self.values)

    def clear(self):
        self.values, self.value = [], None


class Handle:
    def __init__(self):
        self.timers = []

    def getListState(self, *_):
        return Held()

    getValueState = getListState

    def registerTimer(self, t):
        self.timers.append(t)

    def deleteTimer(self, t):
        self.timers.remove(t)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


KEY = json.dumps(["h", "bash_history", "", "", "", ""])


def made(n):
    rng = random.Random(n)
    rows = [Row(us=rng.randrange(n) * 1000, seq=i, command=rng.choice(("ls", "pwd", "")), forced=i % 1000 == 0, row=f"row {i}") for i in range(n)]
    return rows


def expected(rows, window_us, upto_ms, last=None, before=None):
    out = []
    for r in sorted((r for r in rows if not r["forced"] and r["us"] // 1000 + 1 <= upto_ms), key=lambda r: (r["us"], r["seq"])):
        same, before = bool(r["command"]) and r["command"] == before, r["command"]
        if not same and (last is None or r["us"] - last >= window_us):
            last = r["us"]
            out.append(r["row"])
    return out


@pytest.mark.parametrize("window", [0, 2])
def test_a_key_holds_runs(window):
    rows = made(25_000)
    op, handle = LimitEvents(window, True), Handle()
    op.init(handle)
    forced = list(op.handleInputRows((KEY,), iter(rows), None))
    assert [r["row"] for r in forced] == [r["row"] for r in rows if r["forced"]] and len(op.held.values) == 3
    assert sum(len(b) for e in op.held.values for b in e) < 30 * len(rows)
    half = [r["row"] for r in op.handleExpiredTimer((KEY,), Mark(12_000), None)]
    assert sorted(half) == sorted(expected(rows, window * 1_000_000, 12_000))
    rest = [r["row"] for r in op.handleExpiredTimer((KEY,), Mark(10**9), None)]
    assert sorted(half + rest) == sorted(expected(rows, window * 1_000_000, 10**9)) and not op.held.values


def test_a_slice_holds_runs():
    rows = made(25_000)
    tell, accept = TellWays(2, True, 0, 3600), AcceptEvents(2, True, 0, 3600)
    tell.init(Handle())
    accept.init(Handle())
    assert not list(tell.handleInputRows((KEY, 0), (r for r in rows if not r["forced"]), None)) and len(tell.rows.values) == 3
    dealt = [Row(**r.asDict(), is_told=False, entered_us=None, entered_command=None) for r in rows]
    list(accept.handleInputRows((KEY, 0), iter(dealt), None))
    assert len(accept.held.values) == 3
    (told,) = tell.handleExpiredTimer((KEY, 0), None, None)
    in_order = sorted((r for r in rows if not r["forced"]), key=lambda r: (r["us"], r["seq"]))
    assert (told["first"], told["last"]) == (in_order[0]["command"], in_order[-1]["command"])
    entered = Row(us=None, seq=None, command=None, forced=None, row=None, is_told=True, entered_us=-1_000_000, entered_command="ls")
    got = [r["row"] for r in accept.handleInputRows((KEY, 0), iter([entered]), None)]
    assert sorted(got) == sorted(expected(rows, 2_000_000, 10**9, -1_000_000, "ls")) and not accept.held.values
