"""Keys of a bucket share the states of their slices, and each key is limited as by a state of its own."""

import json
import random

from pyspark.sql import Row

from logloom.streaming.sliced_limits import AcceptBucket, FollowBucket, TellBucket
from tests.test_held_rows import Handle, Mark, expected


class Expired(Mark):
    getExpiryTimeInMs = Mark.getCurrentWatermarkInMs


def key(i):
    return json.dumps(["h", "bash_history" if i % 2 else "auth", "", "", f"u{i}", ""])


def test_keys_of_a_bucket_share_states():
    rng, settings, width = random.Random(4), (3, True, 0, 60), 60_000_000
    rows = [Row(key=key(i % 50), us=rng.randrange(4 * 60_000) * 1000, seq=i, command=rng.choice(("ls", "pwd", "")), forced=i % 100 == 99, row=f"row {i}", entered=None) for i in range(6000)]
    follow, follow_handle, out, elements = FollowBucket(*settings), Handle(), [], 0
    follow.init(follow_handle)
    for number in range(4):
        tell, accept, handle = TellBucket(*settings), AcceptBucket(*settings), Handle()
        tell.init(handle)
        accept.init(Handle())
        own = [r for r in rows if r["us"] // width == number]
        list(tell.handleInputRows((0, number), (r for r in own if not r["forced"]), None))
        forced = [r["row"] for r in accept.handleInputRows((0, number), iter(own), None)]
        assert forced == [r["row"] for r in own if r["forced"]]
        elements += len(tell.rows.values) + len(accept.held.values) + len(handle.timers)
        (ways,) = tell.handleExpiredTimer((0, number), None, None)
        (told,) = follow.handleInputRows((0,), iter([ways]), None)
        out += [r["row"] for r in accept.handleInputRows((0, number), iter([Row(key=None, entered=told["entered"])]), None)]
        assert not accept.held.values and not tell.rows.values
    assert elements == 4 * 3 and len(follow_handle.timers) == 1  # not one for each of 50 keys
    # `expected` dedupes all; of a source without commands to dedupe they are empty.
    of = lambda i: [r if i % 2 else Row(**(r.asDict() | {"command": ""})) for r in rows if r["key"] == key(i)]
    assert sorted(out) == sorted(x for i in range(50) for x in expected(of(i), 3_000_000, 10**9))
    due = follow_handle.timers.pop()
    list(follow.handleExpiredTimer((0,), None, Expired(due)))
    assert not follow_handle.timers  # only the last commands of shell keys stay
