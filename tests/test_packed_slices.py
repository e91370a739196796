"""Events of a slice reach and leave the stateful operators packed, so that Python takes and gives few rows of Spark."""

import random

import pyarrow as pa
from pyspark.sql import Row

from logloom.streaming.sliced_limits import PACKED_ROWS, AcceptPacked, FollowBucket, TellPacked, _packing, _unpacking
from tests.test_held_rows import Handle, expected
from tests.test_limit_buckets import key

WIDTH = 60_000_000


def made(n):
    rng = random.Random(n)
    return [{"bucket": i % 50 % 2, "key": key(i % 50), "us": rng.randrange(2 * 60_000) * 1000, "seq": i, "command": rng.choice(("ls", "pwd", "")), "forced": i % 100 == 99, "row": f"row {i}"} for i in range(n)]


def elements(rows, cut):
    rows = [r | {"slice": r["us"] // WIDTH, "passed": r["us"]} for r in rows]
    t = pa.Table.from_pylist(rows)
    t = t.set_column(t.column_names.index("passed"), "passed", t["passed"].cast(pa.timestamp("us", "UTC")))
    return [Row(**r, entered=None) for b in _packing(iter(t.to_batches(max_chunksize=cut))) for r in b.to_pylist()]


def test_packed_slices_equal_plain_rules():
    rows, settings, out, rows_out = made(45_000), (3, True, 0, 60), [], 0
    packed = elements(rows, 10_000)
    # Of each run of rows: two buckets and slices, and forced ones of one bucket.
    assert len(packed) == 6 * -(-len(rows) // PACKED_ROWS)
    assert packed == elements(rows, 777)  # the two readings agree, however batches are cut
    for bucket in range(2):
        follow = FollowBucket(*settings)
        follow.init(Handle())
        for number in range(2):
            tell, accept = TellPacked(*settings), AcceptPacked(*settings)
            tell.init(Handle())
            accept.init(Handle())
            own = [e for e in packed if (e["bucket"], e["slice"]) == (bucket, number)]
            assert all(e["passed"].timestamp() * 1e6 // WIDTH == number for e in own)
            list(tell.handleInputRows((bucket, number), (e for e in own if not e["forced"]), None))
            got = list(accept.handleInputRows((bucket, number), iter(own), None))
            (ways,) = tell.handleExpiredTimer((bucket, number), None, None)
            (told,) = follow.handleInputRows((bucket,), iter([ways]), None)
            got += accept.handleInputRows((bucket, number), iter([Row(entered=told["entered"])]), None)
            assert not accept.held.values and not tell.rows.values
            rows_out += len(got)
            out += [r for b in _unpacking([pa.RecordBatch.from_pylist([g.asDict() for g in got])]) for r in b.to_pylist()]
    assert rows_out <= len(packed)
    of = lambda i: [r if i % 2 else r | {"command": ""} for r in rows if r["key"] == key(i)]
    want = sorted(x for i in range(50) for x in expected(of(i), 3_000_000, 10**9)) + [r["row"] for r in rows if r["forced"]]
    assert sorted(r["row"] for r in out) == sorted(want)
    assert {(r["key"], r["us"], r["row"]) for r in out} <= {(r["key"], r["us"], r["row"]) for r in rows}
