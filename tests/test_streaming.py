"""Streams give what batch gives, one file a micro-batch, also after a restart."""

import datetime as dt

import pytest

from logloom.operators.audit import merge_audit
from logloom.operators.filters import dedupe_consecutive, filter_events, rate_limit
from logloom.operators.parsers import parse_shell_history
from logloom.schemas import FilterSettings
from logloom.sources.lines import collect_events, read_lines, read_rolled, stream_lines
from logloom.streaming.alerts import audit_events, denial_alerts, write_documents
from logloom.streaming.limits import stream_filter


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\rx\nthree")
    rows = read_lines(spark, "auth", str(tmp_path), "h", "me").orderBy("seq").collect()
    assert [r["line"] for r in rows] == ["one", "two\rx", "three"] and rows[0]["hostname"] == "h"
    assert collect_events({"auth": read_lines(spark, "auth", str(tmp_path))}).count() == 3


def record(kind, second, serial, rest):
    return f"type={kind} msg=audit({1_700_000_000 + second}.000:{serial}): {rest}"


def test_audit_stream_equals_batch(spark, tmp_path):
    import os

    parts = [
        [record("AVC", 0, 1, 'comm="a"'), record("SYSCALL", 0, 1, 'success=yes exe="/a"'), record("USER_LOGIN", 1, 2, 'acct="bob"')],
        [record("PROCTITLE", 0, 1, 'proctitle="late title"'), record("SYSCALL", 2, 3, "success=no"), record("AVC", 3, 4, 'comm="only"')],
        [record("PROCTITLE", 200, 5, 'proctitle="z"')],
        [record("USER_LOGIN", 500, 6, 'acct="end"')],
        [record("SYSCALL", 900, 7, "success=yes"), record("AVC", 900, 7, 'comm="q"'), record("USER_LOGIN", 900, 8, 'acct="x"')],
    ]
    logs = tmp_path / "logs"
    logs.mkdir()

    def put(upto):
        for i, rows in enumerate(parts[:upto]):
            f = logs / f"{i}.log"
            if not f.exists():
                f.write_text("".join(r + "\n" for r in rows))
                os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))

    for upto in (2, 4, 5):  # each run goes on from the checkpoint
        put(upto)
        lines = stream_lines(spark, "auditd", str(logs), str(tmp_path / "tail"), "h", "me", from_begin=True)
        write_documents(audit_events(lines), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = sorted(r["raw_log"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = read_rolled(spark, "auditd", str(logs), "h", "me")
    expected = sorted(r["raw_log"] for r in merge_audit(batch, "eager").collect())
    singles = [r for r in got if "USER_LOGIN" in r]
    assert sorted(set(got) - set(singles)) == sorted(set(expected)) and len(singles) == 3


def test_limits_stream_equals_batch(spark, tmp_path):
    """Files in any order, over three runs: what is late by less than the delay is in its place."""
    import os

    from pyspark.sql import functions as F

    settings = FilterSettings(rate_limit_window_sec=3, dedupe_bash_history=True, keep_if_raw_contains=("keep",))
    logs = tmp_path / "logs"
    logs.mkdir()
    commands = ["ls", "ls", "pwd", "keep", "ls", "cd", "cd", "who", "ls", "date", "w", "w", "ls", "top", "ls", "id"]

    def put(places):
        for i in places:
            f = logs / f"{i:02}.log"
            f.write_text(commands[i] + "\n")
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))

    def run():
        lines = stream_lines(spark, "bash_history", str(logs), str(tmp_path / "tail"), "h", "me", from_begin=True)
        events = parse_shell_history(lines)
        query = stream_filter(events, settings, "8 seconds").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
        assert query.awaitTermination(120)

    for places in ((3, 0, 5, 6), (1, 2, 9, 4), (8, 7, 12, 10), (11, 15, 13, 14)):
        put(places)
        run()
    (logs / "end.log").write_text("bye\n")
    os.utime(logs / "end.log", (1_700_001_000, 1_700_001_000))
    run()
    batch = parse_shell_history(read_rolled(spark, "bash_history", [str(logs / f"{i:02}.log") for i in range(len(commands))], "h"))
    expected = sorted((r["command"], r["event_time"]) for r in filter_events(batch, settings).collect())
    got = sorted((r["command"], r["event_time"]) for r in spark.read.parquet(str(tmp_path / "out")).where("command != 'bye'").collect())
    assert got == expected and expected[0][1] < dt.datetime(2030, 1, 1)


def test_audit_stream_at_a_slow_watermark(spark, tmp_path):
    """The watermark stops between a group's time and the end of its hold; the group comes out later, and the limit takes it in its place."""
    import os

    logs = tmp_path / "logs"
    logs.mkdir()
    times = [(0, 10.5), (11,), (12.5, 1.5), (15,), (40,), (100,)]
    settings = FilterSettings(rate_limit_window_sec=1)
    for i, seconds in enumerate(times):
        lines = []
        for j, second in enumerate(seconds):
            stamp = f"{1_700_000_000 + int(second)}.{int(second * 1000) % 1000:03}"
            lines += [f'type=AVC msg=audit({stamp}:{10 * i + j}): comm="a"', f'type=USER_LOGIN msg=audit({stamp}:{100 + 10 * i + j}): acct="bob"']
        f = logs / f"{i}.log"
        f.write_text("".join(r + "\n" for r in lines))
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
        rows = stream_lines(spark, "auditd", str(logs), str(tmp_path / "tail"), "h", "me", from_begin=True)
        denial_alerts(rows, str(tmp_path / "out"), str(tmp_path / "ck"), settings).awaitTermination(120)
    got = sorted(r["timestamp"][:21] for r in spark.read.parquet(str(tmp_path / "out")).where("event_type = 'DENIED'").collect())
    batch = merge_audit(read_rolled(spark, "auditd", str(logs), "h", "me"), "eager")
    expected = sorted(r["timestamp"][:21] for r in filter_events(batch, settings).collect())
    assert got == expected[:-1] and len(expected) == 7  # the last one is still held


@pytest.mark.parametrize("slice_sec, window, dedupe", [(8, 3, True), (4, 9, False), (5, 0, True)])
def test_sliced_limits_equal_batch(spark, tmp_path, slice_sec, window, dedupe):
    """Slices longer and shorter than the window; one key has nearly all rows; three runs, each goes on from the checkpoint."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(slice_sec)
    rows = []
    for i in range(400):
        host = "hot" if rng.random() < 0.9 else f"h{rng.randrange(3)}"
        at = rng.choice((i // 3, i / 4, i * 1.0001))
        rows.append((round((1_700_000_000 + at) * 1_000_000), host, "bash_history" if host != "h0" else "auth", rng.choice(("ls", "ls", "pwd", "")), i))
    rows.sort(key=lambda r: r[0] + rng.randrange(8_000_000))
    settings = FilterSettings(rate_limit_window_sec=window, dedupe_bash_history=dedupe)
    made = spark.createDataFrame(rows, "us long, hostname string, source string, command string, seq long")
    text = {c: F.lit("") for c in ("timestamp", "event_type", "process", "severity", "user", "ip")}
    event = lambda d: d.withColumns(text | {"raw_log": F.lit("x"), "agent_id": F.lit("me"), "event_time": F.timestamp_micros("us")}).drop("us")

    def run(part):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = event(spark.readStream.schema(made.schema).parquet(str(tmp_path / "in")))
        query = stream_filter(events, settings, "20 seconds", slice_sec=slice_sec).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
        assert query.awaitTermination(120)

    for lo in (0, 150, 300):
        run(spark.createDataFrame(rows[lo : lo + (150 if lo < 300 else 100)], made.schema))
    run(spark.createDataFrame([(1_700_010_000_000_000, "end", "auth", "", 9999)], made.schema))
    key = lambda d: sorted((r["hostname"], r["seq"]) for r in d.where("hostname != 'end'").collect())
    order = ("event_time", "seq")
    batch = dedupe_consecutive(event(made), order) if dedupe else event(made)
    expected = key(rate_limit(batch, window))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert key(out) == expected and len(expected) > 20
    # Each state partition writes files of its own number, so one state would have one number.
    assert out.where("hostname = 'hot'").select(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)).distinct().count() == 4


def test_denial_alerts(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("\n".join([record("AVC", 0, 1, 'apparmor="DENIED" comm="a"'), record("SYSCALL", 0, 1, "success=no"), record("USER_LOGIN", 1, 2, 'acct="bob"')]) + "\n")
    late = "\n".join([record("AVC", 9000, 7, 'apparmor="DENIED" comm="z"'), record("SYSCALL", 9000, 7, "success=no"), record("AVC", 90000, 8, "x=1"), record("USER_LOGIN", 90000, 9, "res=failed")])
    (logs / "b.log").write_text(late + "\n")
    lines = stream_lines(spark, "auditd", str(logs), str(tmp_path / "tail"), "h", "me", from_begin=True)
    denial_alerts(lines, str(tmp_path / "out"), str(tmp_path / "ck"), FilterSettings(min_severity="high", rate_limit_window_sec=3)).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("timestamp").collect()
    assert [r["event_type"] for r in rows] == ["DENIED", "DENIED"] and rows[0]["user"] is None and rows[0]["agent_id"] == "me"
