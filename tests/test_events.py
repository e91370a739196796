"""Parsers, audit merge and filters on worked cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logloom.operators import filters, parsers
from logloom.operators.audit import merge_audit
from logloom.schemas import LINE, FilterSettings

NOW = dt.datetime(2026, 1, 1)


def lines(spark, texts, source="x", host="web01"):
    return spark.createDataFrame([(source, host, "a", t, i, NOW) for i, t in enumerate(texts)], LINE)


def shown(df, *columns):
    return [tuple(r) for r in df.orderBy("seq", "command").select(*columns).collect()]


def test_syslog(spark):
    got = shown(parsers.parse_syslog(lines(spark, [
        "2025-12-26T22:55:51.123456+03:00 web01 CRON[812]: (root) CMD (x)", "2025-12-26T22:55:51Z web01 kernel: usb reset", "2025-12-26T22:55:51Z web01 WEB01: hi",
        "2025-12-26T22:55:51Z web01 nginx[9]: Access Denied", "2025-12-26T22:55:51Z web01 systemd[1]: x failed", "oneword", "",
    ])), "timestamp", "process", "user", "event_type", "severity", "command")
    at = "2025-12-26T22:55:51.000Z"
    assert got == [
        ("2025-12-26T19:55:51.123Z", "CRON", "", "cron_event", "low", "(root) CMD (x)"), (at, "kernel", "", "kernel_event", "medium", "usb reset"), (at, "logger", "WEB01", "user_log", "low", "hi"),
        (at, "nginx", "", "syslog_raw", "high", "Access Denied"), (at, "systemd", "", "service_event", "medium", "x failed"), ("2026-01-01T00:00:00.000Z", "", "", "syslog_raw", "low", ""),
    ]


def test_auth(spark):
    head = "2025-12-26T22:55:51Z web01 "
    got = shown(parsers.parse_auth(lines(spark, [head + x for x in [
        "sudo: pam_unix(sudo:session): session opened for user root(uid=0) by alice(uid=1000)", "sudo: pam_unix(sudo:session): session closed for user root", "sudo: alice : TTY=pts/0 ; USER=root ; COMMAND=/bin/ls",
        "sshd[7]: Failed password for invalid user bob from 10.0.0.5 port 2222 ssh2", "sshd[7]: Failed password for root from 10.0.0.6 port 22 ssh2", "sshd[7]: Accepted password for bob from 10.0.0.5 port 22",
        "sudo: pam_unix(sudo:session): session opened for user root by carl  ",
    ]])), "event_type", "severity", "process", "user", "ip", "command")
    assert got == [
        ("user_login", "medium", "pam_unix", "alice", "", ""), ("sudo_session_close", "low", "pam_unix", "", "", ""), ("sudo", "medium", "sudo", "alice", "", "/bin/ls"),
        ("ssh_fail", "high", "sshd", "bob", "10.0.0.5", ""), ("ssh_fail", "high", "sshd", "root", "10.0.0.6", ""), ("auth_raw", "low", "", "", "", ""), ("user_login", "medium", "pam_unix", "carl", "", ""),
    ]


AUDIT = [
    'type=AVC msg=audit(1700000000.123:456): apparmor="DENIED" comm="cat"',
    'type=SYSCALL msg=audit(1700000000.123:456): success=no exit=-13 auid=1000 uid=1000 comm="cat" exe="/bin/cat"',
    'type=PROCTITLE msg=audit(1700000000.123:456): proctitle="cat /x"',
]


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_audit_merge(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rows = lines(spark, AUDIT).repartition(parts)
    columns = ("timestamp", "event_type", "severity", "process", "command", "user")
    merged = ("2023-11-14T22:13:20.123Z", "DENIED", "high", "cat", "/bin/cat", "auid:1000")
    assert shown(merge_audit(rows), *columns) == [merged]
    assert shown(merge_audit(rows, "eager"), *columns) == [merged, ("2023-11-14T22:13:20.123Z", "AUDIT", "low", "", "cat /x", "")]
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    raw = merge_audit(rows).first()["raw_log"]
    assert raw.startswith("type=AVC msg=audit(1700000000.123:456): apparmor= DENIED  comm= cat  | type=SYSCALL") and raw.endswith("proctitle= cat /x")


def test_audit_single_and_empty(spark):
    single = lines(spark, ["type=USER_LOGIN msg=audit(5.1:7): acct=\"bob\" res=failed'", "type=USER_LOGIN msg=audit(5.1:8): acct=\"bob\" res=failed", "junk", ""])
    rows = parsers.parse_audit_record(parsers.audit_columns(single).where(~parsers.is_mergeable()))
    assert shown(rows, "event_type", "severity", "user") == [("USER_LOGIN", "medium", "bob"), ("USER_LOGIN", "high", "bob"), ("AUDIT", "low", "")]
    assert merge_audit(single).count() == 0
    assert [r["raw_log"] for r in merge_audit(single, emit_empty=True).collect()] == ["(merged audit event)"] * 2
    with pytest.raises(ValueError):
        merge_audit(single, "other")


def shell(spark, commands, times=None):
    rows = parsers.parse_shell_history(lines(spark, commands))
    if times:
        at = F.timestamp_seconds(F.element_at(F.array(*map(F.lit, times)), (F.col("seq") + 1).cast("int")))
        rows = rows.withColumn("event_time", at)
    return rows


def test_dedupe(spark):
    assert [c for (c,) in shown(filters.dedupe_consecutive(shell(spark, ["ls", "ls", "pwd", "ls"])), "command")] == ["ls", "pwd", "ls"]


def test_rate_limit(spark):
    times = [0, 1, 3, 4, 5, 6, 9]
    assert [times[s] for (s,) in shown(filters.rate_limit(shell(spark, ["x"] * 7, times), 3), "seq")] == [0, 3, 6, 9]
    settings = FilterSettings(rate_limit_window_sec=3, keep_if_raw_contains=("keep",))
    assert [s for (s,) in shown(filters.filter_events(shell(spark, ["a", "keep", "b", "c"], [0, 1, 2, 3]), settings), "seq")] == [0, 1, 3]


@pytest.mark.parametrize("windows", [1, 2, 1024])
def test_rate_limit_properties(spark, windows, monkeypatch):
    import random

    monkeypatch.setattr(filters, "SLICE_WINDOWS", windows)
    rng = random.Random(4)
    times = sorted(rng.randrange(0, 400) for _ in range(150))
    kept = [times[s] for (s,) in shown(filters.rate_limit(shell(spark, ["x"] * 150, times), 7), "seq")]
    assert all(b - a >= 7 for a, b in zip(kept, kept[1:], strict=False))
    expected, last = [], None
    for t in times:
        if last is None or t - last >= 7:
            expected.append(t)
            last = t
    assert kept == expected


def test_stateless(spark):
    events = parsers.parse_auth(lines(spark, ["x", "", 'say "keep"', "drop it"]))
    settings = FilterSettings(min_severity="low", keep_if_raw_contains=("keep",), drop_event_types=("auth",))
    assert [s for (s,) in shown(filters.filter_stateless(events, settings), "seq")] == [2]
    assert filters.filter_events(events.limit(0), settings).count() == 0
