"""Column functions on single values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.functions import text as fn


def apply(spark, c, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(c(F.col("v"))).collect()]


TIMES = {
    "2025-12-26T22:55:51.123456+03:00": "2025-12-26T19:55:51.123Z",
    "2025-12-26 22:55:51": "2025-12-26T22:55:51.000Z",
    "2025-12-26T22:55:51.5Z": "2025-12-26T22:55:51.500Z",
    "2025-02-31T00:00:00Z": "2025-03-03T00:00:00.000Z",
    "2025-12-31T23:59:60Z": "2026-01-01T00:00:00.000Z",
    "2025-12-26T22:55:51+0300": "2025-12-26T22:55:51+0300",
    "2025-12-26T22:55:51.12+03": "2025-12-26T22:55:51.12+03",
    "2025-13-01T00:00:00Z": "2025-13-01T00:00:00Z",
    "Dec 26 22:55:51": "Dec 26 22:55:51",
    "  2025-12-26T22:55:51-01:30 rest ": "2025-12-27T00:25:51.000Z",
    "2025-12-26T22:55:51.1234567Z": "2025-12-26T22:55:51.123Z",
    "": "",
}


def test_to_iso_utc(spark):
    assert apply(spark, fn.to_iso_utc, TIMES) == list(TIMES.values())
    assert apply(spark, lambda c: fn.to_iso_utc(c, "Europe/Paris"), ["2025-07-01T12:00:00", "2025-07-01T12:00:00Z", None]) == ["2025-07-01T10:00:00.000Z", "2025-07-01T12:00:00.000Z", None]


def test_fields(spark):
    line = 'type=SYSCALL msg=audit(1700000000.1239:456): auid=1000 uid=7 comm="c d" q=\'x y\' bad="open'
    assert apply(spark, lambda c: fn.kv(c, "uid="), [line]) == ["1000"]
    assert apply(spark, lambda c: fn.kv(c, "comm="), [line, "comm=x", "none"]) == ["c d", "x", ""]
    assert apply(spark, lambda c: fn.kv(c, "q="), [line]) == ["x y"]
    assert apply(spark, lambda c: fn.kv(c, "bad="), [line]) == [""]
    assert apply(spark, fn.audit_time, [line, "none", "msg=audit(5:1)", "msg=audit(x.1:1)"]) == ["2023-11-14T22:13:20.123Z", "", "1970-01-01T00:00:05Z", ""]
    assert apply(spark, fn.audit_serial, [line, "msg=audit(1.2:x)", "msg=audit(12)", "a"]) == [456, -1, -1, -1]
    assert apply(spark, lambda c: fn.between(c, "(", ")"), ["a(b)c)", "(b", "b)"]) == ["b", "", ""]
    assert apply(spark, lambda c: fn.after(c, "x"), ["axbx", "a"]) == ["bx", ""]
    assert apply(spark, fn.leading_iso, ["2025-12-26T22:55:51Z h", "2025-12-26T22:55:51Z", "x"]) == ["2025-12-26T22:55:51Z", "", ""]
    assert apply(spark, fn.db_trim, [" \t a b\n\r"]) == ["a b"]
    assert apply(spark, fn.is_int_string, [" +25 ", "-1", "2.5", "", "+"]) == [True, True, False, False, False]
    assert apply(spark, lambda c: fn.contains_any(c, ["a.c", ""]), ["xa.cx", "abc"]) == [True, False]
    assert apply(spark, lambda c: fn.contains_any(c, []), ["a"]) == [False]
    assert apply(spark, fn.severity_rank, ["high", "medium", "low", "x"]) == [2, 1, 0, 0]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_sanitize_is_idempotent(spark_session_text, values):
    once = apply(spark_session_text, fn.sanitize_raw, values)
    assert apply(spark_session_text, fn.sanitize_raw, once) == once
    assert all(not any(ord(ch) < 32 or ch in '"\\\x7f' for ch in t) and not t.endswith(" ") for t in once)


@pytest.fixture(scope="module")
def spark_session_text(spark):
    return spark
