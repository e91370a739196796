"""Column functions on log text and times. All are built-in expressions; none raises on bad input.

The session time zone must be UTC, as for all jobs of the library.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(text: str) -> str:
    """``text`` as a regular expression that matches just it."""
    return "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else f"\\{c}" for c in text)


ZONE = r"[+-](?:[01][0-9]|2[0-3]):[0-5][0-9]"
#: Date and time with their ranges, any fraction, and either a whole offset or text that begins with no sign.
ISO_TIME = (
    r"(?s)^[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])[T ](?:[01][0-9]|2[0-3]):[0-5][0-9]:(?:[0-5][0-9]|60)"
    rf"(?:\.[0-9]*+)?+(?:{ZONE}.*|[^+-].*)?$"
)


def _offset(zone: Column) -> Column:
    """Seconds of an offset like ``-03:30``."""
    size = F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 5, 2).try_cast("int") * 60
    return size * F.when(zone.startswith("-"), -1).otherwise(1)


def _iso(c: Column, t: Column, zone: Column, is_iso: Column, local_tz: str) -> Column:
    number = lambda at, n: F.substring(t, at, n).try_cast("int")
    day = F.unix_date(F.to_date(F.concat(F.substring(t, 1, 8), F.lit("01")))) + number(9, 2) - 1
    rolled = day.cast("long") * 86400 + number(12, 2) * 3600 + number(15, 2) * 60 + number(18, 2)
    # Nearly all times are of a day and second that exist; only others are put together from their parts.
    seconds = F.coalesce(F.unix_seconds(F.substring(t, 1, 19).try_cast("timestamp")), rolled)
    instant = F.timestamp_seconds(seconds - F.when(F.length(zone) < 6, 0).otherwise(_offset(zone)))
    if local_tz != "UTC":
        instant = F.when(zone == "", F.to_utc_timestamp(instant, local_tz)).otherwise(instant)
    ms = F.rpad(F.regexp_extract(t, r"^.{19}\.([0-9]{0,3})", 1), 3, "0")
    return F.when(is_iso, F.concat(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), ms, F.lit("Z"))).otherwise(c)


def _zone(t: Column) -> Column:
    return F.regexp_extract(t, rf"^.{{19}}(?:\.[0-9]*+)?+(Z|{ZONE})", 1)


def _trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def to_iso_utc(c: Column, local_tz: str = "UTC") -> Column:
    """An ISO time in any zone as ``YYYY-MM-DDTHH:MM:SS.mmmZ``; anything else unchanged.

    Days beyond the month's end and second 60 roll over. Without a zone the time
    is one of ``local_tz``. One pattern checks all ranges, so the parts are plain
    substrings and the generated code stays small.
    """
    t = _trimmed(c)
    return _iso(c, t, _zone(t), t.rlike(ISO_TIME), local_tz)


def with_iso_utc(df: DataFrame, name: str, local_tz: str = "UTC") -> DataFrame:
    """``df`` with :func:`to_iso_utc` of column ``name``; its parts are columns of projections before, so each is computed once."""
    t = df.withColumn("_iso_t", _trimmed(F.col(name)))
    parts = t.withColumns({"_iso_zone": _zone(F.col("_iso_t")), "_iso_is": F.col("_iso_t").rlike(ISO_TIME)})
    return parts.withColumn(name, _iso(F.col(name), F.col("_iso_t"), F.col("_iso_zone"), F.col("_iso_is"), local_tz)).drop("_iso_t", "_iso_zone", "_iso_is")


def sanitize_raw(c: Column) -> Column:
    """Control characters, double quotes and backslashes become blanks; trailing blanks go."""
    return F.rtrim(F.regexp_replace(c, r'[\x00-\x1F\x7F"\\]', " "))


def db_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r"))


def between(c: Column, a: str, b: str) -> Column:
    """What stands after the first ``a`` up to the next ``b``; empty if either is missing."""
    return F.regexp_extract(c, f"(?s){literal(a)}(.*?){literal(b)}", 1)


def after(c: Column, a: str) -> Column:
    return F.regexp_extract(c, f"(?s){literal(a)}(.*)", 1)


def kv(c: Column, key: str) -> Column:
    """Value at the first occurrence of ``key`` (with its ``=``), unquoted; an unclosed quote gives an empty value."""
    value = F.regexp_extract(c, literal(key) + r"""("[^"]*"|'[^']*'|[^\s"']\S*)?""", 1)
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")


def leading_iso(c: Column) -> Column:
    """The text before the first blank if it has the shape of an ISO time, else empty."""
    return F.regexp_extract(c, r"^([^ ]{4}-[^ ]{2}-[^ ]{2}T[^ ]{8,}) ", 1)


def _audit_inside(c: Column) -> Column:
    return F.regexp_extract(c, r"msg=audit\(([^)]*)\)", 1)


def audit_time(c: Column) -> Column:
    """Time of ``msg=audit(SEC.FRAC:SERIAL)`` as ISO text in UTC; empty when missing."""
    stamp = F.substring_index(_audit_inside(c), ":", 1)
    seconds = F.regexp_extract(stamp, r"^\s*([+-]?[0-9]+)", 1).try_cast("long")
    fraction = F.regexp_extract(stamp, r"(?s)^[^.]*\.(.*)$", 1)
    bounded = F.when(seconds.between(-62_000_000_000, 250_000_000_000), seconds)
    shown = F.date_format(F.timestamp_seconds(bounded), "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(F.concat(shown, F.when(fraction == "", "").otherwise(F.concat(F.lit("."), F.rpad(F.substring(fraction, 1, 3), 3, "0"))), F.lit("Z")), F.lit(""))


def audit_serial(c: Column) -> Column:
    """The integer after the last colon of ``msg=audit(..)``; -1 when there is none."""
    return F.coalesce(F.regexp_extract(_audit_inside(c), r"(?s)^.*:\s*([+-]?[0-9]+)[^:]*$", 1).try_cast("long"), F.lit(-1).cast("long"))


def icontains(c: Column, s: str) -> Column:
    return F.lower(c).contains(s.lower())


def contains_any(c: Column, needles: Iterable[str]) -> Column:
    """True if any needle that is not empty is part of ``c``; false for no needles."""
    return reduce(or_, [c.contains(n) for n in needles if n], F.lit(False))


def severity_rank(c: Column) -> Column:
    return F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)


def is_int_string(c: Column) -> Column:
    return db_trim(c).rlike("^[+-]?[0-9]+$")
