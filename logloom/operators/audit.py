"""Audit records of one serial merged into events.

Serials restart at a reboot and repeat on other hosts, so a group is
``(hostname, audit time, serial)``. Groups have a few rows each, so they spread
evenly; only the fields a merge needs enter the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import audit_time, kv, sanitize_raw
from logloom.operators.parsers import ISO, audit_columns, is_mergeable, parse_audit_record
from logloom.schemas import CARRIED, EVENT_FIELDS

KEYS = ("hostname", "audit_ts", "serial")
#: Field, and the record types that set it.
FIRST = {"comm": ("AVC", "SYSCALL"), "exe": ("SYSCALL",), "auid": ("SYSCALL",), "uid": ("SYSCALL",), "success": ("SYSCALL",), "exit": ("SYSCALL",), "proctitle": ("PROCTITLE",)}


def merge_rows(lines: DataFrame) -> DataFrame:
    """The mergeable records with their fields; a field that its record type does not set is NULL."""
    line = F.col("line")
    rows = audit_columns(lines).where(is_mergeable())
    fields = {n: F.when(F.col("_type").isin(*types), F.nullif(kv(line, f"{n}="), F.lit(""))) for n, types in FIRST.items()}
    return rows.select(
        F.coalesce("hostname", F.lit("")).alias("hostname"), audit_time(line).alias("audit_ts"), F.col("_serial").alias("serial"), F.col("_type").alias("type"),
        "agent_id", "seq", "ingest_time", "line", *[c.alias(n) for n, c in fields.items()],
    )


def audit_event(groups: DataFrame, event_time: str | None = None, kept: tuple[str, ...] = ()) -> DataFrame:
    """Events of merged groups: ``audit_ts``, ``raw_avc``, ``raw_syscall``, ``raw_proctitle`` and the fields, NULL for absent.

    ``event_time`` names a column of ``groups`` to take the event time from; columns
    ``kept`` of it come after the others.
    """
    denied = F.col("raw_avc").isNotNull() | (F.coalesce("success", F.lit("")) == "no") | F.coalesce("exit", F.lit("")).startswith("-")
    syscall = F.col("raw_syscall").isNotNull()
    raw = F.concat_ws(" | ", "raw_avc", "raw_syscall", "raw_proctitle")
    stamp = F.when(F.col("audit_ts") == "", F.date_format("ingest_time", ISO)).otherwise(F.col("audit_ts"))
    # A time without a fraction gets one.
    stamp = F.regexp_replace(stamp, r"^([^.]{19})Z$", "$1.000Z")
    values = {
        "timestamp": stamp, "hostname": F.col("hostname"), "source": F.lit("auditd"),
        "event_type": F.when(denied, "DENIED").when(syscall, "SYSCALL").otherwise("AUDIT"),
        "process": F.coalesce("comm", "exe", F.lit("")), "severity": F.when(denied, "high").when(syscall, "medium").otherwise("low"),
        "user": F.coalesce(F.concat(F.lit("auid:"), "auid"), F.concat(F.lit("uid:"), "uid"), F.lit("")),
        "command": F.coalesce("exe", "proctitle", F.lit("")), "ip": F.lit(""),
        "raw_log": sanitize_raw(F.when(raw == "", "(merged audit event)").otherwise(raw)),
    }
    out = groups.select(*[values[f].alias(f) for f in EVENT_FIELDS], "agent_id", "seq", "ingest_time", *([F.col(event_time).alias("event_time"), *kept] if event_time else []))
    if event_time:
        return out.select(*EVENT_FIELDS, *CARRIED, *kept)
    return out.withColumn("event_time", F.coalesce(F.try_to_timestamp("timestamp"), "ingest_time")).select(*EVENT_FIELDS, *CARRIED)


def _complete(rows: DataFrame) -> DataFrame:
    first = [F.min_by(n, F.when(F.col(n).isNotNull(), F.col("seq"))).alias(n) for n in FIRST]
    last = [F.max_by("line", F.when(F.col("type") == t, F.col("seq"))).alias(f"raw_{t.lower()}") for t in ("AVC", "SYSCALL", "PROCTITLE")]
    return rows.groupBy(*KEYS).agg(*first, *last, F.min("seq").alias("seq"), F.min("ingest_time").alias("ingest_time"), F.min("agent_id").alias("agent_id"))


_STATE = "struct<" + ",".join(f"{n}:string" for n in (*FIRST, "raw_avc", "raw_syscall", "raw_proctitle", "agent_id")) + ",seq:bigint,ingest_time:timestamp>"


def _joined(state: Column, row: Column) -> Column:
    """``state`` after ``row``: first value wins for fields, the last line of a type for raw text."""
    fields = [F.coalesce(state[n], row[n]).alias(n) for n in FIRST]
    raws = [F.when(row["type"] == t, row["line"]).otherwise(state[f"raw_{t.lower()}"]).alias(f"raw_{t.lower()}") for t in ("AVC", "SYSCALL", "PROCTITLE")]
    return F.struct(*fields, *raws, F.coalesce(state["agent_id"], row["agent_id"]).alias("agent_id"), F.coalesce(state["seq"], row["seq"]).alias("seq"), F.coalesce(state["ingest_time"], row["ingest_time"]).alias("ingest_time"))


def _eager(rows: DataFrame) -> DataFrame:
    """A group ends as soon as it has a SYSCALL and an AVC or PROCTITLE; later records of the serial start a new one."""
    record = F.struct("seq", "type", "line", *FIRST, "agent_id", "ingest_time")
    gathered = rows.groupBy(*KEYS).agg(F.array_sort(F.collect_list(record)).alias("records"))
    empty = F.lit(None).cast(_STATE)
    start = F.struct(F.array().cast(f"array<{_STATE}>").alias("done"), empty.alias("open"))

    def step(acc: Column, row: Column) -> Column:
        now = _joined(acc["open"], row)
        full = now["raw_syscall"].isNotNull() & (now["raw_avc"].isNotNull() | now["raw_proctitle"].isNotNull())
        return F.struct(F.when(full, F.array_append(acc["done"], now)).otherwise(acc["done"]).alias("done"), F.when(~full, now).alias("open"))

    groups = F.aggregate("records", start, step, lambda acc: F.when(acc["open"].isNotNull(), F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))
    return gathered.select(*KEYS, F.explode(groups).alias("g")).select(*KEYS, "g.*")


def merge_audit(lines: DataFrame, mode: str = "complete", emit_empty: bool = False) -> DataFrame:
    """Events of mergeable records. ``complete``: one for each group; ``eager``: as soon as a group can be told.

    With ``emit_empty`` a serial seen only on records that do not merge gives an
    empty merged event, too.
    """
    rows = merge_rows(lines)
    if mode not in ("complete", "eager"):
        raise ValueError(f"mode {mode!r} is neither complete nor eager")
    groups = _complete(rows) if mode == "complete" else _eager(rows)
    events = audit_event(groups)
    if emit_empty:
        others = audit_columns(lines).where((F.col("_serial") >= 0) & ~is_mergeable())
        bare = others.select(F.coalesce("hostname", F.lit("")).alias("hostname"), audit_time(F.col("line")).alias("audit_ts"), F.col("_serial").alias("serial"), "agent_id", "seq", "ingest_time")
        bare = bare.groupBy(*KEYS).agg(F.min("seq").alias("seq"), F.min("ingest_time").alias("ingest_time"), F.min("agent_id").alias("agent_id"))
        bare = bare.join(rows.select(*KEYS).distinct(), list(KEYS), "left_anti")
        nothing = [F.lit(None).cast("string").alias(n) for n in (*FIRST, "raw_avc", "raw_syscall", "raw_proctitle")]
        events = events.unionByName(audit_event(bare.select("*", *nothing)))
    return events


def parse_audit(lines: DataFrame, mode: str = "complete") -> DataFrame:
    """All events of audit lines: merged groups and single records."""
    single = audit_columns(lines).where(~is_mergeable())
    return merge_audit(lines, mode).unionByName(parse_audit_record(single))
