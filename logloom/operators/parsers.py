"""Log lines to events: pure column expressions for batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import after, audit_serial, audit_time, between, contains_any, kv, leading_iso, sanitize_raw, with_iso_utc
from logloom.schemas import CARRIED, EVENT_FIELDS

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _ingest() -> Column:
    return F.date_format("ingest_time", ISO)


def normalize_events(df: DataFrame, local_tz: str = "UTC") -> DataFrame:
    """Times to UTC, raw text sanitised, empty source, type and severity given their defaults."""
    default = lambda c, v: F.when(F.col(c) == "", v).otherwise(F.col(c))
    return with_iso_utc(df, "timestamp", local_tz).withColumns({
        "raw_log": sanitize_raw(F.col("raw_log")),
        "source": default("source", "unknown"), "event_type": default("event_type", "raw"), "severity": default("severity", "low"),
    })


def _events(lines: DataFrame, fields: dict[str, Column], source: str) -> DataFrame:
    """Events of ``lines`` with the given fields; what is not given is empty."""
    given = {"hostname": F.coalesce("hostname", F.lit("")), "source": F.lit(source), "raw_log": F.col("line")} | fields
    rows = lines.select(*[given.get(f, F.lit("")).cast("string").alias(f) for f in EVENT_FIELDS], "agent_id", "seq", F.col("ingest_time").alias("_ingest_time"))
    rows = normalize_events(rows)
    return rows.withColumn("event_time", F.coalesce(F.try_to_timestamp("timestamp"), "_ingest_time")).select(*EVENT_FIELDS, *CARRIED)


def _stamped(lines: DataFrame) -> DataFrame:
    """``lines`` with ``_time``, the time at their start or that of ingestion."""
    found = lines.withColumn("_time", leading_iso(F.col("line")))
    return found.withColumn("_time", F.when(F.col("_time") == "", _ingest()).otherwise(F.col("_time")))


def syslog_header(c: Column) -> Column:
    """``struct(program, message)`` of ``time host tag rest``; both empty for fewer parts."""
    shape = r"(?s)^[^ ]* [^ ]* ([^ ]*) (.*)$"
    tag = F.regexp_replace(F.regexp_extract(c, shape, 1), ":$", "")
    rest = F.regexp_replace(F.regexp_extract(c, shape, 2), "^: ?", "")
    program = F.regexp_replace(F.regexp_replace(tag, r"(?s)^([^\[\]]*)\[[^\]]*\].*", "$1"), r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")
    return F.struct(program.alias("program"), rest.alias("message"))


def parse_syslog(lines: DataFrame) -> DataFrame:
    rows = _stamped(lines.where("line != ''")).withColumns({"_head": syslog_header(F.col("line")), "_low": F.lower(sanitize_raw(F.col("line")))})
    ident = F.lower(F.col("_head.program"))
    tagged = (F.col("_head.program") != "") & ((ident == F.lower(F.coalesce("hostname", F.lit("")))) | ident.isin("logger", "user", "test"))
    kind = F.when(ident == "cron", "cron_event").when(ident == "systemd", "service_event").when(ident == "kernel", "kernel_event").when(tagged, "user_log").otherwise("syslog_raw")
    severity = (
        F.when(contains_any(F.col("_low"), ("denied", "success=no")), "high")
        .when(contains_any(F.col("_low"), ("failed", "error", "warning")) | (ident == "kernel"), "medium")
        .otherwise("low")
    )
    fields = {
        "timestamp": F.col("_time"), "event_type": kind, "severity": severity, "command": F.col("_head.message"),
        "process": F.when(tagged, "logger").otherwise(F.col("_head.program")), "user": F.when(tagged, F.col("_head.program")).otherwise(""),
    }
    return _events(rows, fields, "syslog")


OPENED = "pam_unix(sudo:session): session opened for user "
CLOSED = "pam_unix(sudo:session): session closed for user "


def parse_auth(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    sudo = line.contains(" sudo: ")
    opened, closed = sudo & line.contains(OPENED), sudo & line.contains(CLOSED)
    failed = line.contains("Failed password") & line.contains(" from ")
    first = lambda a, b: F.when(a != "", a).otherwise(b)
    opener = first(between(line, " by ", "("), F.rtrim(F.substring_index(after(line, " by "), "(", 1)))
    runner = first(between(line, " sudo: ", " :"), between(line, "sudo: ", " :"))
    guest = F.when(line.contains("for invalid user "), between(line, "for invalid user ", " from ")).otherwise(between(line, "for ", " from "))
    # Rules in order; the first that fits decides.
    by_rule = lambda a, b, c, d, e: F.when(opened, a).when(closed, b).when(sudo, c).when(failed, d).otherwise(e)
    none = F.lit("")
    fields = {
        "timestamp": F.col("_time"),
        "event_type": by_rule("user_login", "sudo_session_close", "sudo", "ssh_fail", "auth_raw"),
        "severity": by_rule("medium", "low", "medium", "high", "low"),
        "process": by_rule("pam_unix", "pam_unix", "sudo", "sshd", ""),
        "user": by_rule(opener, none, runner, guest, none),
        "command": by_rule(none, none, after(line, " COMMAND="), none, none),
        "ip": by_rule(none, none, none, first(between(line, " from ", " port "), between(line, " from ", " ")), none),
    }
    return _events(_stamped(lines), fields, "auth.log")


def parse_shell_history(lines: DataFrame) -> DataFrame:
    fields = {"timestamp": _ingest(), "event_type": F.lit("command_history"), "severity": F.lit("low"), "process": F.lit("bash"), "command": F.col("line")}
    return _events(lines.where("line != ''"), fields, "bash_history")


MERGEABLE = ("AVC", "SYSCALL", "PROCTITLE")


def audit_columns(lines: DataFrame) -> DataFrame:
    """Lines with ``_serial`` and ``_type``, which decide between merging and single records."""
    return lines.where("line != ''").withColumns({"_serial": audit_serial(F.col("line")), "_type": kv(F.col("line"), "type=")})


def is_mergeable() -> Column:
    return (F.col("_serial") >= 0) & F.col("_type").isin(*MERGEABLE)


def parse_audit_record(lines: DataFrame) -> DataFrame:
    """Events of single audit records; the caller leaves out those that merge."""
    line = F.col("line")
    rows = lines if "_type" in lines.columns else audit_columns(lines)
    names = ("comm", "exe", "proctitle", "acct", "auid", "uid", "res", "exit")
    rows = rows.withColumns({f"_{n}": kv(line, f"{n}=") for n in names} | {"_time": audit_time(line)})
    v = {n: F.col(f"_{n}") for n in names}
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    tagged = lambda tag, c: F.when(c != "", F.concat(F.lit(tag), c)).otherwise("")
    title = F.col("_type") == "PROCTITLE"
    high = line.contains("DENIED") | line.contains("success=no") | (v["res"] == "failed") | v["exit"].startswith("-")
    process, command = first(v["comm"], v["exe"]), first(v["exe"], v["proctitle"], v["comm"])
    fields = {
        "timestamp": F.when(F.col("_time") == "", _ingest()).otherwise(F.col("_time")),
        "event_type": F.when(F.col("_type") == "", "AUDIT").otherwise(F.col("_type")),
        "process": F.when(title & (process == ""), "auditd").otherwise(process),
        "command": F.when(title & (v["proctitle"] != ""), v["proctitle"]).otherwise(command),
        "user": first(v["acct"], tagged("auid:", v["auid"]), tagged("uid:", v["uid"])),
        "severity": F.when(high, "high").when(F.col("_type").isin("USER_LOGIN", "USER_AUTH", "SYSCALL", "EXECVE"), "medium").otherwise("low"),
    }
    return _events(rows, fields, "auditd")


__all__ = ["audit_columns", "is_mergeable", "normalize_events", "parse_audit_record", "parse_auth", "parse_shell_history", "parse_syslog", "syslog_header"]
