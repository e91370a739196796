"""Logs to reduced events, and the other batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.filters import filter_events
from logloom.schemas import FilterSettings
from logloom.sources.documents import to_event_docs
from logloom.sources.lines import collect_events, read_rolled

#: The shipped filter lists.
SETTINGS = FilterSettings(
    min_severity="low",
    rate_limit_window_sec=3,
    dedupe_bash_history=True,
    keep_if_raw_contains=("DENIED", "success=no", "Failed password", "Invalid user", "sudo:"),
    drop_event_types=("syslog_raw",),
    drop_process_contains=("gnome-shell", "rtkit-daemon", "fwupd"),
    drop_raw_contains=("timed out (service_start_timeout=", "Successfully activated service"),
)


def reduce_logs(lines_by_source: dict[str, DataFrame], settings: FilterSettings = SETTINGS, audit_mode: str = "complete") -> DataFrame:
    """Parsed, merged, normalised and filtered events of all sources."""
    events = collect_events(lines_by_source, audit_mode)
    # A filter is not moved below a projection that numbers rows; moved into the parsers, it would repeat all of their
    # expressions and outgrow what can be compiled.
    rows = events.withColumn("_at", F.monotonically_increasing_id()).where("_at >= 0")
    return filter_events(rows, settings).select(*events.columns)


def run(spark: SparkSession, paths: dict[str, str | list[str]], out: str, settings: FilterSettings = SETTINGS, hostname=None, agent_id: str | None = None, audit_mode: str = "complete") -> None:
    """Log files, rolled ones in their order, to a table of event documents, a folder for each day; never the whole table again."""
    lines = {s: read_rolled(spark, s, p, hostname, agent_id) for s, p in paths.items()}
    docs = to_event_docs(reduce_logs(lines, settings, audit_mode))
    docs.withColumn("event_date", F.substring("timestamp", 1, 10)).write.mode("append").partitionBy("event_date").parquet(out)
