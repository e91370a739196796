"""Schemas, as DDL text, and settings."""

from __future__ import annotations

from dataclasses import dataclass

LINE = "source string, hostname string, agent_id string, line string, seq bigint, ingest_time timestamp"

EVENT_FIELDS = ("timestamp", "hostname", "source", "event_type", "process", "severity", "user", "command", "ip", "raw_log")
CARRIED = ("agent_id", "seq", "event_time")
EVENT = ", ".join(f"{f} string" for f in EVENT_FIELDS) + ", agent_id string, seq bigint, event_time timestamp"

DOC = "database string, _id string, fields map<string,string>"

#: Fields that a document always has, and those left out when empty.
ALWAYS = ("agent_id", "timestamp", "hostname", "source", "event_type", "severity", "raw_log")
OPTIONAL = ("user", "process", "command", "ip")


@dataclass(frozen=True)
class FilterSettings:
    """What the event filter keeps. Needles are literal parts of the field."""

    min_severity: str = "low"
    drop_empty_raw: bool = True
    rate_limit_window_sec: int = 0
    dedupe_bash_history: bool = False
    keep_if_raw_contains: tuple[str, ...] = ()
    drop_event_types: tuple[str, ...] = ()
    drop_process_contains: tuple[str, ...] = ()
    drop_raw_contains: tuple[str, ...] = ()
