"""Log lines in batch and stream, and the union of sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.operators.audit import parse_audit
from logloom.operators.parsers import parse_auth, parse_shell_history, parse_syslog
from logloom.sources.tail import LogTail
from logloom.storage import BROADCAST_ROWS, stored

#: Sources in the order their events are appended; their event source names are set by the parsers.
SOURCES: dict[str, Callable[[DataFrame], DataFrame]] = {"auditd": parse_audit, "syslog": parse_syslog, "auth": parse_auth, "bash_history": parse_shell_history}


def _shaped(text: DataFrame, source: str, hostname: str | Column | None, agent_id: str | Column | None, seq: Column) -> DataFrame:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v or "")
    return text.select(
        F.lit(source).alias("source"), as_column(hostname).alias("hostname"), as_column(agent_id).alias("agent_id"),
        F.regexp_replace("value", "\r$", "").alias("line"), seq.alias("seq"), F.col("_metadata.file_modification_time").alias("ingest_time"),
    )


def read_lines(spark: SparkSession, source: str, path: str | list[str], hostname: str | Column | None = None, agent_id: str | Column | None = None) -> DataFrame:
    """Complete lines of ``path``; only a line feed ends a line, and one carriage return before it goes.

    ``seq`` orders the lines of a file: rows of one file block are in one
    partition in file order. See :func:`read_rolled` for an order across files. ``hostname`` may be a column, such as a part of
    ``_metadata.file_path``.
    """
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}")
    text = spark.read.text(path, lineSep="\n").select("value", "_metadata")
    return _shaped(text, source, hostname, agent_id, F.monotonically_increasing_id())


def stream_lines(spark: SparkSession, source: str, path: str, state: str, hostname: str | Column | None = None, agent_id: str | Column | None = None, from_begin: bool = False, **options: str) -> DataFrame:
    """New lines of the growing files at ``path`` as a stream (see :mod:`logloom.sources.tail`).

    The first start begins at the end of the files that are there, or with ``from_begin`` at
    their beginning; ``state`` is a folder that belongs to this tail. ``seq`` orders the lines of
    a folder over rotations: the file's number, then the byte. ``ingest_time`` is
    when the file had last changed as the lines were first seen.
    """
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}")
    spark.dataSource.register(LogTail)
    # Sources in Python else run as a single batch where all that is available is asked for, without the one that moves the watermark on.
    spark.conf.set("spark.sql.streaming.triggerAvailableNowWrapper.enabled", "true")
    rows = spark.readStream.format("log_tail").options(path=path, state=state, fromBegin=str(from_begin).lower(), **options).load()
    meta = F.struct(F.concat(F.when(~F.col("path").contains("://"), F.lit("file://")).otherwise(""), "path").alias("file_path"), F.timestamp_millis("modified_ms").alias("file_modification_time"))
    at = F.when((F.shiftright("offset", OFFSET_BITS) == 0) & (F.shiftright("file_order", 63 - OFFSET_BITS) == 0), F.shiftleft("file_order", OFFSET_BITS) + F.col("offset"))
    seq = F.coalesce(at, F.raise_error(F.lit("a log file of 16 TB, or more than 500,000 files of one folder, have no order")).cast("long"))
    return _shaped(rows.withColumn("_metadata", meta), source, hostname, agent_id, seq)


#: Bits of ``seq`` in a stream for the byte in a file.
OFFSET_BITS = 44


def read_rolled(spark: SparkSession, source: str, path: str | list[str], hostname: str | Column | None = None, agent_id: str | Column | None = None) -> DataFrame:
    """Rolled files in batch, with line numbers as ``seq`` that go on from file to file of a folder.

    Files split as ever. Each block of a file counts its lines, one row a block; a sum over the
    blocks before it, by file time, rotation number (the greater is older), name and place,
    gives its first line's number, which goes to the block's rows. Numbers are dense in a folder.
    """
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}")
    text = spark.read.text(path, lineSep="\n").select("value", "_metadata", F.monotonically_increasing_id().alias("_row"))
    block = {"_file": F.col("_metadata.file_path"), "_from": F.col("_metadata.file_block_start")}
    text = text.withColumns(block)
    counted = text.groupBy("_file", "_from", F.col("_metadata.file_modification_time").alias("_time")).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    folder = F.regexp_extract("_file", "^(.*)/[^/]*$", 1)
    rolled = -F.coalesce(F.regexp_extract("_file", "\\.([0-9]{1,5})$", 1).try_cast("int"), F.lit(0))
    before = Window.partitionBy(folder).orderBy("_time", rolled, "_file", "_from").rowsBetween(Window.unboundedPreceding, -1)
    shifts = stored(counted.select("_file", "_from", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")), "blocks")
    few = shifts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = text.join(F.broadcast(shifts) if few else shifts.hint("merge"), ["_file", "_from"])
    return _shaped(rows, source, hostname, agent_id, F.col("_row") + F.col("_shift"))


def collect_events(lines_by_source: dict[str, DataFrame], audit_mode: str = "complete") -> DataFrame:
    """Events of all given sources appended in the fixed order of sources; no shuffle but the audit merge's."""
    parsed = [parse_audit(lines_by_source[s], audit_mode) if s == "auditd" else parse(lines_by_source[s]) for s, parse in SOURCES.items() if s in lines_by_source]
    if not parsed:
        raise ValueError("no known source is given")
    out = parsed[0]
    for more in parsed[1:]:
        out = out.unionByName(more)
    return out
