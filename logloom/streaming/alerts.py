"""Audit stream to denial alerts, written as event documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.operators.parsers import audit_columns, is_mergeable, parse_audit_record
from logloom.schemas import FilterSettings
from logloom.sources.documents import to_event_docs
from logloom.streaming.audit_merge import stream_merge_audit
from logloom.streaming.limits import stream_filter

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def audit_events(lines: DataFrame, hold: str = "2 seconds", delay: str = "10 seconds") -> DataFrame:
    """Merged groups and single records of a stream of audit lines; the watermark is that of ``passed``, which is behind ``event_time`` by ``hold`` at most."""
    single = parse_audit_record(audit_columns(lines).where(~is_mergeable())).withColumn("passed", F.col("event_time")).withWatermark("passed", delay)
    return stream_merge_audit(lines, hold, delay).unionByName(single)


def write_documents(events: DataFrame, out: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Appends event documents to ``out``, a folder for each day and batch.

    A batch that is run again after a failure overwrites its own folder, so each
    event is stored once. ``interval`` flushes at that pace; without it all that
    is available is written and the query ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        docs = to_event_docs(batch).withColumn("event_date", F.substring("timestamp", 1, 10))
        docs.write.mode("overwrite").partitionBy("event_date").parquet(f"{out}/batch={number}")

    writer = events.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def denial_alerts(lines: DataFrame, out: str, checkpoint: str, settings: FilterSettings, interval: str | None = None, hold: str = "2 seconds") -> StreamingQuery:
    """Single records and merged groups, filtered statelessly and limited, as documents."""
    return write_documents(stream_filter(audit_events(lines, hold), settings, None, "passed", hold), out, checkpoint, interval)
