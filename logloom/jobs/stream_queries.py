"""Queries on tails, rolled files and streams; each reads lines made of the given tables, written as files."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import audit_serial
from logloom.jobs import fixtures as fx
from logloom.operators.audit import merge_audit
from logloom.operators.filters import dedupe_consecutive
from logloom.operators.parsers import parse_auth, parse_shell_history
from logloom.schemas import EVENT_FIELDS, FilterSettings
from logloom.sources.lines import read_rolled, stream_lines
from logloom.storage import session_dir
from logloom.streaming.alerts import ROCKSDB, audit_events, write_documents
from logloom.streaming.limits import stream_filter
from logloom.streaming.payloads import insert_into_table, stream_payloads, write_payloads
from logloom.tables import DocumentTable


def _host() -> Column:
    return F.regexp_extract("_metadata.file_path", "/host=([^/]+)/", 1)


def new_path(s: SparkSession, name: str) -> str:
    return f"{session_dir(s)}/{uuid.uuid4().hex}/{name}"


def _written(lines: DataFrame, path: str) -> None:
    """Files in a folder for each host."""
    lines.select("host", "line").write.mode("append").partitionBy("host").text(path)


def _replayed(s: SparkSession, lines: DataFrame, source: str, events: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Lines written as files and tailed from their beginning, to the documents that the stream writes."""
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    path = new_path(s, "replay")
    _written(lines, f"{path}/logs")
    write_documents(events(stream_lines(s, source, f"{path}/logs", f"{path}/tail", _host(), fx.AGENT, from_begin=True)), f"{path}/out", f"{path}/state").awaitTermination()
    return s.read.parquet(f"{path}/out")


def streamed_audit(s: SparkSession, d: str) -> DataFrame:
    """Records of a group are in one file in order. Records of a year later move the watermark past all others."""
    lines = fx.audit_lines(s, d).withColumns({"host": F.col("hostname"), "serial": audit_serial(F.col("line"))})
    lines = lines.repartitionByRange("host", "serial").sortWithinPartitions("host", "serial", "seq")
    end = [f"type={kind} msg=audit(1900000000.000:0): end=1" for kind in ("AVC", "SYSCALL", "USER_LOGIN")]
    lines = lines.select("host", "line").unionByName(s.range(1).select(F.lit("end").alias("host"), F.explode(F.array(*[F.lit(r) for r in end])).alias("line")))
    out = _replayed(s, lines, "auditd", audit_events).where("timestamp < '2030'")
    return out.select("timestamp", "hostname", "event_type", "process", "severity", "user", "command", "raw_log")


def streamed_limits(s: SparkSession, d: str) -> DataFrame:
    """Authentication events, at most one in six hours of each key, but all failures; the files hold them in no order."""
    settings = FilterSettings(rate_limit_window_sec=21600, keep_if_raw_contains=("Failed password",))
    lines = fx.auth_lines(s, d).withColumn("host", F.col("hostname"))
    lines = lines.repartition(8, F.xxhash64("line")).sortWithinPartitions(F.xxhash64("line")).select("host", "line")
    end = s.range(1).select(F.lit("end").alias("host"), F.lit("2090-01-01T00:00:00Z end sshd[7]: bye").alias("line"))
    out = _replayed(s, lines.unionByName(end), "auth", lambda rows: stream_filter(parse_auth(rows), settings, "1 day")).where("timestamp < '2090'")
    return out.select("timestamp", "hostname", "event_type", "process", "severity", "user", "ip", "raw_log")


def streamed_hot_key(s: SparkSession, d: str) -> DataFrame:
    """Authentication events of which most have one rate key, at most one in an hour; the key has a state for each day."""
    settings = FilterSettings(rate_limit_window_sec=3600)
    failed = F.col("line").contains("Failed password")
    closed = F.concat(F.substring_index("line", " ", 1), F.lit(" web01 sudo: pam_unix(sudo:session): session closed for user root"))
    lines = fx.auth_lines(s, d).select(F.when(failed, F.col("hostname")).otherwise("web01").alias("host"), F.when(failed, F.col("line")).otherwise(closed).alias("line"))
    lines = lines.repartition(8, F.xxhash64("line")).sortWithinPartitions(F.xxhash64("line"))
    end = s.range(1).select(F.lit("end").alias("host"), F.lit("2090-01-01T00:00:00Z end sshd[7]: bye").alias("line"))
    out = _replayed(s, lines.unionByName(end), "auth", lambda rows: stream_filter(parse_auth(rows), settings, "1 day", slice_sec=86_400)).where("timestamp < '2090'")
    return out.select("timestamp", "hostname", "event_type", "user", "ip")


def tailed(s: SparkSession, d: str) -> DataFrame:
    """A tail that starts when the files hold the ``view`` lines, reads what comes, and goes on after a restart."""
    path = new_path(s, "tail")
    lines = fx.auth_lines(s, d).withColumns({"host": F.col("hostname"), "kind": F.when(F.col("line").contains("session opened"), 0).when(F.col("line").contains("sshd"), 1).otherwise(2)})

    def run() -> None:
        rows = stream_lines(s, "auth", f"{path}/logs", f"{path}/tail", _host(), fx.AGENT, blockBytes="200000")
        write_documents(parse_auth(rows), f"{path}/out", f"{path}/state").awaitTermination()

    for kind in range(3):
        _written(lines.where(F.col("kind") == kind), f"{path}/logs")
        run()
    return s.read.parquet(f"{path}/out").select("timestamp", "hostname", "event_type", "severity", "user", "ip", "raw_log")


def _rolled(s: SparkSession, lines: DataFrame, path: str, files: int) -> None:
    """Lines in order in files that were last changed a minute after each other."""
    lines.repartitionByRange(files, "seq").sortWithinPartitions("seq").select("line").write.text(path)
    jvm = s.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/part-*")
    fs = pattern.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    for i, f in enumerate(sorted(fs.globStatus(pattern), key=lambda f: f.getPath().getName())):
        fs.setTimes(f.getPath(), 1_700_000_000_000 + 60_000 * i, -1)


def rolled_order(s: SparkSession, d: str) -> DataFrame:
    """Shell history in rolled files: numbered over all of them, so what repeats across two files is seen."""
    path = new_path(s, "history")
    _rolled(s, fx.shell_lines(s, d), path, 7)
    events = parse_shell_history(read_rolled(s, "bash_history", path, "web01", fx.AGENT))
    return dedupe_consecutive(events).select("command", "seq")


def rolled_audit(s: SparkSession, d: str) -> DataFrame:
    """Audit records whose groups are torn by rotation, merged as they came."""
    path = new_path(s, "audit")
    _rolled(s, fx.audit_lines(s, d), path, 5)
    lines = read_rolled(s, "auditd", path, "web01", fx.AGENT)
    return merge_audit(lines, "eager").select(*[c for c in EVENT_FIELDS if c != "hostname"], "seq")


def streamed_dedupe(s: SparkSession, d: str) -> DataFrame:
    """Shell history in rolled files through the consecutive rule, a state for each file, as its lines have one time; a file of much later moves the watermark past them."""
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    path = new_path(s, "dedupe")
    _rolled(s, fx.shell_lines(s, d), f"{path}/logs", 5)
    end = new_path(s, "end")
    s.range(1).select(F.lit("exit")).coalesce(1).write.text(end)
    jvm = s.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    (last,) = [f.getPath() for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{end}/part-*"))]
    fs.setTimes(last, 3_786_912_000_000, -1)
    fs.rename(last, jvm.org.apache.hadoop.fs.Path(f"{path}/logs/zz-end"))
    events = parse_shell_history(stream_lines(s, "bash_history", f"{path}/logs", f"{path}/tail", "web01", fx.AGENT, from_begin=True))
    write_documents(stream_filter(events, FilterSettings(dedupe_bash_history=True), slice_sec=1), f"{path}/out", f"{path}/state").awaitTermination()
    return s.read.parquet(f"{path}/out").where("command != 'exit'").select("hostname", "command", "raw_log")


def _until(query, done: Callable[[], bool], seconds: float = 300) -> None:
    """Lets a stream that never ends run until ``done``. A batch may take as long as it needs; batches without new rows for ``seconds`` are an error."""
    seen = idle_since = None
    try:
        while not done():
            if query.exception():
                raise query.exception()
            last = query.lastProgress
            if last and (last["batchId"], last["timestamp"]) != seen:  # a batch has ended
                seen = last["batchId"], last["timestamp"]
                if any(s["startOffset"] != s["endOffset"] for s in last["sources"]):
                    idle_since = None
                elif idle_since is None:
                    idle_since = time.time()
                elif time.time() > idle_since + seconds and not done():
                    raise TimeoutError("the stream did not get there")
            time.sleep(0.3)
    finally:
        for _ in range(100):  # not in the middle of a batch, if that can be helped
            if not query.isActive or not query.status["isTriggerActive"]:
                break
            time.sleep(0.02)
        query.stop()


def streamed_payloads(s: SparkSession, d: str) -> DataFrame:
    """Payloads of the agents of five hosts: full ones at once, the last one of each when the interval is over."""
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    path = new_path(s, "payloads")
    lines = fx.auth_lines(s, d).withColumn("host", F.col("hostname"))
    _written(lines, f"{path}/logs")
    total = lines.count()
    events = parse_auth(stream_lines(s, "auth", f"{path}/logs", f"{path}/tail", _host(), _host(), from_begin=True))
    query = write_payloads(stream_payloads(events, "mydb", 50, 2), f"{path}/out", f"{path}/state", "500 milliseconds")
    schema = "agent_id string, batch_no bigint, n int, payload string"

    def sent() -> DataFrame:
        return s.read.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{path}/out")

    s.range(0).select(F.lit("").alias("agent_id"), F.lit(0).cast("long").alias("batch_no"), F.lit(0).alias("n"), F.lit("").alias("payload")).write.parquet(f"{path}/out/batch=none")
    _until(query, lambda: (sent().agg(F.sum("n")).first()[0] or 0) >= total)
    docs = sent().select("agent_id", "batch_no", "n", F.posexplode(F.from_json(F.get_json_object("payload", "$.data"), "array<map<string,string>>")).alias("place", "doc"))
    return docs.groupBy("agent_id", "batch_no").agg(F.count("*").alias("n"), F.min(F.when(F.col("place") == 0, F.col("doc.timestamp"))).alias("first"), F.max("doc.timestamp").alias("last"))


def streamed_to_table(s: SparkSession, d: str) -> DataFrame:
    """From files to a searchable table: tailed lines, payloads of an agent a host, inserts, and a find by an indexed field."""
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    path = new_path(s, "ingest")
    lines = fx.auth_lines(s, d).withColumn("host", F.col("hostname"))
    _written(lines, f"{path}/logs")
    total = lines.count()
    events = parse_auth(stream_lines(s, "auth", f"{path}/logs", f"{path}/tail", _host(), _host(), from_begin=True))
    query = insert_into_table(stream_payloads(events, "mydb", 500, 2), f"{path}/table", f"{path}/state", "ingest", "500 milliseconds", ("event_type",))
    table = DocumentTable(s, f"{path}/table")
    _until(query, lambda: sum(f["rows"] for f in table.snapshot().files.values()) >= total)
    found = table.find("mydb", '{"event_type":{"$in":["ssh_fail","sudo"]},"user":{"$like":"u1%"}}')
    ids = table.read("mydb").agg(F.countDistinct("_id").alias("ids"), F.max(F.col("_id").cast("long")).alias("last_id"))
    field = lambda c: F.try_element_at("fields", F.lit(c)).alias(c)
    return found.select(field("agent_id"), field("event_type"), field("user"), field("raw_log")).crossJoin(F.broadcast(ids))


QUERIES = {
    "stream_to_table": streamed_to_table,
    "stream_merge_audit": streamed_audit,
    "stream_filter": streamed_limits,
    "stream_hot_key": streamed_hot_key,
    "stream_dedupe": streamed_dedupe,
    "tail_lines": tailed,
    "rolled_order": rolled_order,
    "rolled_audit": rolled_audit,
    "stream_payloads": streamed_payloads,
}
