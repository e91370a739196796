"""The queries of the library and their SQL. Every query reads the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import after, audit_serial, audit_time, between, icontains, is_int_string, kv, leading_iso, sanitize_raw, severity_rank, to_iso_utc
from logloom.jobs import fixtures as fx
from logloom.jobs import stream_queries, table_queries
from logloom.jobs.oracles import SQL
from logloom.jobs.stream_queries import new_path
from logloom.jobs.w1 import SETTINGS, reduce_logs
from logloom.operators import documents as dt
from logloom.operators.audit import merge_audit
from logloom.operators.filters import dedupe_consecutive, drop_empty_raw, filter_events, filter_stateless, is_forced, rate_limit
from logloom.operators.parsers import audit_columns, is_mergeable, normalize_events, parse_audit_record, parse_auth, parse_shell_history, parse_syslog
from logloom.schemas import EVENT_FIELDS, FilterSettings
from logloom.sources.documents import expand_payloads, insert_payloads, load_collection, read_collection, read_payloads, save_collection, to_event_docs, to_json_lines
from logloom.sources.lines import collect_events, read_lines

Query = Callable[[SparkSession, str], DataFrame]


def _shown(events: DataFrame) -> DataFrame:
    return events.select(*EVENT_FIELDS, "seq")


def parse_audit_single(s: SparkSession, d: str) -> DataFrame:
    return _shown(parse_audit_record(audit_columns(fx.audit_lines(s, d)).where(~is_mergeable())))


def iso_times(s: SparkSession, d: str) -> DataFrame:
    e = fx.table(s, d, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (
        F.when(F.col("event_id") % 5 == 0, F.concat(iso, F.lit("+03:00"))).when(F.col("event_id") % 5 == 1, F.concat(F.lit(" "), F.replace(F.substring(iso, 1, 19), F.lit("T"), F.lit(" "))))
        .when(F.col("event_id") % 5 == 2, F.concat(F.substring(iso, 1, 21), F.lit("-00:30 trailing"))).when(F.col("event_id") % 5 == 3, F.concat(iso, F.lit("+0300"))).otherwise(F.concat(F.substring(iso, 1, 4), F.lit("-13-01T00:00:00Z")))
    )
    return e.select("event_id", to_iso_utc(text).alias("iso"))


def sanitized(s: SparkSession, d: str) -> DataFrame:
    return fx.table(s, d, "documents").select("doc_id", sanitize_raw(F.col("text")).alias("clean"))


def normalized(s: SparkSession, d: str) -> DataFrame:
    e = fx.table(s, d, "events")
    blank = lambda c, k: F.when(F.col("event_id") % k == 0, "").otherwise(c)
    rows = e.select(
        "event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("-01:00")).alias("timestamp"), blank(F.lit("syslog"), 2).alias("source"),
        blank(F.col("event_type"), 3).alias("event_type"), blank(F.lit("high"), 5).alias("severity"), F.concat(F.lit('a"b\\c\t'), "props", F.lit(" \n ")).alias("raw_log"),
    )
    return normalize_events(rows)


def text_fields(s: SparkSession, d: str) -> DataFrame:
    line = F.col("line")
    return fx.audit_lines(s, d).select(
        "seq", audit_time(line).alias("time"), audit_serial(line).alias("serial"), kv(line, "uid=").alias("uid"), kv(line, "comm=").alias("comm"), kv(line, "proctitle=").alias("proctitle"),
        between(line, "audit(", ".").alias("seconds"), after(line, "exe=").alias("exe"), leading_iso(line).alias("lead"), icontains(line, "apparmor=\"denied\"").alias("denied"), is_int_string(kv(line, "exit=")).alias("has_exit"),
    )


def _auth(s: SparkSession, d: str) -> DataFrame:
    return parse_auth(fx.auth_lines(s, d))


STATELESS = FilterSettings(min_severity="medium", keep_if_raw_contains=("Accepted password for u1",), drop_event_types=("sudo_session",), drop_process_contains=("pam_",), drop_raw_contains=("10.0.0.9 ",))


def stateless(s: SparkSession, d: str) -> DataFrame:
    return _shown(filter_stateless(_auth(s, d), STATELESS))


def forced(s: SparkSession, d: str) -> DataFrame:
    return _shown(_auth(s, d).where(is_forced(FilterSettings(keep_if_raw_contains=("Failed password", "COMMAND=", "")))))


def empty_raw(s: SparkSession, d: str) -> DataFrame:
    events = _auth(s, d).withColumn("raw_log", F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("raw_log")))
    return _shown(drop_empty_raw(events, FilterSettings()))


def consecutive(s: SparkSession, d: str) -> DataFrame:
    return _shown(dedupe_consecutive(parse_shell_history(fx.shell_lines(s, d))))


def limited(s: SparkSession, d: str) -> DataFrame:
    """One key a host and type, so keys are dense: at most one event an hour of each."""
    events = parse_shell_history(fx.shell_lines(s, d)).withColumns({"event_type": F.substring_index("command", "\t", 1), "hostname": F.concat(F.lit("h"), (F.col("seq") % 4).cast("string"))})
    return rate_limit(events, 3600).select("hostname", "event_type", "seq")


def chain(s: SparkSession, d: str) -> DataFrame:
    settings = FilterSettings(min_severity="low", rate_limit_window_sec=7200, dedupe_bash_history=True, keep_if_raw_contains=("purchase",), drop_raw_contains=("signup 1",))
    events = parse_shell_history(fx.shell_lines(s, d))
    return filter_events(events, settings).select("command", "seq")


def w1(s: SparkSession, d: str) -> DataFrame:
    """The flagship: four sources of raw lines to reduced events, counted by source, type and severity."""
    lines = {"auditd": fx.audit_lines(s, d), "syslog": fx.syslog_lines(s, d), "auth": fx.auth_lines(s, d), "bash_history": fx.shell_lines(s, d)}
    return reduce_logs(lines, SETTINGS).groupBy("source", "event_type", "severity").agg(F.count("*").alias("n"))


def union_sources(s: SparkSession, d: str) -> DataFrame:
    lines = {"bash_history": fx.shell_lines(s, d), "auditd": fx.audit_lines(s, d), "syslog": fx.syslog_lines(s, d), "auth": fx.auth_lines(s, d)}
    return collect_events(lines).groupBy("source", "severity").agg(F.count("*").alias("n"), F.sum(severity_rank(F.col("severity"))).alias("rank_sum"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def event_docs(s: SparkSession, d: str) -> DataFrame:
    return to_event_docs(_auth(s, d))


def json_lines(s: SparkSession, d: str) -> DataFrame:
    return to_json_lines(to_event_docs(parse_shell_history(fx.shell_lines(s, d))).select("agent_id", "command", "user", "severity", "raw_log"))


def payloads(s: SparkSession, d: str) -> DataFrame:
    made = insert_payloads(parse_shell_history(fx.shell_lines(s, d)), "mydb", 7)
    return made.select("agent_id", F.col("batch_no").cast("long").alias("batch_no"), F.size(F.from_json(F.get_json_object("payload", "$.data"), "array<map<string,string>>")).cast("long").alias("n"), F.get_json_object("payload", "$.data[0].command").alias("first"))


def payloads_back(s: SparkSession, d: str) -> DataFrame:
    back = expand_payloads(insert_payloads(_auth(s, d), "mydb", 50))
    return back.select("database", *[F.try_element_at("fields", F.lit(c)).alias(c) for c in ("timestamp", "event_type", "user", "ip", "raw_log")])


def _found(query: str) -> Query:
    return lambda s, d: dt.find(fx.order_docs(s, d), query).select("_id", F.col("fields.mixed").alias("mixed"))


def find_count(s: SparkSession, d: str) -> DataFrame:
    return dt.find_count(fx.order_docs(s, d), '{"$or":[{"cust":{"$gt":100,"$lt":300}},{"$and":[{"status":"F"},{"priority":{"$like":"1-%"}}]},{"day":{"$gt":"2000-01-01"}}]}')


def find_in_table(s: SparkSession, d: str) -> DataFrame:
    """Numbers and texts of the customers of one market segment."""
    key = F.col("c_custkey").cast("string")
    wanted = fx.table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.when(F.col("c_custkey") % 3 == 2, F.concat(key, F.lit("x "))).otherwise(F.concat(F.lit("+"), key)).alias("value"))
    return dt.find_in(fx.order_docs(s, d), "mixed", wanted).select("_id")


def get_one(s: SparkSession, d: str) -> DataFrame:
    return dt.get(fx.order_docs(s, d), "17").select("_id", dt.field("cust").alias("cust"), dt.field("none").alias("none"))


def parsed_documents(s: SparkSession, d: str) -> DataFrame:
    e = fx.table(s, d, "events").select(F.concat(F.lit('{"_id":'), F.when(F.col("event_id") % 4 == 0, '""').otherwise(F.col("event_id").cast("string")), F.lit(',"t":"'), "event_type", F.lit('","v":'), (F.col("user_id") % 7).cast("string"), F.lit("}")).alias("j"))
    return dt.parse_documents(e, "j").select("_id", F.col("fields.t").alias("t"), F.col("fields.v").alias("v"))


def inserted(s: SparkSession, d: str) -> DataFrame:
    new = fx.table(s, d, "events").select(F.lit("mydb").alias("database"), F.create_map(F.lit("event"), F.col("event_id").cast("string")).alias("fields"), "event_id")
    return dt.insert(fx.order_docs(s, d), new, ("event_id",)).select("_id", F.col("fields.event").alias("event"), F.col("fields.cust").alias("cust"))


def upserted(s: SparkSession, d: str) -> DataFrame:
    changes = fx.table(s, d, "events").select(F.lit("mydb").alias("database"), F.concat(F.lit(" "), (F.col("user_id") * 2).cast("string")).alias("_id"), F.create_map(F.lit("cust"), F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("fields"), F.col("event_id").alias("seq"))
    return dt.upsert(fx.order_docs(s, d), changes).select("_id", F.col("fields.cust").alias("cust"))


def deleted(s: SparkSession, d: str) -> DataFrame:
    kept, n = dt.delete(fx.order_docs(s, d), '{"cust":{"$lt":500},"status":{"$in":["F","O"]}}')
    return kept.agg(F.count("*").alias("kept")).crossJoin(n.select(F.col("count").alias("removed")))


def lines_from_files(s: SparkSession, d: str) -> DataFrame:
    """Auth lines written with carriage returns, read back as a source and parsed."""
    path = new_path(s, "auth")
    fx.auth_lines(s, d).select(F.concat("line", F.lit("\r")).alias("value")).write.option("lineSep", "\n").text(path)
    return parse_auth(read_lines(s, "auth", path)).select("timestamp", "event_type", "user", "ip", "command", "raw_log")


def payload_files(s: SparkSession, d: str) -> DataFrame:
    """Insert requests written to files and read back, as a spool is."""
    path = new_path(s, "spool")
    insert_payloads(parse_shell_history(fx.shell_lines(s, d)), "mydb", 50).select("payload").write.text(path)
    return read_payloads(s, path).select("database", *[F.try_element_at("fields", F.lit(c)).alias(c) for c in ("timestamp", "command", "user")])


def loaded(s: SparkSession, d: str) -> DataFrame:
    """Orders written as objects of a JSON array, one a line with a comma behind, and loaded."""
    path = new_path(s, "collection")
    rows = fx.order_docs(s, d).select(F.map_concat(F.create_map(F.lit("_id"), "_id"), "fields").alias("m"))
    rows.select(F.concat(F.lit("  "), F.to_json("m"), F.lit(",")).alias("value")).write.text(path)
    return load_collection(s, path, "mydb").select("database", "_id", F.col("fields.cust").alias("cust"), F.col("fields.mixed").alias("mixed"))


def routed(s: SparkSession, d: str) -> DataFrame:
    """A table of several databases saved, and one of them read."""
    path = new_path(s, "routed")
    save_collection(fx.orders_by_status(s, d), path)
    return read_collection(s, path, "dbF").select("database", "_id", F.col("fields.cust").alias("cust"))


def inserted_by_database(s: SparkSession, d: str) -> DataFrame:
    """Each database counts its own ids; the one of ``view`` events is new."""
    at = F.when(F.col("event_type") == "view", "dbNew").when(F.col("event_type") == "click", "dbF").otherwise("dbO")
    new = fx.table(s, d, "events").select(at.alias("database"), F.create_map(F.lit("event"), F.col("event_id").cast("string")).alias("fields"), "event_id")
    return dt.insert(fx.orders_by_status(s, d), new, ("event_id",)).select("database", "_id", F.col("fields.event").alias("event"), F.col("fields.cust").alias("cust"))


def upserted_by_database(s: SparkSession, d: str) -> DataFrame:
    at = F.when(F.col("event_id") % 2 == 0, "dbF").otherwise("dbO")
    changes = fx.table(s, d, "events").select(at.alias("database"), F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit("\t")).alias("_id"), F.create_map(F.lit("cust"), F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("fields"), F.col("event_id").alias("seq"))
    return dt.upsert(fx.orders_by_status(s, d), changes).select("database", "_id", F.col("fields.cust").alias("cust"))


QUERIES: dict[str, Query] = {
    **stream_queries.QUERIES,
    **table_queries.QUERIES,
    "read_lines": lines_from_files,
    "payload_files": payload_files,
    "load_collection": loaded,
    "collection_routing": routed,
    "insert_by_database": inserted_by_database,
    "upsert_by_database": upserted_by_database,
    "find_eq_operator": _found('{"status":{"$eq":" F "},"mixed":{"$eq":"+30"}}'),
    "parse_syslog": lambda s, d: _shown(parse_syslog(fx.syslog_lines(s, d))),
    "parse_auth": lambda s, d: _shown(_auth(s, d)),
    "parse_shell": lambda s, d: _shown(parse_shell_history(fx.shell_lines(s, d))),
    "parse_audit_record": parse_audit_single,
    "merge_audit_complete": lambda s, d: _shown(merge_audit(fx.audit_lines(s, d), "complete")),
    "merge_audit_eager": lambda s, d: _shown(merge_audit(fx.audit_lines(s, d), "eager")),
    "to_iso_utc": iso_times,
    "sanitize_raw": sanitized,
    "normalize_events": normalized,
    "text_fields": text_fields,
    "filter_stateless": stateless,
    "keep_override": forced,
    "drop_empty_raw": empty_raw,
    "dedupe_consecutive": consecutive,
    "rate_limit": limited,
    "filter_chain": chain,
    "event_docs": event_docs,
    "json_lines": json_lines,
    "insert_payloads": payloads,
    "read_payloads": payloads_back,
    "parse_documents": parsed_documents,
    "find_all": _found("{}"),
    "find_eq": _found('{"mixed":"+30"}'),
    "find_range": _found('{"cust":{"$gt":"250"}}'),
    "find_time_range": _found('{"day":{"$gt":"1998-06-01T00:00:00Z","$lt":"1999-01-01"}}'),
    "find_like": _found('{"mixed":{"$like":"%1_x"}}'),
    "find_in": _found('{"mixed":{"$in":[3,"44x","x"," 7 ",99999999999]}}'),
    "find_in_table": find_in_table,
    "find_or": _found('{"$or":[{"status":"P"},{"cust":33}],"status":"none"}'),
    "find_and": _found('{"$and":[{"status":"F"},{"cust":{"$lt":300}}]}'),
    "find_multi_op": _found('{"cust":{"$gt":100,"$lt":300,"$eq":"","$none":1},"priority":{"$like":"%-_IGH"}}'),
    "find_mixed_order": _found('{"mixed":{"$gt":500}}'),
    "find_count": find_count,
    "get": get_one,
    "insert_ids": inserted,
    "upsert": upserted,
    "delete": deleted,
    "union_sources": union_sources,
    "pipeline_w1": w1,
}

__all__ = ["QUERIES", "SQL"]
