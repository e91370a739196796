"""Log lines made from the ``events`` table and documents made from ``orders``, by plain column concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AGENT = "agent-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _join(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _iso() -> Column:
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def _lines(events: DataFrame, source: str, line: Column, host: Column) -> DataFrame:
    return events.select(F.lit(source).alias("source"), host.alias("hostname"), F.lit(AGENT).alias("agent_id"), line.alias("line"), F.col("event_id").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ingest_time"))


def _host() -> Column:
    return _join("web0", (F.col("user_id") % 5).cast("string"))


def auth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = _join("u", F.col("user_id").cast("string"))
    ip = _join("10.0.0.", F.col("user_id").cast("string"))
    body = (
        F.when(F.col("event_type") == "view", _join("sudo: pam_unix(sudo:session): session opened for user root(uid=0) by ", user, "(uid=1000)"))
        .when(F.col("event_type") == "click", "sudo: pam_unix(sudo:session): session closed for user root")
        .when(F.col("event_type") == "purchase", _join("sudo: ", user, " : TTY=pts/0 ; USER=root ; COMMAND=/bin/ls ", user))
        .when(F.col("event_type") == "error", _join("sshd[7]: Failed password for ", F.when(F.col("user_id") % 2 == 0, "invalid user ").otherwise(""), user, " from ", ip, " port 22 ssh2"))
        .otherwise(_join("sshd[7]: Accepted password for ", user, " from ", ip, " port 22"))
    )
    return _lines(table(spark, sf_dir, "events"), "auth", _join(_iso(), "Z ", _host(), " ", body), _host())


def syslog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    line = (
        F.when(F.col("event_type") == "view", _join(_iso(), "+03:00 ", _host(), " CRON[", F.col("event_id").cast("string"), "]: (root) CMD (job ", user, ")"))
        .when(F.col("event_type") == "click", _join(_iso(), "Z ", _host(), " kernel: usb ", user, " reset"))
        .when(F.col("event_type") == "error", _join(_iso(), "Z ", _host(), ' nginx[9]: Access Denied for "u', user, '"'))
        .when(F.col("event_type") == "signup", _join(_iso(), "Z ", _host(), " ", F.upper(_host()), ": hi ", user))
        .otherwise(_join(_iso(), "Z ", _host(), " systemd[1]: unit ", user, " failed"))
    )
    return _lines(table(spark, sf_dir, "events"), "syslog", line, _host())


def shell_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(table(spark, sf_dir, "events"), "bash_history", _join(F.col("event_type"), "\t", (F.col("user_id") % 2).cast("string")), F.lit("web01"))


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three records a serial. Odd serials come in another order; in every fourth the first record is a login."""
    serial = F.floor(F.col("event_id") / 3)
    place = F.col("event_id") % 3
    user = F.col("user_id").cast("string")
    kind = F.when(serial % 4 == 3, F.element_at(F.array(F.lit("USER_LOGIN"), F.lit("SYSCALL"), F.lit("PROCTITLE")), (place + 1).cast("int"))).when(serial % 2 == 0, F.element_at(F.array(F.lit("AVC"), F.lit("SYSCALL"), F.lit("PROCTITLE")), (place + 1).cast("int"))).otherwise(F.element_at(F.array(F.lit("SYSCALL"), F.lit("PROCTITLE"), F.lit("AVC")), (place + 1).cast("int")))
    head = _join("type=", kind, " msg=audit(", (serial + 1_700_000_000).cast("string"), ".", F.lpad((serial % 1000).cast("string"), 3, "0"), ":", serial.cast("string"), "): ")
    bad = F.col("user_id") % 3 == 0
    body = (
        F.when(kind == "AVC", _join('apparmor="DENIED" comm="c', user, '"'))
        .when(kind == "SYSCALL", _join("success=", F.when(bad, "no exit=-13").otherwise("yes exit=0"), " auid=", user, " uid=0 comm=\"s", user, '" exe="/bin/e', user, '"'))
        .when(kind == "PROCTITLE", _join("proctitle='cat /x", user, "'"))
        .otherwise(_join('acct="u', user, "\" res=", F.when(bad, "failed").otherwise("success")))
    )
    return _lines(table(spark, sf_dir, "events"), "auditd", _join(head, body), _join("web0", (serial % 5).cast("string")))


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of text fields."""
    fields = F.create_map(
        F.lit("cust"), F.col("o_custkey").cast("string"), F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"), F.lit("day"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("mixed"), F.when(F.col("o_custkey") % 3 == 0, _join("+", F.col("o_custkey").cast("string"))).when(F.col("o_custkey") % 3 == 1, _join(" ", F.col("o_custkey").cast("string"))).otherwise(_join(F.col("o_custkey").cast("string"), "x")),
    )
    return table(spark, sf_dir, "orders").select(F.lit("mydb").alias("database"), F.col("o_orderkey").cast("string").alias("_id"), fields.alias("fields"))


def orders_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a database for each status."""
    return order_docs(spark, sf_dir).withColumn("database", F.concat(F.lit("db"), F.col("fields.status")))
