"""Queries on document tables kept by a log of commits, on logs of requests, and on collections of any layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.jobs import fixtures as fx
from logloom.jobs import w3
from logloom.jobs.stream_queries import new_path
from logloom.operators.documents import find_events
from logloom.operators.parsers import parse_auth
from logloom.operators.requests import replay
from logloom.sources.documents import load_collection, to_event_docs
from logloom.tables import DocumentTable


def updated(s: SparkSession, d: str) -> DataFrame:
    """A table of three databases gets insert requests and deletes, and is searched."""
    root = new_path(s, "table")
    DocumentTable(s, root).load(fx.orders_by_status(s, d))
    data = F.array(F.struct(F.col("event_id").cast("string").alias("event"), (F.col("user_id") * 10).cast("string").alias("cust")))
    request = F.struct(F.when(F.col("event_type") == "click", "dbF").otherwise("dbO").alias("database"), F.lit("insert").alias("operation"), data.alias("data"))
    w3.update(s, root, fx.table(s, d, "events").select(F.to_json(request).alias("payload")), F.col("fields.event").cast("long"))
    w3.update(s, root, deletes={"dbO": '{"cust":{"$gt":400}}', "dbF": '{"cust":{"$lt":50}}'})
    found = [w3.search(s, root, database, "{}") for database in ("dbO", "dbF", "dbP")]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("database", "_id", F.col("fields.event").alias("event"), F.col("fields.cust").alias("cust"))


def counted(s: SparkSession, d: str) -> DataFrame:
    """What each step on a table says it did: loaded, inserted, inserted again under its number, and removed."""
    root = new_path(s, "table")
    table = DocumentTable(s, root)
    loaded = table.load(fx.orders_by_status(s, d))
    new = fx.table(s, d, "events").select(F.lit("dbNew").alias("database"), F.create_map(F.lit("type"), "event_type", F.lit("user"), F.col("user_id").cast("string")).alias("fields"), "event_id")
    inserted = [table.insert(new, ("event_id",), ("job", 1)) for _ in range(2)]
    removed = [table.delete("dbNew", '{"type":{"$in":["click","view"]}}'), table.delete("dbO", "{}"), table.delete("dbNone", "{}")]
    counts = dict(zip(("loaded", "inserted", "again", "removed", "all", "none"), [loaded, *inserted, *removed], strict=True))
    left = table.read().groupBy("database").agg(F.count("*").alias("n")).select(F.concat(F.lit("left in "), "database").alias("step"), "n")
    return s.createDataFrame(list(counts.items()), "step string, n long").unionByName(left)


def looked_up(s: SparkSession, d: str) -> DataFrame:
    """Documents of a table found by an indexed field and by id."""
    table = DocumentTable(s, new_path(s, "table"), ("mixed",))
    table.load(fx.orders_by_status(s, d))
    found = [table.find(database, '{"mixed":{"$in":[30,"44x"," 7"]},"cust":{"$gt":3}}') for database in ("dbF", "dbO", "dbP")]
    one = [table.get(database, "33") for database in ("dbF", "dbO", "dbP")]
    out = found[0]
    for more in (*found[1:], *one):
        out = out.unionByName(more)
    return out.select("database", "_id", F.col("fields.mixed").alias("mixed"))


def requests_of_events(s: SparkSession, d: str) -> DataFrame:
    """``view`` and ``signup`` insert, ``click`` and ``error`` find, ``purchase`` deletes; two databases."""
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    doc = F.to_json(F.struct(user.alias("user"), F.col("event_id").cast("string").alias("event"), kind.alias("type")))
    by_user = F.concat(F.lit('{"user":'), user, F.lit("}"))
    query = (
        F.when(kind == "click", by_user).when(kind == "purchase", by_user)
        .when(kind == "error", F.concat(F.lit('{"$or":[{"user":{"$lt":'), (F.col("user_id") % 3 + 2).cast("string"), F.lit('}},{"type":"signup","user":"1"}]}'))).otherwise("")
    )
    operation = F.when(kind.isin("view", "signup"), "insert").when(kind.isin("click", "error"), "find").otherwise("delete")
    data = F.when(kind == "view", F.concat(F.lit("["), doc, F.lit(", "), doc, F.lit("]"))).when(kind == "signup", doc).otherwise("")
    return fx.table(s, d, "events").select(F.col("event_id").cast("long").alias("seq"), F.concat(F.lit("db"), (F.col("user_id") % 2).cast("string")).alias("database"), operation.alias("operation"), data.alias("data"), query.alias("query"))


def replayed(s: SparkSession, d: str) -> DataFrame:
    """The answer to every request of a log."""
    return replay(requests_of_events(s, d)).responses


def replayed_documents(s: SparkSession, d: str) -> DataFrame:
    """What a log of requests leaves."""
    return replay(requests_of_events(s, d)).documents.select("database", "_id", F.col("fields.event").alias("event"))


def pretty(s: SparkSession, d: str) -> DataFrame:
    """Orders as one JSON array over many lines, with braces and quotes in its texts, and an array on one line."""
    path = new_path(s, "pretty")
    rows = fx.order_docs(s, d).select(F.concat(F.lit('{\n  "_id" : "'), "_id", F.lit('",\n  "cust": '), F.col("fields.cust"), F.lit(',\n  "note": "a } of {\\"'), F.col("fields.status"), F.lit('\\", [\\\\"\n},')).alias("value"))
    rows.write.option("lineSep", "\n").text(path)
    lines = load_collection(s, path, "mydb", one_per_line=False)
    return lines.select("database", "_id", F.col("fields.cust").alias("cust"), F.col("fields.note").alias("note"))


def pruned(s: SparkSession, d: str) -> DataFrame:
    """A time range and a user of event documents in a folder for each day; days and row groups outside are not read."""
    path = new_path(s, "events")
    docs = to_event_docs(parse_auth(fx.auth_lines(s, d))).withColumn("event_date", F.substring("timestamp", 1, 10))
    docs.write.partitionBy("event_date").parquet(path)
    table = s.read.schema(docs.schema).parquet(path)
    found = find_events(table, '{"timestamp":{"$gt":"2024-01-03T12:00:00","$lt":"2024-01-20"},"user":{"$like":"u1%"},"severity":{"$in":["high","medium"]}}')
    return found.select("timestamp", "hostname", "user", "severity", "raw_log")


QUERIES = {
    "pipeline_w3": updated,
    "table_counts": counted,
    "table_lookup": looked_up,
    "request_log": replayed,
    "request_log_documents": replayed_documents,
    "load_pretty": pretty,
    "find_pruned": pruned,
}
