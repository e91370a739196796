"""Events to documents, insert payloads, and document collections on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.documents import parse_documents
from logloom.schemas import ALWAYS, OPTIONAL
from logloom.sources.arrays import read_objects
from logloom.storage import numbered

REQUEST = "database string, operation string, data string, query string"


def to_event_docs(events: DataFrame, agent_id: str | None = None) -> DataFrame:
    """The document columns of events; optional fields are NULL when empty, and so left out of JSON."""
    rows = events.withColumn("agent_id", F.lit(agent_id)) if agent_id is not None else events
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ALWAYS], *[F.nullif(c, F.lit("")).alias(c) for c in OPTIONAL])


def event_document() -> Column:
    """The document of an event as one struct."""
    return F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ALWAYS], *[F.nullif(c, F.lit("")).alias(c) for c in OPTIONAL])


def to_json_lines(docs: DataFrame) -> DataFrame:
    return docs.select(F.to_json(F.struct(*docs.columns)).alias("value"))


def insert_payloads(events: DataFrame, database: str, batch_size: int, order_by: tuple[str, ...] = ("event_time", "source", "seq")) -> DataFrame:
    """Insert requests of ``batch_size`` events of one agent in order, the last one shorter: ``agent_id, batch_no, payload``.

    Rows are numbered inside each agent by ranges, so one agent may have all rows;
    arrays hold ``batch_size`` rows at most.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be 1 at least")
    doc = event_document()
    order = tuple(dict.fromkeys((*order_by, "raw_log")))
    rows = events.select("agent_id", *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], doc.alias("doc"))
    rows = numbered(rows, "agent_id", tuple(f"_{i}" for i in range(len(order))), "n").withColumn("batch_no", F.floor(F.col("n") / batch_size))
    batches = rows.groupBy("agent_id", "batch_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "doc"))), lambda r: r["doc"]).alias("data"))
    empty = F.create_map().cast("map<string,string>")
    return batches.select("agent_id", "batch_no", F.to_json(F.struct(F.lit(database).alias("database"), F.lit("insert").alias("operation"), "data", empty.alias("query"))).alias("payload"))


def expand_payloads(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``database`` and ``fields`` of every document of insert requests; ``data`` is a list or one object."""
    request = payloads.select(F.from_json(column, REQUEST).alias("r")).select("r.*").where("operation = 'insert'")
    listed = F.when(F.ltrim("data").startswith("["), F.col("data")).otherwise(F.concat(F.lit("["), "data", F.lit("]")))
    return request.select("database", F.explode(F.from_json(listed, "array<map<string,string>>")).alias("fields"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return expand_payloads(spark.read.text(path, lineSep="\n").withColumnRenamed("value", "payload"))


def load_collection(spark: SparkSession, path: str, database: str = "", one_per_line: bool = True) -> DataFrame:
    """A JSON array of flat objects. With one object a line it is read in one pass, in any other layout in two; files split in both."""
    if one_per_line:
        lines = spark.read.text(path, lineSep="\n").select(F.regexp_replace(F.btrim("value", F.lit(" \t\r\n")), ",$", "").alias("value")).where(F.col("value").startswith("{"))
    else:
        lines = read_objects(spark, path).select(F.col("text").alias("value"))
    return parse_documents(lines, "value").select(F.lit(database).alias("database"), "_id", "fields")


def save_collection(docs: DataFrame, path: str) -> None:
    """Writes a new version, a folder for each database; never the path that ``docs`` are read from."""
    docs.write.mode("errorifexists").partitionBy("database").parquet(path)


def read_collection(spark: SparkSession, path: str, database: str | None = None) -> DataFrame:
    """A saved table; with ``database`` only that one's files are read."""
    docs = spark.read.parquet(path)
    return docs if database is None else docs.where(F.col("database") == database)
