"""Document tables: parse, find, insert, upsert and delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.query import compile_query, equality_key, implied_filter
from logloom.storage import beside, numbered


def parse_documents(df: DataFrame, c: str | Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON object a row as ``keep``, ``_id`` and ``fields``; rows without an ``_id`` are rejected."""
    text = F.col(c) if isinstance(c, str) else c
    rows = df.select(*keep, F.from_json(text, "map<string,string>").alias("m"))
    ids = F.try_element_at("m", F.lit("_id"))
    return rows.select(*keep, ids.alias("_id"), F.map_filter("m", lambda k, _: k != "_id").alias("fields")).where("_id is not null and _id != ''")


def field(name: str) -> Column:
    return F.col("_id") if name == "_id" else F.try_element_at("fields", F.lit(name))


def find(docs: DataFrame, query: str | dict) -> DataFrame:
    """Documents that match: a filter in the scan's stage."""
    return docs.where(compile_query(query))


def find_events(events: DataFrame, query: str | dict, day: str | None = "event_date") -> DataFrame:
    """Event documents with a column for each field that match; ``day`` holds the first ten characters of ``timestamp``.

    The query also gives a weaker condition on plain columns, so that scans pass over days and row groups that cannot match.
    """
    columns = {c: F.col(c) for c in events.columns if c != day}
    hit = compile_query(query, lambda name: F.col(name) if name in columns else F.lit(None).cast("string"))
    weaker = implied_filter(query, columns, {"timestamp": (F.col(day), 10)} if day in events.columns and "timestamp" in columns else None)
    return events.where(hit) if weaker is None else events.where(weaker).where(hit)


def find_count(docs: DataFrame, query: str | dict) -> DataFrame:
    return docs.agg(F.count_if(compile_query(query)).alias("count"))


def find_in(docs: DataFrame, name: str, values: DataFrame) -> DataFrame:
    """``$in`` with a long list given as a table with one column ``value``: a semi join instead of many terms."""
    wanted = values.select(equality_key(F.col("value")).alias("_wanted")).where("_wanted is not null").distinct()
    return docs.join(wanted, equality_key(field(name)) == F.col("_wanted"), "left_semi")


def get(docs: DataFrame, doc_id: str) -> DataFrame:
    return docs.where(F.col("_id") == doc_id)


def delete(docs: DataFrame, query: str | dict) -> tuple[DataFrame, DataFrame]:
    """What stays, and the number removed as a one-row table; neither shuffles documents."""
    hit = compile_query(query)
    return docs.where(~hit), docs.agg(F.count_if(hit).alias("count"))


def upsert(docs: DataFrame, changes: DataFrame, seq: str = "seq") -> DataFrame:
    """The last document of each trimmed ``_id`` of a database; ``changes`` come after ``docs`` and among themselves by ``seq``.

    Ties, as two documents of ``docs`` with one trimmed id, go by untrimmed id and fields.
    """
    from logloom.functions.text import db_trim

    columns = docs.columns
    both = docs.withColumn("_turn", F.lit(None).cast("long")).unionByName(changes.withColumn("_turn", F.col(seq).cast("long")).select(*columns, "_turn"))
    place = F.struct(F.coalesce("_turn", F.lit(-(2**62))), F.col("_id"), F.xxhash64(F.map_entries("fields")))
    kept = both.groupBy("database", db_trim(F.col("_id")).alias("_trimmed")).agg(F.max_by(F.struct(*columns), place).alias("d"))
    return kept.select(*[F.col("_trimmed").alias(c) if c == "_id" else F.col(f"d.{c}").alias(c) for c in columns])


def next_id(docs: DataFrame) -> DataFrame:
    """``database, start``: the largest numeric id of each database + 1 (1 for none)."""
    return docs.groupBy("database").agg((F.coalesce(F.max(F.col("_id").try_cast("long")), F.lit(0)) + 1).alias("start"))


def assign_ids(new_docs: DataFrame, start: DataFrame, order_by: tuple[str, ...]) -> DataFrame:
    """Dense ids in the order of ``order_by`` inside each database, from its ``start`` or from 1 where it is new."""
    rows = beside(numbered(new_docs.drop("_id"), "database", order_by, "_number"), "database", start)
    return rows.withColumn("_id", (F.col("_number") + F.coalesce("start", F.lit(1))).cast("string")).drop("_number", "start")


def insert(docs: DataFrame, new_docs: DataFrame, order_by: tuple[str, ...]) -> DataFrame:
    """``docs`` and ``new_docs`` with the next ids of their database; an ``_id`` of a new document is ignored, rows without fields are rejected."""
    made = assign_ids(new_docs.where("fields is not null"), next_id(docs), order_by)
    return docs.unionByName(made.select(*docs.columns))
