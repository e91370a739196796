"""A log of insert, find and delete requests, replayed as a whole.

A document lives from its insert to the first later delete that matches it, and a find
sees what lives at its place. So nothing is replayed one by one: every document is
matched with the different queries of its database once, its end is the nearest delete
among them, and what a find counts are the begins before it less the ends before it.

Queries are data here. A query tells what its matches must hold, a field with a value or
a field at all; documents and queries meet on that, and only pairs that met are tried.
Equal queries are one. Begins, deletes and finds of a query are ordered by range, so a query
that most requests ask spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.documents import assign_ids, next_id
from logloom.operators.query import access_keys, checked, equality_key, parsed_query, predicate
from logloom.schemas import DOC
from logloom.storage import next_value, numbered, running_sum, stored

#: Keys of queries (16 bytes and the query's text) of so many bytes may go to every executor; more are met by a shuffle.
BROADCAST_BYTES = 32 << 20


@dataclass
class Replay:
    """``responses``: ``database, seq, status, message, count`` for each request; ``found``: ``database, seq, _id, fields``
    for each document that a find returns, computed only where it is used; ``documents``: what is left."""

    responses: DataFrame
    found: DataFrame
    documents: DataFrame


def _key(database: Column, field: Column | str, value: Column | None = None) -> Column:
    return F.xxhash64(database, F.lit(field) if isinstance(field, str) else field, *([] if value is None else [value]))


def asked_as() -> Column:
    """One name for a query of a database."""
    return F.md5(F.concat_ws("\x00", "database", "query"))


def _queries(requests: DataFrame) -> DataFrame:
    """``database, query, sound`` and, for each thing a match may hold, ``field, value`` of the different queries."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for database, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(database, text, True, f, v) for f, v in access_keys(checked(parsed_query(text)))] or [(database, text, True, None, None)]
                except ValueError:
                    rows.append((database, text, False, None, None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string()), strict=True)], ["database", "query", "sound", "field", "value"])

    different = requests.where("operation in ('find', 'delete')").select("database", "query").distinct()
    return different.mapInArrow(run, "database string, query string, sound boolean, field string, value string")


def _texts(column: pa.Array) -> list[str | None]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _maps(column: pa.MapArray) -> Iterator[dict[str, str | None]]:
    """Maps of a column, of which none is NULL. Keys and values become objects all at once, which is many times faster than by ``to_pylist``."""
    at = column.offsets.to_pylist()
    keys, values = _texts(column.keys), _texts(column.items)
    return (dict(zip(keys[a:b], values[a:b], strict=True)) for a, b in pairwise(at))


def _matched(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``database, _id, begin, query`` of every document and query that match; ``docs`` is ``database, _id, fields, begin``."""
    value = equality_key(F.col("value"))
    met = F.when(F.col("field") == "", _key(F.col("database"), "")).when(F.col("value").isNull(), _key(F.col("database"), F.col("field"))).when(value.isNotNull(), _key(F.col("database"), F.col("field"), value))
    wanted = stored(queries.where("field is not null").select(met.alias("key"), "query").where("key is not null").distinct(), "wanted")
    size = wanted.agg(F.sum(F.octet_length("query") + 16)).first()[0] or 0
    own = F.map_concat("fields", F.create_map(F.lit("_id"), F.col("_id")))
    keys = F.flatten(F.transform(F.map_entries(own), lambda e: F.array(_key(F.col("database"), e["key"]), _key(F.col("database"), e["key"], equality_key(e["value"])))))
    asked = docs.withColumn("key", F.explode(F.array_append(keys, _key(F.col("database"), "")))).join(F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted.hint("merge"), "key")

    def run(batches: Iterator[pa.RecordBatch]):
        known: dict = {}
        for batch in batches:
            hit = []
            for i, f, q in zip(_texts(batch.column(1)), _maps(batch.column(2)), _texts(batch.column(4)), strict=True):
                if q not in known:
                    if len(known) >= 100_000:
                        known.clear()
                    known[q] = predicate(parsed_query(q))
                hit.append(known[q](f, i))
            kept = batch.filter(pa.array(hit, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(3), kept.column(4)], ["database", "_id", "begin", "query"])

    pairs = asked.select("database", "_id", "fields", "begin", "query").mapInArrow(run, "database string, _id string, begin long, query string")
    return pairs.distinct()  # a document may hold several things that a query asks for


def replay(requests: DataFrame, docs: DataFrame | None = None) -> Replay:
    """Requests (``seq, database, operation, data, query``) on the documents of a table (``database, _id, fields``).

    Requests of a database go by ``seq``, equal ones by operation, data and query. Inserted documents get the
    next ids of their database; in ``data`` one object or a list of them. A request that is not understood is answered with an
    error and changes nothing.
    """
    spark = requests.sparkSession
    docs = docs if docs is not None else spark.createDataFrame([], DOC)
    text = {c: F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r")) for c in ("operation", "data", "query")}
    log = requests.select("seq", F.coalesce("database", F.lit("")).alias("database"), *[t.alias(c) for c, t in text.items()]).withColumn("query", F.when(F.col("query") == "", "{}").otherwise(F.col("query")))
    log = stored(numbered(log, "database", ("seq", "operation", "data", "query"), "at"), "log")

    listed = F.when(F.col("data").startswith("["), F.col("data")).otherwise(F.concat(F.lit("["), "data", F.lit("]")))
    read = F.when(F.col("data").startswith("[") | F.col("data").startswith("{"), F.from_json(listed, "array<map<string,string>>"))
    inserts = log.where("operation = 'insert'").withColumn("list", read)
    new = inserts.select("database", "at", F.posexplode("list").alias("place", "fields")).where("fields is not null")
    given = assign_ids(new.withColumn("fields", F.map_filter("fields", lambda k, _: k != "_id")), next_id(docs), ("at", "place"))
    every = stored(docs.select("database", "_id", F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"), F.lit(-1).cast("long").alias("begin")).unionByName(given.select("database", "_id", "fields", F.col("at").alias("begin"))), "every")

    queries = stored(_queries(log), "queries")
    asked = log.where("operation in ('find', 'delete')").join(queries.select("database", "query", "sound").distinct(), ["database", "query"])
    pairs = stored(_matched(every, queries).withColumn("asked", asked_as()), "pairs")
    deletes = asked.where("sound and operation = 'delete'").select(asked_as().alias("asked"), "at")
    finds = asked.where("sound and operation = 'find'").select(asked_as().alias("asked"), "at", "database")

    # The end of a document: the nearest delete behind its begin among the queries that match it.
    of_deletes = pairs.join(deletes.select("asked").distinct(), "asked", "left_semi")
    line = deletes.select("asked", "at", F.col("at").alias("delete"), F.lit(None).cast("string").alias("database"), F.lit(None).cast("string").alias("_id"))
    line = line.unionByName(of_deletes.select("asked", F.col("begin").alias("at"), F.lit(None).cast("long").alias("delete"), "database", "_id"))
    ends = next_value(line, "asked", ("at",), "delete", "end").where("_id is not null and end is not null")
    ends = stored(ends.groupBy("database", "_id").agg(F.min("end").alias("end")), "ends")
    lives = every.join(ends, ["database", "_id"], "left")

    # A find counts the begins before it less the ends before it.
    of_finds = stored(pairs.join(finds.select("asked").distinct(), "asked", "left_semi").join(ends, ["database", "_id"], "left"), "of_finds")
    steps = of_finds.select("asked", F.col("begin").alias("at"), F.lit(1).cast("long").alias("step")).unionByName(of_finds.where("end is not null").select("asked", F.col("end").alias("at"), F.lit(-1).cast("long").alias("step")))
    counted = running_sum(steps.withColumn("database", F.lit(None).cast("string")).unionByName(finds.withColumn("step", F.lit(0).cast("long"))), "asked", ("at",), "step", "count").where("database is not null")
    counts = counted.select("database", "at", "count").unionByName(ends.groupBy("database", F.col("end").alias("at")).agg(F.count("*").alias("count")))
    counts = counts.unionByName(every.where("begin >= 0").groupBy("database", F.col("begin").alias("at")).agg(F.count("*").alias("count")))

    # Inserts ask nothing, so only the others meet the queries: all inserts of a database would be one key.
    told = asked.select("database", "at", "seq", "operation", "data", "sound", F.lit(None).cast("boolean").alias("read"))
    told = told.unionByName(log.where("operation not in ('find', 'delete')").select("database", "at", "seq", "operation", "data", F.lit(None).cast("boolean").alias("sound"), F.when(F.col("operation") == "insert", read.isNotNull()).alias("read")))
    said = told.join(counts, ["database", "at"], "left")
    n = F.coalesce("count", F.lit(0))
    problem = (
        F.when((F.col("operation") == "insert") & (F.col("data") == ""), "INSERT requires 'data'")
        .when((F.col("operation") == "insert") & ~F.col("data").rlike(r"^[\[{]"), "INSERT expects object {} or array []")
        .when((F.col("operation") == "insert") & ~F.col("read"), "Invalid JSON array format")
        .when(~F.col("operation").isin("insert", "find", "delete"), F.concat(F.lit("Unknown operation: "), "operation"))
        .when((F.col("operation") != "insert") & ~F.col("sound"), "Malformed query")
    )
    done = F.when(F.col("operation") == "find", F.concat(F.lit("Fetched "), n)).when(F.col("operation") == "delete", F.concat(F.lit("Deleted "), n)).when(F.col("data").startswith("["), F.concat(F.lit("Batch inserted: "), n)).otherwise("Inserted 1 document")
    responses = said.select("database", "seq", F.when(problem.isNull(), "success").otherwise("error").alias("status"), F.coalesce(problem, done).alias("message"), F.when(problem.isNull(), n).otherwise(0).cast("long").alias("count"))

    places = log.select("database", "at", "seq")
    seen = of_finds.join(finds.select("asked", F.col("at").alias("place")), "asked").where((F.col("place") > F.col("begin")) & (F.col("end").isNull() | (F.col("place") < F.col("end"))))
    found = seen.select("database", "_id", F.col("place").alias("at")).join(places, ["database", "at"]).join(every.select("database", "_id", "fields"), ["database", "_id"]).select("database", "seq", "_id", "fields")
    return Replay(responses, found, lives.where("end is null").select("database", "_id", "fields"))
