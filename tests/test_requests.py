"""A log of requests against one that is carried out request by request."""

import json
import random

import pyarrow as pa
from pyspark.sql import functions as F

from logloom.operators import requests as rq
from logloom.operators.documents import assign_ids, next_id
from logloom.operators.query import checked, matches, parsed_query

REQUEST = "seq long, database string, operation string, data string, query string"
DOC = "database string, _id string, fields map<string,string>"


def one_by_one(log, docs):
    held = {}
    for d, i, f in docs:
        held.setdefault(d, {})[i] = f
    last = {d: max([int(i) for i in ids if i.isdigit()], default=0) for d, ids in held.items()}
    answers, found = [], []
    for seq, db, op, data, query in sorted(log, key=lambda r: (r[0], r[2], r[3], r[4])):
        table, op, data, query = held.setdefault(db, {}), op.strip(), (data or "").strip(), (query or "").strip() or "{}"
        if op == "insert":
            try:
                given = json.loads(data if data[0] == "[" else f"[{data}]") if data and data[0] in "[{" else None
            except json.JSONDecodeError:
                answers.append((db, seq, "error", "Invalid JSON array format", 0))
                continue
            if given is None:
                answers.append((db, seq, "error", "INSERT expects object {} or array []" if data else "INSERT requires 'data'", 0))
                continue
            for d in given:
                last[db] = last.get(db, 0) + 1
                table[str(last[db])] = {k: v if isinstance(v, str) else json.dumps(v) for k, v in d.items() if k != "_id"}
            answers.append((db, seq, "success", f"Batch inserted: {len(given)}" if data[0] == "[" else "Inserted 1 document", len(given)))
        elif op in ("find", "delete"):
            try:
                parsed = checked(parsed_query(query))
            except ValueError:
                answers.append((db, seq, "error", "Malformed query", 0))
                continue
            hit = [i for i, f in table.items() if matches(parsed, f, i)]
            answers.append((db, seq, "success", f"{'Fetched' if op == 'find' else 'Deleted'} {len(hit)}", len(hit)))
            for i in hit:
                if op == "find":
                    found.append((db, seq, i))
                else:
                    del table[i]
        else:
            answers.append((db, seq, "error", f"Unknown operation: {op}", 0))
    return sorted(answers), sorted(found), sorted((d, i, tuple(sorted(f.items()))) for d, t in held.items() for i, f in t.items())


def some_log(rng, n):
    queries = ["{}", "", '{"u":1}', '{"u":"2"}', '{"u":{"$in":[1,"3"]}}', '{"t":{"$gt":"m"}}', '{"$or":[{"u":3},{"t":{"$like":"a%"}}]}', '{"$and":[{"u":1},{"t":"a"}]}', '{"_id":"3"}', '{"none":1}', '{"u":{"$gt":1}}', "{bad", '{"$or":1}', '{"$or":[]}', '{"u":{"$in":1}}']
    out = []
    for seq in range(n):
        op = rng.choice(["insert", "insert", "insert", "find", "find", "delete", " find ", "drop"])
        doc = lambda: json.dumps({"_id": "9", "u": rng.choice([1, 2, "+3", "x"]), "t": rng.choice(["a", "z", "ab", ""])})
        data = rng.choice([doc(), f"[{doc()}, {doc()}]", f" [{doc()}] ", "[]", "", "text", '{"u":']) if op == "insert" else ""
        query = rng.choice(queries[2:] if op == "delete" and rng.random() < 0.9 else queries)
        out.append((seq, rng.choice("ab"), op, data, query))
    return out


def replayed(spark, log, docs):
    made = rq.replay(spark.createDataFrame(log, REQUEST).repartition(4), spark.createDataFrame(docs, DOC))
    return (
        sorted(tuple(r) for r in made.responses.select("database", "seq", "status", "message", "count").collect()),
        sorted(tuple(r) for r in made.found.select("database", "seq", "_id").collect()),
        sorted((r["database"], r["_id"], tuple(sorted(r["fields"].items()))) for r in made.documents.collect()),
    )


def test_against_one_by_one(spark, monkeypatch):
    docs = [("a", "5", {"u": "1", "t": "a"}), ("a", "x", {"u": "2"}), ("c", "1", {"u": "1"})]
    log = some_log(random.Random(2), 300)
    want = one_by_one(log, docs)
    assert replayed(spark, log, docs) == want and len(want[1]) > 50 and 3 < len(want[2])
    monkeypatch.setattr(rq, "BROADCAST_BYTES", 0)
    assert replayed(spark, log[:60], docs) == one_by_one(log[:60], docs)


def test_edges(spark):
    assert replayed(spark, [], []) == ([], [], [])
    assert replayed(spark, [], [("a", "1", {"k": "v"})])[2] == [("a", "1", (("k", "v"),))]
    hot = [(i, "a", ("insert", "find", "find", "delete")[i % 4 if i % 40 == 3 or i % 4 < 3 else 1], '{"k":"v"}' if i % 4 == 0 else "", "{}") for i in range(400)]
    assert replayed(spark, hot, []) == one_by_one(hot, [])  # one query that nearly all ask


def test_inserts_of_a_database_stay_spread(spark):
    """Ids are given where rows are: dealt by database to meet its first id, all rows of one would be in one task."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        new = spark.range(0, 4000, 1, 4).select(F.lit("a").alias("database"), F.create_map(F.lit("u"), F.col("id").cast("string")).alias("fields"), F.col("id").alias("at"))
        made = assign_ids(new, next_id(spark.createDataFrame([], DOC)), ("at",))
        in_parts = made.groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.max("_id")).collect()
        assert len(in_parts) > 1 and max(r["count"] for r in in_parts) < 3000
        assert sorted(int(r["_id"]) - r["at"] for r in made.collect()) == [1] * 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_maps_of_a_cut_batch():
    maps = [{"a": "1", "b": None}, {}, {"c": "+2"}, {"a": ""}]
    column = pa.array([list(m.items()) for m in maps], pa.map_(pa.string(), pa.string()))
    assert list(rq._maps(column)) == maps and list(rq._maps(column.slice(1, 2))) == maps[1:3] and list(rq._maps(column.slice(0, 0))) == []
