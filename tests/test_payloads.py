"""Payloads of a stream close when full or after the interval, and are numbered on over restarts."""

import json
import time

import pytest
from pyspark.sql import functions as F

from logloom.jobs.stream_queries import _until
from logloom.operators.parsers import parse_auth, parse_shell_history
from logloom.sources.documents import insert_payloads
from logloom.sources.lines import read_lines, stream_lines
from logloom.streaming.payloads import insert_into_table, stream_payloads, write_payloads
from logloom.tables import DocumentTable

SCHEMA = "agent_id string, batch_no bigint, n int, payload string"


def test_full_interval_and_restart(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    out = str(tmp_path / "out")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{out}/batch=none")

    def sent():
        rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(out).orderBy("batch_no").collect()
        return [(r["batch_no"], r["n"], [d["command"] for d in json.loads(r["payload"])["data"]]) for r in rows]

    def run(interval, done):
        events = parse_shell_history(stream_lines(spark, "bash_history", str(logs), str(tmp_path / "tail"), "h", "me", from_begin=True))
        query = write_payloads(stream_payloads(events, "mydb", 3, interval), out, str(tmp_path / "ck"), "200 milliseconds")
        end = time.time() + 90
        while not done(sent()) and time.time() < end:
            assert query.exception() is None
            time.sleep(0.3)
        query.stop()
        return sent()

    (logs / "a.log").write_text("".join(f"c{i}\n" for i in range(7)))
    first = [(0, 3, ["c0", "c1", "c2"]), (1, 3, ["c3", "c4", "c5"])]
    assert run(3600, lambda s: len(s) == 2) == first  # c6 is held
    with open(logs / "a.log", "a") as f:
        f.write("c7\n")
    got = run(1, lambda s: sum(n for _, n, _ in s) == 8)
    assert got[:2] == first and [b for b, *_ in got] == list(range(len(got))) and [c for *_, cs in got[2:] for c in cs] == ["c6", "c7"]
    batch = insert_payloads(parse_shell_history(read_lines(spark, "bash_history", str(logs), "h", "me")), "mydb", 3).orderBy("batch_no").first()["payload"]
    stored = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(out).orderBy("batch_no").first()["payload"]
    as_stream = json.loads(stored)
    assert json.loads(batch).keys() == as_stream.keys() and json.loads(batch)["data"][0].keys() == as_stream["data"][0].keys()


def test_one_agent_spreads_and_equals_batch(spark, tmp_path):
    """One agent has all rows, over many hours and in files in no order: several tasks make its payloads, and they are those of batch."""
    logs = tmp_path / "logs"
    logs.mkdir()
    lines = [f"2024-01-{1 + i % 700 // 24:02}T{i % 24:02}:00:{i // 700:02}.{i:06}Z h sudo: pam_unix(sudo:session): session closed for user u{i}\n" for i in range(2100)]
    for k in range(3):
        (logs / f"{k}.log").write_text("".join(lines[k::3]))
    tasks, got = set(), []

    def keep(batch, number):
        rows = batch.withColumn("task", F.spark_partition_id()).collect()
        tasks.update(r["task"] for r in rows)
        got.extend((r["agent_id"], r["batch_no"], r["n"], json.loads(r["payload"])["data"]) for r in rows)

    events = parse_auth(stream_lines(spark, "auth", str(logs), str(tmp_path / "tail"), "h", "me", from_begin=True))
    query = stream_payloads(events, "mydb", 4, 3600).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(keep).trigger(processingTime="200 milliseconds").start()
    end = time.time() + 90
    while len(got) < 525 and time.time() < end:
        assert query.exception() is None
        time.sleep(0.3)
    query.stop()
    batch = insert_payloads(parse_auth(read_lines(spark, "auth", str(logs), "h", "me")), "mydb", 4).collect()
    assert sorted(got, key=lambda r: r[1]) == sorted([("me", r["batch_no"], 4, json.loads(r["payload"])["data"]) for r in batch], key=lambda r: r[1])
    assert len(tasks) > 1


def test_a_batch_runs_once_and_is_inserted_in_order(spark, tmp_path):
    """What makes the payloads of a micro-batch is run once, and ids go by agent, payload and place."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    def payload(agent, number, n):
        return (agent, number, n, json.dumps({"database": "mydb", "operation": "insert", "data": [{"at": f"{agent}{number}.{i}"} for i in range(n)], "query": {}}))

    payloads = [payload(a, b, 3 - b) for b in (2, 0, 1) for a in ("y", "x")]
    spark.createDataFrame(payloads, SCHEMA).repartition(3).write.json(str(tmp_path / "in"))
    query = insert_into_table(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")).mapInArrow(counted, SCHEMA), str(tmp_path / "table"), str(tmp_path / "ck"), "t", "100 milliseconds")
    table, end = DocumentTable(spark, str(tmp_path / "table")), time.time() + 60
    while not table.snapshot().files and time.time() < end:
        assert query.exception() is None
        time.sleep(0.2)
    query.stop()
    got = sorted((int(r["_id"]), r["fields"]["at"]) for r in table.read("mydb").collect())
    assert got == list(enumerate([f"{a}{b}.{i}" for a in "xy" for b in range(3) for i in range(3 - b)], 1))
    assert made.value == len(payloads)


class _Stream:
    """A query whose first batch takes ``took`` seconds, and whose others bring nothing."""

    isActive, status = False, {"isTriggerActive": False}

    def __init__(self, took):
        self.end = time.time() + took

    def exception(self):
        return None

    @property
    def lastProgress(self):
        now = time.time()
        return None if now < self.end else {"batchId": int(now * 10), "timestamp": str(now), "sources": [{"startOffset": "1", "endOffset": "1"}]}

    def stop(self):
        pass


def test_a_long_batch_is_waited_for():
    query = _Stream(2)
    _until(query, lambda: time.time() > query.end, 0.5)
    with pytest.raises(TimeoutError):
        _until(_Stream(0), lambda: False, 0.5)
