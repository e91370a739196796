"""Insert requests from a stream: a payload closes when it is full or has waited for the interval.

The rows of a micro-batch are dealt by agent and slice of event time, so one agent may have all rows and no
task holds or sorts more than a slice. Four steps follow each other in the same batch:

1. Rows of each agent and slice are counted, batch by batch of Arrow.
2. :class:`NumberSlices` has a small state for each agent: its next payload, and how many rows are in it.
   It tells each slice where its rows begin. A processing-time timer runs from the first row of a payload on, and
   says that the payload is closed.
3. :func:`_cut` sorts a slice and cuts it into parts of payloads.
4. :class:`JoinParts` gives out a payload when its parts are as many rows as it needs. Only parts of
   payloads that are not whole are its state, fewer than ``batch_size`` events of an agent.

State is kept by the checkpoint, so numbers go on without gaps after a restart, and what was held then is sent.
As a stream's plan is not shared, rows are read twice, once only to count.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from logloom.sources.documents import event_document
from logloom.storage import session_dir
from logloom.tables import DocumentTable

PAYLOAD = "agent_id string, batch_no bigint, n int, payload string"
SLICE_SEC = 3600
#: Payloads of an agent that meet in one state.
BLOCK = 64
COUNTS = "agent_id string, slice bigint, n bigint"
#: Of an agent's slice: where its first row goes; without a slice: the rows that a closed payload has.
TOLD = "agent_id string, slice bigint, batch_no bigint, place bigint, batch_size bigint"
PART = "agent_id string, block bigint, batch_no bigint, place bigint, n bigint, need bigint, docs string"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by(["agent_id", "slice"]).aggregate([([], "count_all")])
        yield from t.select(["agent_id", "slice", "count_all"]).rename_columns(["agent_id", "slice", "n"]).to_batches()


class NumberSlices(StatefulProcessor):
    def __init__(self, batch_size: int, interval_ms: int):
        self.batch_size, self.interval_ms = batch_size, interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "number bigint, filled bigint, due_ms bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        number, filled, due = self.next.get() or (0, 0, None)
        counts: Counter[int] = Counter()
        for r in rows:
            counts[r["slice"]] += r["n"]
        had = due
        for at, n in sorted(counts.items()):
            yield Row(agent_id=key[0], slice=at, batch_no=number, place=filled, batch_size=self.batch_size)
            full, filled = divmod(filled + n, self.batch_size)
            number, due = number + full, None if full else due
        if filled:
            latest = timerValues.getCurrentProcessingTimeInMs() + self.interval_ms
            due = latest if due is None else min(due, latest)  # a restart may come with a shorter interval
        if had is not None and had != due:
            self.handle.deleteTimer(had)
        if due is not None and had != due:
            self.handle.registerTimer(due)
        self.next.update((number, filled, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        number, filled, due = self.next.get() or (0, 0, None)
        if filled and due is not None and due <= expiredTimerInfo.getExpiryTimeInMs():
            yield Row(agent_id=key[0], slice=None, batch_no=number, place=filled, batch_size=self.batch_size)
            self.next.update((number + 1, 0, None))

    def close(self) -> None:
        pass


def _cut(rows: pa.Table) -> pa.Table:
    """Parts of payloads, in order, of the rows of an agent and slice; a closed payload as a part without rows."""
    says = pc.is_valid(rows["batch_no"])
    told, rows = rows.filter(says), rows.filter(pc.invert(says))
    agent, out = told["agent_id"][0].as_py(), []
    if not rows.num_rows:
        out = [(agent, b // BLOCK, b, None, 0, n, None) for b, n in zip(told["batch_no"].to_pylist(), told["place"].to_pylist(), strict=True)]
    else:
        ((number, filled, size),) = zip(*(told[c].to_pylist() for c in ("batch_no", "place", "batch_size")), strict=True)
        docs = rows.sort_by([(c, "ascending") for c in ("us", "source", "seq", "doc")])["doc"].combine_chunks()
        at = 0
        while at < len(docs):
            n = min(size - filled, len(docs) - at)
            out.append((agent, number // BLOCK, number, filled, n, size, ",".join(docs.slice(at, n).to_pylist())))
            at, number, filled = at + n, number + 1, 0
    return pa.table([pa.array(c, pa.string() if i in (0, 6) else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names=[f.split()[0] for f in PART.split(", ")])


class JoinParts(StatefulProcessor):
    def __init__(self, database: str):
        self.begin, self.end = f'{{"database":{json.dumps(database)},"operation":"insert","data":[', '],"query":{}}'

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "batch_no bigint, place bigint, n bigint, docs string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        parts, closed = [], {}
        for r in rows:
            if r["n"] == r["need"]:
                yield self._payload(key, r["batch_no"], [(r["batch_no"], r["place"], r["n"], r["docs"])])
            elif r["n"]:
                parts.append((r["batch_no"], r["place"], r["n"], r["docs"]))
                closed.setdefault(r["batch_no"], r["need"])
            else:
                closed[r["batch_no"]] = r["need"]
        if not closed:
            return
        open_parts: dict[int, list] = {}
        for p in sorted([*(tuple(h) for h in self.held.get()), *parts], key=lambda p: p[:2]):
            open_parts.setdefault(p[0], []).append(p)
        left = []
        for number, ps in open_parts.items():
            if sum(p[2] for p in ps) == closed.get(number):
                yield self._payload(key, number, ps)
            else:
                left += ps
        if left:
            self.held.put(left)
        else:
            self.held.clear()

    def _payload(self, key, number: int, parts: list[tuple]) -> Row:
        return Row(agent_id=key[0], batch_no=number, n=sum(p[2] for p in parts), payload=f"{self.begin}{','.join(p[3] for p in parts)}{self.end}")

    def close(self) -> None:
        pass


def stream_payloads(events: DataFrame, database: str, batch_size: int, interval_sec: float) -> DataFrame:
    """``agent_id, batch_no, n, payload`` of a stream of events, as :func:`logloom.sources.documents.insert_payloads` makes of a table.

    Events of one micro-batch go by event time, source and ``seq``. Needs the RocksDB state store provider. Events are read
    twice, so no stateful operator may come before.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be 1 at least")
    rows = events.select(F.coalesce("agent_id", F.lit("")).alias("agent_id"), F.unix_micros("event_time").alias("us"), "source", "seq", F.to_json(event_document()).alias("doc"))
    rows = rows.na.fill({"us": 0, "seq": 0, "source": ""}).withColumn("slice", F.floor(F.col("us") / (SLICE_SEC * 1_000_000)).cast("long"))
    counts = rows.select("agent_id", "slice").mapInArrow(_counted, COUNTS)
    told = counts.groupBy("agent_id").transformWithState(NumberSlices(batch_size, int(interval_sec * 1000)), outputStructType=TOLD, outputMode="append", timeMode="processingTime")
    parts = rows.unionByName(told, allowMissingColumns=True).groupBy("agent_id", "slice").applyInArrow(_cut, PART)
    return parts.groupBy("agent_id", "block").transformWithState(JoinParts(database), outputStructType=PAYLOAD, outputMode="append", timeMode="processingTime")


def write_payloads(payloads: DataFrame, out: str, checkpoint: str, trigger: str = "1 second") -> StreamingQuery:
    """Writes payloads, a folder for each micro-batch; one that is run again overwrites its own, so each is stored once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return payloads.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(processingTime=trigger).start()


def insert_into_table(payloads: DataFrame, root: str, checkpoint: str, name: str, trigger: str = "1 second", indexed: tuple[str, ...] = ()) -> StreamingQuery:
    """Inserts the documents of payloads into the :class:`logloom.tables.DocumentTable` at ``root``, one commit a micro-batch.

    A micro-batch is committed under ``name`` and its number, so one that is run again after a failure inserts nothing twice. Ids go by
    agent, payload and place. The plan of a micro-batch, with its state, is run once: its documents are written to a folder of the
    session, which the next one overwrites.
    """
    held = f"{session_dir(payloads.sparkSession)}/{uuid.uuid4().hex}/lists"

    def insert(batch: DataFrame, number: int) -> None:
        request = F.from_json("payload", "database string, data array<map<string,string>>")
        rows = batch.select("agent_id", "batch_no", request.alias("r")).select("agent_id", "batch_no", "r.database", F.filter("r.data", lambda f: f.isNotNull()).alias("fields"))
        rows = rows.withColumn("n", F.size("fields"))
        rows.write.mode("overwrite").parquet(held)
        lists = batch.sparkSession.read.schema(rows.schema).parquet(held)
        if not lists.isEmpty():
            DocumentTable(batch.sparkSession, root, indexed).insert_lists(lists, ("agent_id", "batch_no"), (name, number))

    return payloads.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(insert).trigger(processingTime=trigger).start()
