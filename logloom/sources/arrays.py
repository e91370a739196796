"""JSON arrays of objects in any layout, read in parallel.

An array may stand on one line or on many, so a line says nothing about where an object
ends. Files are cut at closing braces, which splits them over tasks whatever their layout, and
two passes tell which braces close an object:

1. Each block of a file tells its *transition*: whether it leaves a string open, and by how
   much it goes deeper, once for a begin outside and once for a begin inside a string.
   That is a row a block.
2. The transitions are composed in the order of blocks: quotes by their parity, then depths by
   a sum. With the state it begins in, each block gives its whole objects. The parts of an
   object that lies across blocks, two a block at most, are put together afterwards.

Braces, brackets and quotes inside strings, and escaped quotes, do not count. Objects may hold
objects and arrays, which stay JSON text. A file that does not end outside all
objects is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.storage import BROADCAST_ROWS, stored

QUOTE, ESCAPE, OPEN, CLOSE = 34, 92, 123, 125
TRANSITIONS = "file string, block long, part long, size long, bytes long, flips int, outside long, inside long"
PIECES = "file string, block long, first boolean, last boolean, text string"


def structure(data: np.ndarray, in_string: bool) -> tuple[np.ndarray, bool]:
    """``(depth behind each byte, relative to the begin; whether a string is open at the end)``."""
    escapes = data == ESCAPE
    quotes = np.flatnonzero(data == QUOTE)
    if escapes.any():
        # A quote counts behind an even run of escapes.
        plain = np.flatnonzero(~escapes)
        before = np.searchsorted(plain, quotes) - 1
        run = quotes - 1 - np.where(before >= 0, plain[np.maximum(before, 0)], -1)
        quotes = quotes[run % 2 == 0]
    flips = np.zeros(len(data), dtype=np.int8)
    flips[quotes] = 1
    inside = (np.cumsum(flips) + in_string) % 2 == 1
    steps = np.where(inside, 0, (data == OPEN).astype(np.int8) - (data == CLOSE).astype(np.int8))
    return np.cumsum(steps, dtype=np.int64), bool((len(quotes) + in_string) % 2)


def _runs(batches: Iterator[pa.RecordBatch]):
    """``(first row, file, block, bytes)`` of runs of rows of a batch; ``value`` lost the brace behind each row."""
    for batch in batches:
        files, blocks = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
        codes = files.indices.to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1, [len(codes)]]) if len(codes) else [0]
        values = batch.column(2).to_pylist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(a), files.dictionary[int(codes[a])].as_py(), int(blocks[a]), "".join([v + "}" for v in values[a:b]]).encode()


def _transitions(pieces: DataFrame) -> DataFrame:
    """Of each run of rows of a block in a task; a block's runs are numbered."""

    def run(batches):
        seen: dict = {}
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        for batch in batches:
            for row, file, block, raw in _runs([batch]):
                part = seen[file, block] = seen.get((file, block), -1) + 1
                data = np.frombuffer(raw, dtype=np.uint8)
                (outside, flips), (inside, _) = structure(data, False), structure(data, True)
                told = (file, block, part, batch.column(3)[row].as_py(), len(raw), int(flips), int(outside[-1]), int(inside[-1]))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(told, kinds, strict=True)], [f.split()[0] for f in TRANSITIONS.split(", ")])

    return pieces.mapInArrow(run, TRANSITIONS)


def _begins(transitions: DataFrame) -> DataFrame:
    """``file, block, in_string, depth`` at the begin of each block, and ``sound``: whether the file ends outside all objects."""
    order = Window.partitionBy("file").orderBy("block", "part")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = transitions.withColumn("in_string", F.coalesce(F.sum("flips").over(upto), F.lit(0)) % 2 == 1)
    rows = rows.withColumn("step", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))).withColumn("depth", F.coalesce(F.sum("step").over(upto), F.lit(0)))
    whole = Window.partitionBy("file")
    # A file that does not end with a brace got one that is not there.
    added = F.sum("bytes").over(whole) - F.col("size")
    sound = (F.sum("flips").over(whole) % 2 == 0) & (F.sum("step").over(whole) == -added)
    return rows.withColumn("sound", sound).where("part = 0").select("file", "block", "in_string", "depth", "sound")


def _split(batches: Iterator[pa.RecordBatch]):
    """Whole objects of each block, and its parts of objects that lie across blocks."""
    at, state = None, None

    def piece(file, block, first, last, raw):
        return file, block, first, last, raw.decode("utf-8", "replace")

    for batch in batches:
        out = []
        for row, file, block, raw in _runs([batch]):
            if (file, block) != at:
                if state and state["open"]:
                    out.append(piece(*at, state["first"], False, b"".join(state["open"])))
                in_string, depth = batch.column(3)[row].as_py(), batch.column(4)[row].as_py()
                at, state = (file, block), {"in_string": in_string, "depth": depth, "open": [], "first": depth == 0}
            data = np.frombuffer(raw, dtype=np.uint8)
            depth, ends_inside = structure(data, state["in_string"])
            depth = depth + state["depth"]
            before = np.concatenate([[state["depth"]], depth[:-1]])
            closes = np.flatnonzero((depth == 0) & (before > 0)) + 1
            opens = np.flatnonzero((before == 0) & (depth > 0))
            low = 0 if state["depth"] > 0 else None
            starts = ([0] if low is not None else []) + opens.tolist()
            for i, a in enumerate(starts):
                b = int(closes[i]) if i < len(closes) else None
                if i or low is None:
                    state["first"] = True
                state["open"].append(raw[a:b])
                if b is not None:
                    out.append(piece(file, block, state["first"], True, b"".join(state["open"])))
                    state["open"] = []
            state["in_string"], state["depth"] = ends_inside, int(depth[-1])
        if out:
            yield _batch(out)
    if state and state["open"]:
        yield _batch([piece(*at, state["first"], False, b"".join(state["open"]))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in PIECES.split(", ")])


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """``file, text`` of the objects of JSON arrays, one a row. A missing or empty array has none."""
    text = spark.read.text(path, lineSep="}")
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.col("_metadata.file_size").alias("size"))
    begins = stored(_begins(_transitions(pieces)), "begins")
    torn = begins.where("not sound").select("file").limit(1).collect()
    if torn:
        raise ValueError(f"{torn[0][0]} ends inside an object or a string")
    if begins.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = pieces.join(F.broadcast(begins), ["file", "block"])
    else:
        rows = pieces.withColumn("row", F.monotonically_increasing_id()).join(begins.hint("merge"), ["file", "block"]).sortWithinPartitions("file", "block", "row")
    pieces = stored(rows.select("file", "block", "value", "in_string", "depth").mapInArrow(_split, PIECES), "pieces")
    whole = pieces.where("first and last").select("file", "text")
    # Parts go by block; an object's parts end with the first that is a last one.
    parts = pieces.where("not (first and last)")
    order = Window.partitionBy("file").orderBy("block", F.desc("last"))
    number = F.coalesce(F.sum(F.col("last").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = parts.withColumn("number", number).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", F.col("last").cast("int").alias("last"), "text"))).alias("p"))
    return whole.unionByName(joined.select("file", F.concat_ws("", "p.text").alias("text")))
