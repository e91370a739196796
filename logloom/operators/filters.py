"""The event filter chain. The first rule that decides wins.

Rules R1-R6 are stateless and run before any shuffle, so only survivors are
dealt out by host or rate key. Events that a keep needle forces through touch no
state and skip both shuffles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.functions.text import contains_any, severity_rank
from logloom.schemas import FilterSettings
from logloom.storage import numbered, stored

RATE_KEY = ("hostname", "source", "event_type", "process", "user", "ip")


def is_forced(s: FilterSettings) -> Column:
    return contains_any(F.col("raw_log"), s.keep_if_raw_contains)


def passes_stateless(s: FilterSettings) -> Column:
    """Rules on severity, type, process and raw text."""
    rank = {"high": 2, "medium": 1}.get(s.min_severity, 0)
    return (
        (severity_rank(F.col("severity")) >= rank)
        & ~contains_any(F.col("event_type"), s.drop_event_types)
        & ~contains_any(F.col("process"), s.drop_process_contains)
        & ~contains_any(F.col("raw_log"), s.drop_raw_contains)
    )


def drop_empty_raw(events: DataFrame, s: FilterSettings) -> DataFrame:
    return events.where("raw_log != ''") if s.drop_empty_raw else events


def filter_stateless(events: DataFrame, s: FilterSettings) -> DataFrame:
    """Rules R1-R6 as one predicate; needs no shuffle."""
    return drop_empty_raw(events, s).where(is_forced(s) | passes_stateless(s))


#: Rows of a host that are looked at in one run.
RUN_ROWS = 100_000


def dedupe_consecutive(events: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Shell history events whose command equals the one before on the same host go; other events stay.

    A host's rows are numbered and dealt in runs; the last row of a run is shown to the
    next one, too, so a noisy host spreads over tasks.
    """
    shell = numbered(events.where("source = 'bash_history'"), "hostname", order, "_n")
    run = F.floor(F.col("_n") / RUN_ROWS)
    runs = F.when(F.col("_n") % RUN_ROWS == RUN_ROWS - 1, F.array(run, run + 1)).otherwise(F.array(run))
    dealt = shell.withColumn("_own", run).withColumn("_run", F.explode(runs))
    before = F.lag("command").over(Window.partitionBy("hostname", "_run").orderBy("_n"))
    seen = dealt.withColumn("_before", before).where("_own = _run")
    kept = seen.where(F.col("_before").isNull() | (F.col("command") != F.col("_before")) | (F.col("command") == ""))
    return events.where("source != 'bash_history'").unionByName(kept.select(*events.columns))


#: Windows in a slice of time.
SLICE_WINDOWS = 1024


def _accepted(times: np.ndarray, last: int | None, window: int) -> tuple[np.ndarray, int | None]:
    """Places that a greedy limiter accepts in sorted ``times``, and the last accepted time; one jump for each."""
    keep, i = [], 0 if last is None else int(np.searchsorted(times, last + window, side="left"))
    while i < len(times):
        keep.append(i)
        last = int(times[i])
        i = int(np.searchsorted(times, last + window, side="left"))
    return np.array(keep, dtype=np.int64), last


def _ways_through(times: np.ndarray, start: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """``(upto, out)`` of a slice: entering with a next allowed time of at most ``upto``, the last accepted time is ``out``.

    Every event of the slice's first window, and the first one after it, may be
    the first accepted; following the jumps from all of them at once gives where
    each way ends. Ways join soon, so few rows are left.
    """
    n = len(times)
    jump = np.searchsorted(times, times + window, side="left")
    jump = np.where(jump < n, jump, np.arange(n))
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    first = min(n, int(np.searchsorted(times, start + window, side="left")) + 1)
    out = times[jump[:first]]
    last_of_run = np.append(out[1:] != out[:-1], True)
    return times[:first][last_of_run], out[last_of_run]


def _runs(batches):
    """``(key, slice, rows)`` for each run of equal keys and slices of a batch."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        keys = t["_key"].combine_chunks().dictionary_encode()
        codes, slices = keys.indices.to_numpy(), t["_slice"].to_numpy()
        change = np.flatnonzero((np.diff(codes) != 0) | (np.diff(slices) != 0)) + 1 if len(codes) else np.zeros(0, dtype=int)
        cuts = np.concatenate([[0], change, [len(codes)]])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                yield keys.dictionary[int(codes[lo])].as_py(), int(slices[lo]), t.slice(lo, hi - lo)


def rate_limit(events: DataFrame, window_sec: int) -> DataFrame:
    """Of each rate key, events at least ``window_sec`` after the last accepted one; ties go by ``seq``.

    Most events have none of their key within a window before or behind them. They are
    accepted whatever came, and bear on nothing. For the rest, the rule is greedy, so what
    a time slice accepts depends on the last accepted time before it, and on
    nothing else. Events are dealt by key *and* slice, so a
    noisy key spreads over many tasks: first each slice tells, for every way to
    enter it, the time it leaves behind; these few rows are followed slice by slice
    of a key; then each slice accepts its events with the time it was entered with.
    """
    if window_sec <= 0:
        return events
    window, schema = window_sec * 1_000_000, events.schema
    width = window * SLICE_WINDOWS
    us = F.unix_micros("event_time")
    keyed = events.withColumns({"_key": F.to_json(F.array(*[F.coalesce(F.col(k), F.lit("")) for k in RATE_KEY])), "_us": us, "_slice": F.floor(us / width).cast("long")})

    def ways(batches):
        held: list[np.ndarray] = []
        current = None

        def told():
            upto, out = _ways_through(np.concatenate(held), current[1] * width, window)
            return pa.RecordBatch.from_arrays([pa.array([current[0]] * len(upto), pa.string()), pa.array([current[1]] * len(upto), pa.int64()), pa.array(upto, pa.int64()), pa.array(out, pa.int64())], ["_key", "_slice", "upto", "out"])

        for key, at, t in _runs(batches):
            if (key, at) != current:
                if current:
                    yield told()
                current, held = (key, at), []
            held.append(t["_us"].to_numpy())
        if current:
            yield told()

    def follow(batches):
        key, last, at, entered, done = None, None, None, None, False
        for k, s, t in _runs(batches):
            if k != key:
                key, last, at = k, None, None
            if s != at:
                at, entered, done = s, last, False
            if not done:
                upto, out = t["upto"].to_numpy(), t["out"].to_numpy()
                i = 0 if entered is None else int(np.searchsorted(upto, entered + window, side="left"))
                if i < len(upto):
                    last, done = int(out[i]), True
            if entered is not None and entered + window > s * width:
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.string()), pa.array([s], pa.int64()), pa.array([entered], pa.int64())], ["_key", "_slice", "_entered"])

    def accept(batches):
        current, last = None, None
        for batch in batches:
            alone = batch.column("_alone")
            yield batch.filter(alone).select(columns)
            for key, at, t in _runs([batch.filter(pc.invert(alone))]):
                if (key, at) != current:
                    current, last = (key, at), t["_entered"][0].as_py()
                keep, last = _accepted(t["_us"].to_numpy(), last, window)
                if len(keep):
                    yield from t.select(columns).take(pa.array(keep)).to_batches()

    columns, order = events.columns, ("_key", "_slice", "_us")
    row, begin = F.col("_us"), F.col("_slice") * width
    near = Window.partitionBy("_key", "_slice").orderBy("_us", "seq")
    alone = (row - F.coalesce(F.lag("_us").over(near), begin) >= window) & (F.coalesce(F.lead("_us").over(near), begin + width) - row >= window)
    keyed = keyed.withColumn("_alone", alone)
    told = keyed.where("not _alone").select(*order).sortWithinPartitions(*order).mapInArrow(ways, "_key string, _slice long, upto long, out long")
    entered = told.repartition("_key").sortWithinPartitions("_key", "_slice", "upto").mapInArrow(follow, "_key string, _slice long, _entered long").dropDuplicates(["_key", "_slice"])
    # Times of entry are brought to the rows' own partitioning; the join deals rows by the same keys, so they move once.
    dealt = keyed.join(entered.hint("merge"), ["_key", "_slice"], "left").select(*columns, *order, "_entered", "_alone")
    return dealt.sortWithinPartitions(*order, "seq").mapInArrow(accept, schema)


def filter_events(events: DataFrame, s: FilterSettings) -> DataFrame:
    """The whole chain, R1-R8, from one settings object."""
    rows = filter_stateless(events, s)
    if not s.dedupe_bash_history and s.rate_limit_window_sec <= 0:
        return rows
    # The stateful rules read the survivors several times, so lines are parsed and merged once.
    rows = stored(rows, "survivors")
    forced = rows.where(is_forced(s))
    rest = rows.where(~is_forced(s))
    if s.dedupe_bash_history:
        rest = dedupe_consecutive(rest)
    return rate_limit(rest, s.rate_limit_window_sec).unionByName(forced)
