"""Rows that a stateful operator holds: packed, a run of rows in one element of a list state.

An element has the places of its rows (time, ``seq`` and command), which the rules turn on, and apart from them the
rows themselves as text. What is accepted is told from the places of all elements; rows are unpacked one element at a time.
A call to the JVM is for an element, not for a row, and Python never holds all rows of a key.
"""

from __future__ import annotations

import pickle
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Row

from logloom.operators.filters import _accepted

HELD = "places binary, commands binary, rows binary"
EVENT_ROWS = "key string, us bigint, row string"
EventRow = Row("key", "us", "row")
#: Rows of an element.
RUN = 10_000


#: Fewer bytes are not compressed; their length is given as -1.
SMALL = 1024


def squeezed(value) -> bytes:
    raw = pickle.dumps(value, protocol=5)
    if len(raw) < SMALL:
        return struct.pack("<q", -1) + raw
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def spread(packed: bytes):
    n = struct.unpack("<q", packed[:8])[0]
    return pickle.loads(packed[8:] if n < 0 else pa.decompress(packed[8:], n, codec="zstd", asbytes=True))


def packed(rows: list[tuple]) -> tuple[bytes, bytes, bytes]:
    """An element of ``(us, seq, command, row)``; the last may be missing."""
    us, seq, said, *texts = zip(*rows, strict=True)
    return np.array([us, seq], dtype=np.int64).tobytes(), squeezed(said), squeezed(texts[0]) if texts else b""


def in_runs(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    while run := list(islice(rows, RUN)):
        yield run


def places(elements: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Times and ``seq`` of all rows of elements."""
    each = [np.frombuffer(e[0], np.int64).reshape(2, -1) for e in elements]
    us, seq = np.concatenate(each, axis=1) if each else np.empty((2, 0), np.int64)
    return us, seq


def commands(elements: list[tuple]) -> np.ndarray:
    """Commands of all rows of elements; equal ones are one object."""
    known: dict[str, str] = {}
    out = [known.setdefault(c, c) for e in elements for c in spread(e[1])]
    array = np.empty(len(out), dtype=object)
    array[:] = out
    return array


def repeats(in_order: np.ndarray, before: str | None) -> np.ndarray:
    """Whether a command is not empty and equals the one before it."""
    return (in_order != "") & (in_order == np.concatenate([np.array([before], dtype=object), in_order[:-1]]))


def passing(elements: list[tuple], ripe: np.ndarray, entered: tuple[int | None, str | None], shell: bool, window_us: int) -> tuple[np.ndarray, tuple[int | None, str | None]]:
    """Which of the ripe rows pass both rules, in the order of time and ``seq``, and the last accepted time and command after them."""
    accepted, command = entered
    us, seq = places(elements)
    order = np.lexsort((seq, us))
    order = order[ripe[order]]
    if shell and len(order):
        said = commands(elements)[order]
        order, command = order[~repeats(said, command)], said[-1]
    if window_us:
        keep, accepted = _accepted(us[order], accepted, window_us)
        order = order[keep]
    kept = np.zeros(len(us), dtype=bool)
    kept[order] = True
    return kept, (accepted, command)


def unpacked(key: str, elements: list[tuple], kept: np.ndarray) -> Iterator[Row]:
    """The kept rows, an element at a time."""
    at = 0
    for e in elements:
        us = places([e])[0]
        mask, at = kept[at : at + len(us)], at + len(us)
        if mask.any():
            rows = spread(e[2])
            for i in np.flatnonzero(mask).tolist():
                yield EventRow(key, int(us[i]), rows[i])


def left(elements: list[tuple], stay: np.ndarray) -> Iterator[tuple]:
    """Elements of the rows that stay."""
    at = 0
    for e in elements:
        us, seq = places([e])
        mask, at = stay[at : at + len(us)], at + len(us)
        if mask.all():
            yield e
        elif mask.any():
            columns = [us.tolist(), seq.tolist(), spread(e[1]), *([spread(e[2])] if e[2] else [])]
            yield packed([row for row, stays in zip(zip(*columns, strict=True), mask, strict=True) if stays])
