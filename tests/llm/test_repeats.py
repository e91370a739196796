"""The automata of the repeats operator decide what is removed."""

import numpy as np
import pyarrow as pa
import pytest

from logloom.llm import repeats
from logloom.llm.wordhash import text_chunks, words_of

PASSAGE = [f"p{i}" for i in range(30)]


def shard(texts, phrases, copies=()):
    """What one shard locates with these confirmed phrases."""
    docs = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "apart": [False] * len(texts)})
    rows = [(b"\n".join(phrases) if phrases else None, None), *[(None, c) for c in copies]]
    known = pa.table({"phrases": pa.array([r[0] for r in rows], pa.binary()), "copy": pa.array([r[1] for r in rows], pa.int64())})
    return repeats.shard_located(docs, known).to_pylist()


def anchor_phrases(text):
    (chunk,) = text_chunks(pa.array([text]))
    w = words_of(chunk[2], chunk[3])
    _, at = repeats.anchors(w.hash)
    return {" ".join(text.split()[p : p + repeats.ANCHOR]).encode() for p in at.tolist()}


def test_windows_come_from_hits():
    text = " ".join(PASSAGE)
    texts = [text, f"x \t {text}\n", "short", None]
    for phrases in (set(), {b"p0 p1 p2 p3 p4 p5 p6 p7 p8 other"}):
        assert [(r["n_removed"], r["n_located"], r["hashes"]) for r in shard(texts, phrases)] == [(0, 0, None)] * 4
    got = shard(texts, anchor_phrases(text))
    assert got[0]["n_located"] == got[1]["n_located"] == len(anchor_phrases(text)) and got[0]["text"] == text
    starts = lambda blob: sorted(np.frombuffer(blob, np.uint32).tolist())
    every = list(range(len(PASSAGE) - repeats.WINDOW + 1))
    assert starts(got[0]["starts"]) == every and got[0]["later"] is None
    assert starts(got[1]["later"]) == [s + 1 for s in every]
    one = min(anchor_phrases(text))
    some = shard(texts, {one})
    assert 0 < len(starts(some[0]["starts"])) < len(every) or len(anchor_phrases(text)) == 1
    assert [r["n_removed"] for r in shard(texts, set(), copies=[0])] == [len(PASSAGE), 0, 0, 0]


@pytest.mark.parametrize("few", [True, False])
def test_automata_decide(spark, monkeypatch, few):
    """Without automata only copies are removed; with them all repeated passages."""
    text = " ".join(PASSAGE)
    rows = [(i, f"head{i} {text} tail{i}") for i in range(20)] + [(20, f"head0 {text} tail0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = lambda: [r["n_removed"] for r in repeats.streamed(docs).orderBy("doc_id").collect()]
    if not few:
        monkeypatch.setattr(repeats, "BROADCAST_BYTES", 0)
    assert removed() == [0] + [len(PASSAGE)] * 19 + [len(PASSAGE) + 2]


def test_without_automata(monkeypatch):
    text = " ".join(PASSAGE)
    monkeypatch.setattr(repeats, "automaton", lambda phrases: None)
    assert [(r["n_removed"], r["text"]) for r in shard([text, f"x {text}"], anchor_phrases(text))] == [(0, None)] * 2


def test_phrases_are_confirmed_by_words():
    sent = pa.table({"shards": [b"\x01\0\0\0" * 3], "counts": [b"\x01\0\0\0" * 3], "phrases": [b"a b\nc d\na b"]})
    assert repeats._confirmed_phrases(sent) == {1: [b"a b"]}


def test_streamed_locates_in_every_shard(spark):
    text = " ".join(PASSAGE)
    rows = [(i, f"head{i} {text} tail{i}" if i % 2 else f"none {i} " * 30) for i in range(40)]
    got = {r["doc_id"]: r for r in repeats.streamed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["n_located"] > 0 for i in range(1, 40, 2)) and got[1]["n_removed"] == 0
    assert all(got[i]["n_removed"] == len(PASSAGE) for i in range(3, 40, 2))
