"""Counting shingles takes room for a bounded number of them, whatever a batch holds."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from logloom.llm import jaccard


class Rows:
    def mapInArrow(self, run, schema):
        return run


def test_members_in_bounded_room(monkeypatch):
    monkeypatch.setattr(jaccard, "COUNTED_AT_ONCE", 1 << 16, raising=False)
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(500)) for _ in range(2000)] + ["a b c", None, "a b c"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    run = jaccard._members(Rows(), 2)
    tracemalloc.start()
    out = list(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    out = pa.Table.from_batches(out).to_pylist()
    assert peak < 32 << 20
    sets = dict(jaccard.shingle_sets(batch.column(1), 2))
    assert [(r["doc_id"], r["n"]) for r in out if r["n"] is not None] == [(i, len(sets[i])) for i in range(len(texts))]
    told, true = Counter(), Counter(np.concatenate(list(sets.values())).view(np.int64).tolist())
    for r in out:
        if r["n"] is None:
            assert r["d2"] > 1
            told[r["d1"]] += r["d2"]
    # Of a shingle those are missed that are alone in their room; copies count once.
    assert all(true[s] - 30 <= n <= true[s] for s, n in told.items()) and set(told) >= {s for s, n in true.items() if n > 30}
