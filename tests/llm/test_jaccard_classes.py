"""Pairs are listed only at the size class of the larger set."""

import random

import numpy as np
import pyarrow as pa

from logloom.llm.jaccard import Threshold, _candidate_pairs, shingle_sets


def test_candidates_agree_at_the_class_of_the_larger_set(spark):
    rng, threshold, texts = random.Random(5), Threshold(85), []
    for i in range(300):
        words = [f"w{i}x{j}" for j in range(rng.randint(120, 160))]
        texts += [" ".join(words), " ".join(f"v{rng.random()}" if rng.random() < 0.14 else w for w in words)]
    sets = dict(shingle_sets(pa.array(texts), 1))
    none = np.zeros(0, dtype=np.uint64)
    agree, linked = set(), set()
    for i in range(0, len(texts), 2):
        told = [list(threshold.signatures(sets[j], none)) for j in (i, i + 1)]
        own = [threshold.size_class(len(sets[j])) for j in (i, i + 1)]
        if abs(own[0] - own[1]) > 1:
            continue
        assert all(len(t) == 2 for t in told)
        (x, need_x, *_), (y, need_y, *_) = (t[max(own) - c] for t, c in zip(told, own, strict=True))
        if len(np.intersect1d(x, y)) >= max(need_x, need_y):
            agree.add((i + 1, i))
        shared = len(np.intersect1d(sets[i], sets[i + 1]))
        if 100 * shared >= 85 * (len(sets[i]) + len(sets[i + 1]) - shared):
            linked.add((i + 1, i))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["a"], r["b"]) for r in _candidate_pairs(docs, 1, threshold, spark.sparkContext.broadcast(none), 4).collect()}
    assert linked and linked <= found == agree
