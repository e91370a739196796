"""Winnowing against a plain search of every window in every document."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from logloom.llm import winnowing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item_id, text in items:
        ws = words(text)
        k = min(10, len(ws))
        for i in range(len(ws) - k + 1) if k else ():
            windows.setdefault(tuple(ws[i : i + k]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        ws, hit, named = words(text), set(), set()
        for k in {len(w) for w in windows}:
            for i in range(len(ws) - k + 1):
                found = windows.get(tuple(ws[i : i + k]))
                if found is not None:
                    hit.update(range(i, i + k))
                    named |= found - {None}
        out.append((doc_id, len(ws), len(hit), ",".join(sorted(str(i) for i in named))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    some = lambda n, v: [rng.choice(["Wörd", "naïve", "x", "y", "42", "the", "É"]) if rng.random() < 0.1 else f"w{rng.randrange(v)}" for _ in range(n)]
    items = [(i, " ".join(some(rng.randrange(8, 40), 9))) for i in range(40)]
    items += [(50, " ".join(some(9, 300))), (51, "one"), (52, "Two words"), (53, None), (54, "... --"), (7, " ".join(some(30, 50))), (None, " ".join(some(12, 60))), (55, items[3][1]), (56, "x x x x x x x x x x x x x x")]
    docs = []
    for i in range(120):
        ws = some(rng.randrange(0, 80), 9 if i % 3 else 5000)
        if i % 2:
            planted = words(rng.choice(items)[1])
            a = rng.randrange(len(planted) + 1)
            ws[len(ws) // 2 : len(ws) // 2] = planted[a : a + rng.randrange(1, 30)]
        docs.append((i, rng.choice([" ", "\n", ", ", " - "]).join(ws).upper() if i % 5 == 0 else " ".join(ws)))
    docs += [(3, docs[3][1]), (3, "one"), (None, "two words"), (None, None), (200, None), (201, ""), (202, "x " * 30_000), (203, " ".join(some(20_000, 5000) + words(items[1][1]) + some(20_000, 5000)))]
    return docs, items


def digests(found):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in found.withColumn("n_hit", winnowing.hit_words(F.col("spans"))).collect()), key=str)


@pytest.mark.parametrize("shuffled", [False, True])
def test_against_brute_force(spark, rows, monkeypatch, shuffled):
    docs, items = rows
    if shuffled:
        monkeypatch.setattr(winnowing, "FINGERPRINTS", 0)
        monkeypatch.setattr(winnowing, "BROADCAST_BYTES", 0)
    extra = {c: F.lit(1) for c in ("row", "window", "starts", "k", "found", "wanted", "spans", "items", "_id")}
    found = winnowing.contamination(spark.createDataFrame(docs, DOCS).repartition(4).withColumns(extra), spark.createDataFrame(items, "item_id long, text string").withColumns({"k": F.lit(2), "fingerprint": F.lit(0)}))
    assert digests(found) == brute(docs, items)


def test_fingerprints_guarantee():
    """Each shared span of ten words has a shared fingerprint, whatever stands around it."""
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        span = rng.integers(0, 5, 10).astype(np.uint64) + np.uint64(7)
        one = np.concatenate([rng.integers(0, 99, 15).astype(np.uint64), span, rng.integers(0, 99, 4).astype(np.uint64)])
        other = np.concatenate([rng.integers(0, 99, 3).astype(np.uint64), span, rng.integers(0, 99, 9).astype(np.uint64)])
        assert winnowing.fingerprints(one, 10)[15] == winnowing.fingerprints(other, 10)[3]


def test_edges(spark, rows):
    docs, items = (spark.createDataFrame(r, s) for r, s in zip(rows, (DOCS, "item_id long, text string"), strict=True))
    assert digests(winnowing.contamination(docs, items.limit(0))) == brute(rows[0], [])
    assert winnowing.contamination(docs.limit(0), items).count() == 0
    clean = winnowing.decontaminated(docs.withColumn("hit_id", F.lit(3)), items)
    assert clean.columns == ["doc_id", "text", "hit_id"]
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == sorted((d for d in rows[0] if not brute([d], rows[1])[0][2]), key=str)


def test_query(spark, rows, tmp_path):
    for name, r, s in (("documents", rows[0], DOCS), ("benchmark", rows[1], "item_id long, text string")):
        spark.createDataFrame(r, s).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = sorted((tuple(r) for r in winnowing.op11_decontamination(spark, str(tmp_path)).collect()), key=str)
    want = sorted(((d, n, h, len(t.split(",")) if t else 0, hashlib.sha256(t.encode()).hexdigest(), h > 0) for d, n, h, t in brute(*rows)), key=str)
    assert got == want
